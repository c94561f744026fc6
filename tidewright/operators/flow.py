"""Splitting, batching, shedding, token buckets, derivation. Greedy folds pass once over each lane's ordered rows, holding one state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, by: list[str], order: str) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(order)))


def split_records(df: DataFrame, by: list[str], order: str, most: int) -> DataFrame:
    """chunk: consecutive chunks of at most ``most`` records; the last one carries the position."""
    out = numbered(df, by, order).withColumn("chunk", F.floor((F.col("rn") - 1) / most).cast("bigint"))
    last = F.max("chunk").over(Window.partitionBy(*by))
    return out.withColumn("carries_position", F.col("chunk") == last).drop("rn")


def split_bytes(df: DataFrame, by: list[str], order: str, size: Column, most: int) -> DataFrame:
    """by, order, chunk: greedy chunks that would exceed ``most`` bytes are closed before; an oversize record is alone."""
    return _groups(df, by, order, size, lambda used, x: used == 0 or (used is not None and x is not None and used + x <= most), "chunk")


def batch_bytes(df: DataFrame, by: list[str], order: str, size: Column, least: int) -> DataFrame:
    """by, order, batch: a record is added, then the batch is closed when it holds ``least`` bytes or more."""
    return _groups(df, by, order, size, lambda used, x: used is not None and used < least, "batch")


def _fold(df: DataFrame, by: list[str], order: str, weight: Column, step: Callable, name: str, kind: str) -> DataFrame:
    """by, order, ``name``: ``step(state, weight) -> (state, value)`` over each lane's rows in order; the first state of a lane is None.

    Rows stream by, sorted, and one lane's state is held: time is linear in a lane's rows, and a lane need not fit in memory.
    """
    rows = df.select(*by, F.col(order).cast("bigint").alias(order), weight.alias("_w"))
    rows = rows.repartition(*by).sortWithinPartitions(*by, order, "_w")
    value = pa.float64() if kind == "double" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane, state = None, None
        for batch in batches:
            out = []
            for *key, w in zip(*[batch.column(n).to_pylist() for n in range(len(by))], batch.column(len(by) + 1).to_pylist(), strict=True):
                if key != lane:
                    lane, state = key, None
                state, found = step(state, w)
                out.append(found)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, value)], names=[*by, order, name])

    columns = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in [*by, order]]
    return rows.mapInArrow(run, ", ".join([*columns, f"`{name}` {kind}"]))


def _groups(df: DataFrame, by: list[str], order: str, weight: Column, fits: Callable, name: str) -> DataFrame:
    """Group numbers of a greedy fold: a row stays in its group while ``fits(weight so far, its own)``, else opens the next."""

    def step(state, x):
        used, n = state or (0, 0)
        if state is None or fits(used, x):
            used = None if used is None or x is None else used + x
        else:
            used, n = x, n + 1
        return (used, n), n

    return _fold(df, by, order, weight.cast("bigint"), step, name, "bigint")


def batch_age(df: DataFrame, by: list[str], order: str, at: Column, most: int) -> DataFrame:
    """by, order, batch: a batch holds records at most ``most`` younger than its first; a later one opens the next batch."""

    def step(state, x):
        first, n = state or (None, -1)
        if first is None or x is None or x - first > most:
            first, n = x, n + 1
        return (first, n), n

    return _fold(df, by, order, at.cast("bigint"), step, "batch", "bigint")


def batch_count(df: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    return numbered(df, by, order).withColumn("batch", F.floor((F.col("rn") - 1) / n).cast("bigint")).drop("rn")


def batch_flush_on(df: DataFrame, by: list[str], order: str, flush: Column) -> DataFrame:
    """A record that fulfils ``flush`` is the last of its batch."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("batch", F.coalesce(F.sum(F.when(flush, 1).otherwise(0)).over(before), F.lit(0)).cast("bigint"))


def shed_newest(df: DataFrame, by: list[str], order: str, budget: int) -> DataFrame:
    """admitted: of each lane's waiting records the first ``budget``; the rest is shed, its position advances, it counts as abandoned."""
    return numbered(df, by, order).withColumn("admitted", F.col("rn") <= budget).drop("rn")


def token_bucket(df: DataFrame, by: list[str], order: str, at: Column, rate: float, burst: float) -> DataFrame:
    """by, order, wait: refill by elapsed time up to ``burst``, take one; below zero the wait is the lack over the rate. ``at`` in seconds."""

    def step(state, x):
        tokens, last = state or (burst, None)
        left = min(burst, tokens + (0.0 if x is None or last is None else x - last) * rate) - 1
        return (left, x), -left / rate if left < 0 else 0.0

    return _fold(df, by, order, at.cast("double"), step, "wait", "double")


def derive(df: DataFrame, parts: Column, key: str = "id") -> DataFrame:
    """Children of each record, one for each entry of ``parts``: the root goes on, the parent is set, one reference each."""
    out = df.select("*", F.posexplode(parts).alias("part", "body_part"))
    return out.withColumn("parent", F.col(key)).withColumn("root", F.coalesce(F.col("root"), F.col(key))).withColumn("refs", F.lit(1))


def merge(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """One record for each group: references add up, destination, time and metadata are the first parent's, the payload is empty."""
    first = lambda c: F.min_by(c, order).alias(c)
    return df.groupBy(*by).agg(F.sum("refs").alias("refs"), first("dest"), first("tm"), F.array_sort(F.collect_list(order)).alias("parents"), F.lit(None).cast("string").alias("body"))


def admission_rounds(df: DataFrame, by: list[str], order: str, weight: Column, budget: int) -> DataFrame:
    """by, order, round: a lane's records wait while what is on its way and they together weigh more than the budget; each round settles before
    the next. A record that alone weighs more is admitted when nothing is on its way."""
    return split_bytes(df, by, order, weight, budget).withColumnRenamed("chunk", "round")
