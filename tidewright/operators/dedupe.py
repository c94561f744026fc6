"""Windowed keyed dedupe, compare-and-set."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import joined_path


def mark_duplicates(df: DataFrame, key: list[str], at: str, window: int, ties: list[str]) -> DataFrame:
    """duplicate: the same key came at most ``window`` before, in event time. A repeat renews the window."""
    w = Window.partitionBy(*key).orderBy(at, *ties)
    return df.withColumn("duplicate", F.coalesce(F.col(at) - F.lag(at).over(w) <= window, F.lit(False)))


def stream_dedupe(df: DataFrame, key: list[str], at: str, window: str) -> DataFrame:
    """For a stream: state is bounded by the watermark, the window is required."""
    return df.withWatermark(at, window).dropDuplicatesWithinWatermark(key)


def compare_and_set(df: DataFrame, key: str, order: str, want: str, drop: str, epoch: str | None = None) -> DataFrame:
    """key, order, applied, version: writes of each key in order; one is applied if it wants the version there is. A delete starts versions
    afresh. With ``epoch`` a write below the key's highest epoch so far is fenced off, and that floor outlives a delete.

    Sorted rows stream by, and the state of one key is held: time is linear, and a key's writes need not fit in memory.
    """
    fence = F.lit(0) if epoch is None else F.col(epoch)
    rows = df.select(key, order, F.col(want).cast("bigint").alias("_w"), F.coalesce(F.col(drop), F.lit(False)).alias("_d"), F.coalesce(fence, F.lit(0)).cast("bigint").alias("_e"))
    rows = rows.repartition(key).sortWithinPartitions(key, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, version, floor, begun = None, 0, 0, False
        for batch in batches:
            applied, versions = [], []
            for k, w, d, e in zip(*(batch.column(n).to_pylist() for n in (0, 2, 3, 4)), strict=True):
                if not begun or k != last:
                    last, version, floor, begun = k, 0, e, True
                fits = w == version and e >= floor
                floor = max(floor, e) if fits else floor
                version = (0 if d else version + 1) if fits else version
                applied.append(fits)
                versions.append(version)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(applied, pa.bool_()), pa.array(versions, pa.int64())], names=[key, order, "applied", "version"])

    columns = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (key, order))
    return rows.mapInArrow(run, f"{columns}, applied boolean, version bigint")


def transact(store: DataFrame, writes: DataFrame, key: str) -> DataFrame:
    """key, applied, version, floor: one transaction over many keys, all or nothing.

    ``store``: key, version, floor (highest epoch written). ``writes``: key (once each), want, drop, epoch. All preconditions are checked,
    then all writes are applied: each wants the version there is (0: none) and is not below the key's floor. Keys that are not written keep their row; a
    deleted key keeps a row of version 0, as its floor outlives it.
    """
    both = store.select(key, "version", "floor").join(writes.select(key, "want", "drop", "epoch", F.lit(True).alias("_w")), key, "full")
    now, floor = F.coalesce("version", F.lit(0)), F.coalesce("floor", F.col("epoch"))
    fits = F.coalesce((F.col("want") == now) & (F.col("epoch") >= floor), F.lit(False))
    agreed = F.coalesce(both.where("_w").agg(F.bool_and(fits)).scalar(), F.lit(False))
    applied = agreed & F.col("_w").isNotNull()
    version = F.when(applied, F.when(F.col("drop"), 0).otherwise(now + 1)).otherwise(F.col("version"))
    out = both.select(key, applied.alias("applied"), version.cast("bigint").alias("version"), F.when(applied, F.greatest(floor, "epoch")).otherwise(F.col("floor")).alias("floor"))
    return out.where("applied or version is not null")


def scoped(*parts: Column) -> Column:
    """A dedupe key in its scope: tenant, pipeline, source node, stream, layer and identity, escaped, so that no two scopes share a text."""
    return joined_path(*[p.cast("string") for p in parts])
