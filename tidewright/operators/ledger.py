"""Settlement: contiguous prefixes, committable positions, replay windows, acknowledgements, fences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def up_to(by: list[str], order: str):
    return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def before(by: list[str], order: str):
    return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def first_unresolved(df: DataFrame, by: list[str], order: str, resolved: Column) -> DataFrame:
    """by, _stop: the least order in each lane that is not resolved (null: all are); combined before the shuffle."""
    return df.groupBy(*by).agg(F.min(F.when(~F.coalesce(resolved, F.lit(False)), F.col(order))).alias("_stop"))


def with_prefix(df: DataFrame, by: list[str], order: str, resolved: Column) -> DataFrame:
    """in_prefix: the row and all before it in its lane are resolved (delivered, duplicate or abandoned). One row a lane is joined back."""
    out = df.join(first_unresolved(df, by, order, resolved), by)
    return out.withColumn("in_prefix", F.col("_stop").isNull() | (F.col(order) < F.col("_stop"))).drop("_stop")


def commit_position(df: DataFrame, by: list[str], order: str, resolved: Column, safe: Column) -> DataFrame:
    """Per lane the end of the resolved prefix, and the last safe position at or before it (null where there is none): aggregates only."""
    p = with_prefix(df, by, order, resolved)
    return p.groupBy(*by).agg(F.max(F.when(F.col("in_prefix"), F.col(order))).alias("resolved_to"), F.max(F.when(F.col("in_prefix") & safe, F.col(order))).alias("commit_to"))


def replay_window(df: DataFrame, by: list[str], order: str, resolved: Column, safe: Column) -> DataFrame:
    """Per lane how many admitted records lie after the last committable position."""
    at = commit_position(df, by, order, resolved, safe)
    return df.join(at, by).groupBy(*by).agg(F.count_if(F.col("commit_to").isNull() | (F.col(order) > F.col("commit_to"))).alias("replay"))


def settle_each(df: DataFrame, outcome: Column) -> DataFrame:
    """Discrete acknowledgement: the records that have ended, with ``outcome``, whatever stands before them; nothing is gathered."""
    return df.withColumn("outcome", outcome).where(F.col("outcome").isNotNull())


def idle_lanes(df: DataFrame, by: list[str], at: str, timeout: int) -> DataFrame:
    """by, idle: the lane's last record came ``timeout`` or more before the newest of all lanes."""
    last = df.groupBy(*by).agg(F.max(at).alias("_last"))
    return last.select(*by, (last.agg(F.max("_last")).scalar() - F.col("_last") >= timeout).alias("idle"))


def latest(df: DataFrame, key: list[str], order: str, gone: Column, *columns: str) -> DataFrame:
    """Compaction: of each key the last entry, unless it is a deletion; combined before the shuffle."""
    last = df.groupBy(*key).agg(F.max_by(F.struct(gone.alias("_gone"), *columns), order).alias("_x"), F.max(order).alias("version"))
    return last.where(~F.col("_x._gone")).select(*key, *[F.col(f"_x.{c}") for c in columns], "version")


def monotone_commits(df: DataFrame, by: list[str], step: str, seq: str, order_key: str) -> DataFrame:
    """flushes: a commit is written only if both its sequence and (where comparable) its order passed all earlier ones."""
    w = before(by, step)
    passed = lambda c: F.coalesce(F.col(c) > F.max(c).over(w), F.lit(True))
    return df.withColumn("flushes", passed(seq) & passed(order_key))


def coalesce_idle(df: DataFrame, by: list[str], order: str, idle: Column) -> DataFrame:
    """Runs of record-less positions as one row each (first, last, positions); other positions stay single."""
    w = Window.partitionBy(*by).orderBy(order)
    opens = F.when(idle & F.coalesce(F.lag(idle).over(w), F.lit(False)), 0).otherwise(1)
    runs = df.withColumn("_new", opens).withColumn("run", F.sum("_new").over(up_to(by, order)))
    return runs.groupBy(*by, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("positions")).drop("run")


def fence(df: DataFrame, key: list[str], order: str, epoch: str, batch: list[str]) -> DataFrame:
    """rejected: the row's batch holds a key whose epoch is below the highest seen before for it."""
    stale = F.coalesce(F.col(epoch) < F.max(epoch).over(before(key, order)), F.lit(False))
    return df.withColumn("_stale", stale).withColumn("rejected", F.bool_or("_stale").over(Window.partitionBy(*batch))).drop("_stale")


def spin_faults(df: DataFrame, by: list[str], order: str, progress: Column) -> DataFrame:
    """fault: the second or later read in a row that brings no record, no position and no end."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("_p", progress).withColumn("fault", ~F.col("_p") & F.coalesce(~F.lag("_p").over(w), F.lit(False))).drop("_p")
