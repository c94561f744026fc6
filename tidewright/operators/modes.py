"""Write modes, typed and epoch gates, commits, partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import utc


def last_per_key(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key; combined before the shuffle, so a hot key costs one row a task."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*key, "_r.*")


def append(target: DataFrame, changes: DataFrame) -> DataFrame:
    return target.unionByName(changes)


def upsert(target: DataFrame, changes: DataFrame, key: list[str], order: str, partial: bool = False) -> DataFrame:
    """Insert, update and upsert alike: the last change of a key replaces its row; with ``partial`` nulls in it keep the old value."""
    new = last_per_key(changes, key, order).drop(order)
    if not partial:
        return target.join(new.select(*key), key, "left_anti").unionByName(new)
    rest = [c for c in target.columns if c not in key]
    both = target.select(*key, F.struct(*rest).alias("_o")).join(new.select(*key, F.struct(*rest).alias("_n")), key, "full")
    return both.select(*key, *[F.coalesce(F.col(f"_n.{c}"), F.col(f"_o.{c}")).alias(c) for c in rest])


def delete(target: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return target.join(keys.select(*key).distinct(), key, "left_anti")


def overwrite(target: DataFrame, changes: DataFrame) -> DataFrame:
    return changes.select(*target.columns)


def type_fault(value: Column, permitted: set[str], nullable: bool) -> Column:
    """Why a VARIANT does not fit a field: its kind is not permitted, or it is null or absent where it must not be. Null: it fits."""
    kind = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    missing = value.isNull() | F.coalesce(F.is_variant_null(value), F.lit(False))
    allowed = permitted | ({"BIGINT"} if "DECIMAL" in permitted else set())
    return F.when(missing, F.lit(None if nullable else "permanent_mapping").cast("string")).when(~kind.isin(*sorted(allowed)), F.lit("permanent_mapping"))


def epoch_fault(rows: DataFrame, applied: DataFrame, by: str) -> DataFrame:
    """fault where a row's schema epoch is newer than what the sink has applied to its stream (none applied: 0)."""
    out = rows.join(applied.select(by, F.col("epoch").alias("_applied")), by, "left")
    return out.withColumn("fault", F.when(F.col("epoch") > F.coalesce("_applied", F.lit(0)), F.lit("permanent_contract"))).drop("_applied")


def subsume(commits: DataFrame, upload: str, checkpoint: str) -> DataFrame:
    """Of each upload's committables the newest; older checkpoints are contained in it."""
    top = commits.groupBy(upload).agg(F.max(checkpoint).alias("_top"))
    return commits.join(top, upload).withColumn("outcome", F.when(F.col(checkpoint) == F.col("_top"), "committed").otherwise("already_committed")).drop("_top")


def seal(size: Column, age: Column, final: Column, least: int, oldest: int) -> Column:
    return (size >= least) | final | (age >= oldest)


def day_partition(dest: Column, event_micros: Column, read_micros: Column) -> Column:
    """dest/YYYY-MM-DD of the UTC event time, else of the read time."""
    day = utc(F.coalesce(event_micros, read_micros)).cast("date").cast("string")
    return F.concat_ws("/", dest, day)


def oversize_requests(df: DataFrame, request: list[str], size: Column, most: int) -> DataFrame:
    """fault: every record's of a request whose mean size is above ``most``."""
    return df.withColumn("fault", F.when(F.avg(size).over(Window.partitionBy(*request)) > most, F.lit("permanent_mapping")))


def by_destination(df: DataFrame, dest: str, order: str) -> DataFrame:
    """One request for each destination: how many records, and the first."""
    return df.groupBy(F.col(dest).alias("dest")).agg(F.count(F.lit(1)).alias("records"), F.min(order).alias("first"))


def staged_requests(df: DataFrame, request: str, published: DataFrame) -> DataFrame:
    """request, written, duplicates: all records of a request whose key is published already are duplicates, and still count as written."""
    counts = df.groupBy(request).agg(F.count(F.lit(1)).alias("written"))
    known = published.select(request).distinct().withColumn("_seen", F.lit(True))
    return counts.join(known, request, "left").select(request, "written", F.when(F.col("_seen"), F.col("written")).otherwise(F.lit(0)).cast("bigint").alias("duplicates"))


def merge_committable(df: DataFrame, by: list[str], checkpoint: Column) -> DataFrame:
    """by, records, checkpoint: one committable for a checkpoint, which covers every lane seen."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("records"), F.max(checkpoint).alias("checkpoint"))


def resolve_commits(committables: DataFrame, published: DataFrame, staged: DataFrame, upload: str, checkpoint: str, name: str) -> DataFrame:
    """outcome of each committable (upload, checkpoint, name of what was staged): an older checkpoint is contained in the newest; a name that is
    published needs nothing; one that is staged is committed; one that is neither, having been lost, is a dead letter."""
    out = subsume(committables, upload, checkpoint).withColumnRenamed("outcome", "_o")
    for table, flag in ((published, "_published"), (staged, "_staged")):
        out = out.join(table.select(name).distinct().withColumn(flag, F.lit(True)), name, "left")
    fate = F.when((F.col("_o") == "already_committed") | F.col("_published"), "already_committed").when(F.col("_staged"), "committed").otherwise("dead_letter")
    return out.withColumn("outcome", fate).drop("_o", "_published", "_staged")
