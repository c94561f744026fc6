"""From chunked snapshots to streams: chunk plans, backfill, tail verdicts, lane gating, polling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import last_mark, span_of
from .modes import last_per_key


def chunk_plan(keys: DataFrame, key: str, rows: int, width: int | None = None) -> DataFrame:
    """ord, lo (inclusive), hi (exclusive, null: open), est: a boundary every ``rows`` keys.

    Keys are dealt to spans of ``width`` (64 chunks of dense keys, if not given) and numbered inside them; sizes of spans are summed first, one
    row a span, so no single task sorts the table. What a key's number is depends on keys alone, not on how they are partitioned.
    """
    spanned = keys.select(key).withColumn("_s", span_of(keys, key, width or 64 * rows))
    sizes = spanned.groupBy("_s").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_s", F.coalesce(F.sum("_n").over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    local = spanned.withColumn("_r", F.row_number().over(Window.partitionBy("_s").orderBy(key)))
    ranked = local.join(starts, "_s").withColumn("ord", F.floor((F.col("_before") + F.col("_r") - 1) / rows).cast("bigint"))
    chunks = ranked.groupBy("ord").agg(F.min(key).alias("lo"), F.count(F.lit(1)).alias("est"))
    following = chunks.select((F.col("ord") - 1).alias("ord"), F.col("lo").alias("hi"))
    return chunks.join(following, "ord", "left").select("ord", "lo", "hi", "est")


def backfill(snapshot: DataFrame, changes: DataFrame, key: str, low: int, high: int, pos: str = "pos") -> DataFrame:
    """Snapshot rows of one chunk whose key did not change within (low, high]."""
    return snapshot.join(changes.where((F.col(pos) > low) & (F.col(pos) <= high)).select(key).distinct(), key, "left_anti")


def in_chunk(rows: DataFrame, chunks: DataFrame, key: str, *columns: str) -> DataFrame:
    """``rows`` with ``_in``, a struct of lo, hi and ``columns`` of the chunk that holds the key; null where none does. Chunks do not overlap."""
    marks = chunks.select(F.col("lo").alias(key), F.struct("lo", "hi", *columns).alias("_in"))
    held = last_mark(rows, marks, [], key, "_in")
    inside = F.col("_in").isNotNull() & (F.col("_in.hi").isNull() | (F.col(key) < F.col("_in.hi")))
    return held.withColumn("_in", F.when(inside, F.col("_in")))


def backfill_chunks(snapshot: DataFrame, changes: DataFrame, chunks: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """Snapshot rows of all chunks (lo, hi, low, high) whose key did not change within its own chunk's marks (low, high]."""
    placed = in_chunk(snapshot, chunks, key, "low", "high").where("_in is not null")
    changed = in_chunk(changes.select(key, pos), chunks, key, "low", "high").where((F.col(pos) > F.col("_in.low")) & (F.col(pos) <= F.col("_in.high")))
    return placed.join(changed.select(key).distinct(), key, "left_anti").drop("_in")


def tail_verdict(changes: DataFrame, chunks: DataFrame, key: str, pos: str, planned: Column) -> DataFrame:
    """verdict of each change by the chunk that holds its key: wait (no high mark yet), emit (after it), drop; outside all chunks ``planned``
    says whether to emit."""
    held = in_chunk(changes, chunks, key, "high")
    inside = F.col("_in").isNotNull()
    verdict = F.when(inside & (F.col("_in.high") == 0), "wait").when(inside, F.when(F.col(pos) > F.col("_in.high"), "emit").otherwise("drop")).when(planned, "emit").otherwise("drop")
    return held.select(*changes.columns, verdict.alias("verdict"))


def gated(lanes: DataFrame) -> DataFrame:
    """lanes (id, group, after array, finished, finished_at) with readable: every lane of every group in ``after`` has finished and says when.

    A group without members gates nothing.
    """
    waits = lanes.select("id", F.explode("after").alias("g")).join(
        lanes.where(~(F.col("finished") & F.col("finished_at").isNotNull())).select(F.col("group").alias("g")).distinct(), "g", "left_semi"
    )
    return lanes.join(waits.select("id").distinct().withColumn("_w", F.lit(True)), "id", "left").withColumn("readable", F.col("_w").isNull()).drop("_w")


def lane_partition(index: Column, lanes: Column, workers: int) -> Column:
    """The worker of lane number ``index``: worker i has the lanes from i*L/n up to (i+1)*L/n, rounded down."""
    return F.floor(((index + 1) * workers - 1) / lanes).cast("bigint")


def next_watermark(rows: DataFrame, updated: str, old: Column, start: Column, lag: int, second: int = 1_000_000) -> DataFrame:
    """One row: watermark = max(old, min(max(updated), start - lag)), floored to the second."""
    top = rows.agg(F.max(updated).alias("m"))
    return top.select((F.floor(F.greatest(old, F.least(F.coalesce("m", old), start - lag)) / second) * second).cast("bigint").alias("watermark"))


def shadow(scan: DataFrame, stream: DataFrame, key: str) -> DataFrame:
    """Scan rows without those whose key the stream has brought before the scan read them."""
    seen = stream.groupBy(key).agg(F.min("seq").alias("_first"))
    return scan.join(seen, key, "left").where(F.col("_first").isNull() | (F.col("_first") > F.col("seq"))).drop("_first")


def poll_from(watermark: Column, now: Column, overlap: int) -> Column:
    """Where a poll begins: the overlap before the watermark, or before now where there is none yet (a cold start)."""
    return F.coalesce(watermark, now) - overlap


def poll(rows: DataFrame, key: str, updated: str, since: Column, watermark: Column, pinned: DataFrame | None = None) -> DataFrame:
    """Rows that a changed-since poll gives: not older than ``since`` and not pinned, that is seen in the overlap before."""
    out = rows.where(F.col(updated) >= since)
    if pinned is None:
        return out
    seen = out.join(pinned.select(key), key, "left_semi").where(F.col(updated) < watermark)
    return out.join(seen.select(key), key, "left_anti")


def pin(rows: DataFrame, key: str, updated: str, watermark: Column, overlap: int, most: int) -> DataFrame:
    """The ids to pin for the next poll, with ``overflow``: over ``most`` of them none are kept and the flag is set on the one row there is."""
    ids = rows.where(F.col(updated) >= watermark - overlap).select(F.col(key).alias("id")).distinct()
    count = ids.agg(F.count(F.lit(1))).scalar()
    kept = ids.where(count <= most).select("id", F.lit(False).alias("overflow"))
    flag = rows.sparkSession.range(1).where(count > most).select(F.lit(None).cast(ids.schema["id"].dataType).alias("id"), F.lit(True).alias("overflow"))
    return kept.unionByName(flag)


def catalog_diff(known: DataFrame, live: DataFrame, name: str) -> DataFrame:
    """name, action: streams that are new are announced, those that went are retired, the others kept."""
    both = known.select(name, F.lit(True).alias("_known")).join(live.select(name, F.lit(True).alias("_live")), name, "full")
    return both.select(name, F.when(F.col("_known").isNull(), "announce").when(F.col("_live").isNull(), "retire").otherwise("keep").alias("action"))


def read_mode(rows: DataFrame, mode: str, key: list[str], cursor: str, since: Column) -> DataFrame:
    """full_refresh: all rows; incremental: those past the cursor; append_dedup: of those past the cursor the last of each key."""
    if mode == "full_refresh":
        return rows
    new = rows.where(since.isNull() | (F.col(cursor) > since))
    if mode == "incremental":
        return new
    if mode == "append_dedup":
        return last_per_key(new, key, cursor).select(*rows.columns)
    raise ValueError(f"unknown mode {mode!r}; there are full_refresh, incremental, append_dedup")


def change_op(scanned: Column, deleted: Column, updated: Column) -> Column:
    return F.when(scanned, "scan_read").when(deleted, "delete").when(updated, "update").otherwise("insert")


def rescale(lanes: DataFrame, shard: Column, cursor: str) -> DataFrame:
    """shard, floor_: a new generation of a sharded log starts from the least cursor of its parents."""
    return lanes.groupBy(shard.alias("shard")).agg(F.min(cursor).alias("floor_"))


def letter_bounds(shards: int) -> list[str]:
    """Lower bounds of ``shards`` chunks of the alphabet; the first is open."""
    return ["", *(chr(ord("a") + 26 * n // shards) for n in range(1, shards))]


def variant_kind(attribute: Column, names: dict[str, str]) -> Column:
    """The kind of a VARIANT, under the names that a source's own type system has for it."""
    kind = F.regexp_extract(F.schema_of_variant(attribute), "^[A-Z]+", 0)
    return F.coalesce(F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[kind], kind)


def announce(lanes: DataFrame, found: DataFrame, key: str = "id") -> DataFrame:
    """Lanes with those found that are not among them yet; announcing again changes nothing."""
    new = found.dropDuplicates([key]).join(lanes.select(key), key, "left_anti")
    return lanes.unionByName(new, allowMissingColumns=True)


def finish(lanes: DataFrame, ended: DataFrame, key: str = "id") -> DataFrame:
    """Lanes with those of ``ended`` (key, finished_at) finished; one that has finished keeps when it did."""
    out = lanes.join(ended.select(key, F.col("finished_at").alias("_at")), key, "left")
    at = F.coalesce("finished_at", "_at")
    return out.withColumn("finished", F.col("finished") | F.col("_at").isNotNull()).withColumn("finished_at", at).drop("_at").select(*lanes.columns)


def forget(lanes: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return lanes.join(gone.select(key), key, "left_anti")


def assigned(lanes: DataFrame) -> DataFrame:
    """Lanes that a worker holds, that may be read and are not finished."""
    return gated(lanes).where("not finished and held and readable")


def polled(lanes: DataFrame, index: str, lanes_in_all: int, start: int, most: int) -> DataFrame:
    """The lanes whose backlog is asked for at a tick: ``most`` of them, round robin from where the last tick stopped."""
    return lanes.where((F.col(index) + (lanes_in_all - start)) % lanes_in_all < most)


def replan(old: DataFrame, new: DataFrame, lane: str = "lane", worker: str = "worker") -> DataFrame:
    """lane, plan, worker: lanes that left the plan are withdrawn, new ones wait for a worker, those kept stay where they are."""
    both = old.select(lane, worker, F.lit(True).alias("_was")).join(new.select(lane, F.lit(True).alias("_is")), lane, "full")
    plan = F.when(F.col("_is").isNull(), "withdrawn").when(F.col("_was").isNull(), "new").otherwise("kept")
    return both.select(lane, plan.alias("plan"), F.when(plan == "kept", F.col(worker)).alias(worker))


def claimable(gated: Column, finished: Column, held: Column, own: Column, expires: Column, now: Column, grace: int = 120) -> Column:
    """A lane may be claimed if nothing gates it, it is not finished, and nobody else holds a lease that has not run out, grace added."""
    return ~gated & ~finished & (~held | own | (expires + grace < now))
