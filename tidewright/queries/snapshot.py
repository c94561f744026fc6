"""Snapshots, tails, lanes, polling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import snapshot as S
from .base import EVENTS, events, query, table


def orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_totalprice", "o_orderstatus")


CHUNKS = "(SELECT ord, lo, lead(lo) OVER (ORDER BY ord) AS hi, est FROM (SELECT (rn - 1) // 700 AS ord, min(k) AS lo, count(*) AS est FROM (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) GROUP BY 1))"


@query(f"SELECT * FROM {CHUNKS}")
def chunk_plan(spark, sf_dir):
    return S.chunk_plan(orders(spark, sf_dir), "k", 700)


@query(f"""SELECT k FROM (SELECT o_orderkey AS k FROM orders) JOIN {CHUNKS} ON k >= lo AND (hi IS NULL OR k < hi) WHERE NOT (k % 9 = 0 AND k > lo + 100 AND k <= lo + 400)""")
def chunk_backfill(spark, sf_dir):
    o = orders(spark, sf_dir)
    changes = o.where("k % 9 = 0").select("k", F.col("k").alias("pos"))
    chunks = S.chunk_plan(o, "k", 700).withColumn("low", F.col("lo") + 100).withColumn("high", F.col("lo") + 400)
    return S.backfill_chunks(o, changes, chunks, "k").select("k")


MARKED = f"(SELECT *, CASE WHEN ord % 3 = 0 THEN 0 ELSE lo + 300 END AS high FROM {CHUNKS} WHERE ord % 4 <> 2)"


@query(f"""SELECT k, CASE WHEN c.lo IS NOT NULL AND high = 0 THEN 'wait' WHEN c.lo IS NOT NULL THEN CASE WHEN k > high THEN 'emit' ELSE 'drop' END WHEN k % 2 = 0 THEN 'emit' ELSE 'drop' END AS verdict
 FROM (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 9 = 0) LEFT JOIN {MARKED} c ON k >= c.lo AND (c.hi IS NULL OR k < c.hi)""")
def tail_verdict(spark, sf_dir):
    chunks = S.chunk_plan(orders(spark, sf_dir), "k", 700).where("ord % 4 <> 2")
    chunks = chunks.withColumn("high", F.when(F.col("ord") % 3 == 0, F.lit(0)).otherwise(F.col("lo") + 300))
    changes = orders(spark, sf_dir).where("k % 9 = 0").select("k", F.col("k").alias("pos"))
    return S.tail_verdict(changes, chunks, "k", "pos", F.col("k") % 2 == 0).select("k", "verdict")


@query("SELECT min(c) AS floor_, substr(name, 1, 1) AS shard FROM (SELECT n_name AS name, n_nationkey * 10 AS c FROM nation) GROUP BY 2")
def rescale_floor(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumn("cursor", F.col("n_nationkey") * 10)
    return S.rescale(n, F.substring("n_name", 1, 1), "cursor")


def lanes(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select(
        F.col("n_nationkey").alias("id"), F.concat(F.lit("g"), F.col("n_regionkey")).alias("group"), (F.col("n_nationkey") % 3 != 0).alias("finished"),
        F.when(F.col("n_nationkey") % 5 != 1, F.col("n_nationkey").cast("bigint")).alias("finished_at"),
        F.when(F.col("n_nationkey") % 4 == 0, F.array()).when(F.col("n_nationkey") % 4 == 1, F.array(F.lit("g9"))).otherwise(F.array(F.lit("g0"), F.concat(F.lit("g"), F.col("n_regionkey")))).cast("array<string>").alias("after"),
        (F.col("n_nationkey") % 7 == 0).alias("held"),
    )


LANES = """(SELECT n_nationkey AS id, 'g' || n_regionkey AS grp, n_nationkey % 3 <> 0 AS finished, CASE WHEN n_nationkey % 5 <> 1 THEN n_nationkey END AS finished_at, n_nationkey % 7 = 0 AS held,
 CASE WHEN n_nationkey % 4 = 0 THEN [] WHEN n_nationkey % 4 = 1 THEN ['g9'] ELSE ['g0', 'g' || n_regionkey] END AS waits FROM nation)"""
READABLE = f"NOT EXISTS (SELECT 1 FROM {LANES} o WHERE list_contains(l.waits, o.grp) AND NOT (o.finished AND o.finished_at IS NOT NULL))"


@query(f"SELECT id, {READABLE} AS readable FROM {LANES} l")
def lane_gating(spark, sf_dir):
    return S.gated(lanes(spark, sf_dir)).select("id", "readable")


@query(f"SELECT id FROM {LANES} l WHERE NOT finished AND held AND {READABLE}")
def lane_assigned(spark, sf_dir):
    return S.assigned(lanes(spark, sf_dir)).select("id")


@query(f"SELECT id, grp AS \"group\", finished FROM {LANES} WHERE grp = 'g1' AND id > 1 ORDER BY id LIMIT 3")
def lane_table(spark, sf_dir):
    from ..operators.status import page

    return page(lanes(spark, sf_dir).where(F.col("group") == "g1"), "id", F.lit(1), 3).select("id", "group", "finished")


@query("SELECT n_nationkey AS id, ((n_nationkey + 1) * 4 - 1) // 25 AS worker FROM nation")
def lane_partition(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), S.lane_partition(F.col("n_nationkey"), F.lit(25), 4).alias("worker"))


@query("SELECT id FROM (SELECT n_nationkey AS id, (n_nationkey + 20) % 25 AS turn FROM nation) WHERE turn < 8")
def backlog_poll(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"))
    return S.polled(n, "id", 25, 5, 8)


@query(f"SELECT (greatest(0, least(max(tm), (SELECT min(tm) + 86400000000 FROM {EVENTS}) - 60000000)) // 1000000) * 1000000 AS watermark FROM {EVENTS}")
def poll_watermark(spark, sf_dir):
    e = events(spark, sf_dir)
    start = F.coalesce(e.agg(F.min("tm")).scalar(), F.lit(0))
    return S.next_watermark(e, "tm", F.lit(0), start + 86_400_000_000, 60_000_000)


@query(f"""SELECT seq FROM {EVENTS} e, (SELECT min(tm) + 43200000000 AS w FROM {EVENTS}) WHERE tm >= w - 3600000000 AND NOT (tm < w AND seq % 2 = 0)""")
def poll_dedupe(spark, sf_dir):
    e = events(spark, sf_dir)
    w = F.coalesce(e.agg(F.min("tm")).scalar(), F.lit(0)) + 43_200_000_000
    pinned = e.where((F.col("tm") >= w - 3_600_000_000) & (F.col("seq") % 2 == 0)).select("seq")
    return S.poll(e, "seq", "tm", S.poll_from(w, F.lit(0), 3_600_000_000), w, pinned).select("seq")


@query(f"""SELECT 'full' AS how, count(*) AS n, max(seq) AS top FROM {EVENTS} UNION ALL SELECT 'since', count(*), max(seq) FROM {EVENTS} WHERE seq > 300
 UNION ALL SELECT 'dedup', count(*), max(top) FROM (SELECT key, max(seq) AS top FROM {EVENTS} WHERE seq > 300 GROUP BY key)""")
def read_modes(spark, sf_dir):
    e = events(spark, sf_dir).select("key", "seq", "value")
    told = lambda how, mode: S.read_mode(e, mode, ["key"], "seq", F.lit(300)).agg(F.count("*").alias("n"), F.max("seq").alias("top")).select(F.lit(how).alias("how"), "n", "top")
    return told("full", "full_refresh").unionByName(told("since", "incremental")).unionByName(told("dedup", "append_dedup"))


@query(f"SELECT seq AS id, false AS overflow FROM {EVENTS} WHERE tm >= (SELECT max(tm) - 7200000000 FROM {EVENTS})")
def poll_pins(spark, sf_dir):
    e = events(spark, sf_dir)
    return S.pin(e, "seq", "tm", e.agg(F.max("tm")).scalar(), 7_200_000_000, 1 << 40)


@query("""SELECT coalesce(a.n_name, b.n_name) AS stream, CASE WHEN a.n_name IS NULL THEN 'announce' WHEN b.n_name IS NULL THEN 'retire' ELSE 'keep' END AS action
 FROM (SELECT n_name FROM nation WHERE n_nationkey % 3 <> 0) a FULL JOIN (SELECT n_name FROM nation WHERE n_nationkey % 4 <> 0) b ON a.n_name = b.n_name""")
def catalog_diff(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    names = lambda which: n.where(which).select(F.col("n_name").alias("stream"))
    return S.catalog_diff(names("n_nationkey % 3 <> 0"), names("n_nationkey % 4 <> 0"), "stream")


@query(f"SELECT seq, CASE WHEN lane = 0 THEN 'scan_read' WHEN seq % 97 = 0 THEN 'delete' WHEN seq % 3 = 0 THEN 'update' ELSE 'insert' END AS op FROM {EVENTS}")
def change_op(spark, sf_dir):
    op = S.change_op(F.col("lane") == 0, F.col("seq") % 97 == 0, F.col("seq") % 3 == 0)
    return events(spark, sf_dir).select("seq", op.alias("op"))


@query(f"SELECT s.seq, s.key FROM (SELECT seq, key FROM {EVENTS} WHERE lane < 4) s LEFT JOIN (SELECT key, min(seq) AS f FROM {EVENTS} WHERE stream = 'purchase' GROUP BY key) t USING (key) WHERE f IS NULL OR f > s.seq")
def shadow(spark, sf_dir):
    e = events(spark, sf_dir)
    return S.shadow(e.where("lane < 4").select("seq", "key"), e.where("stream = 'purchase'").select("seq", "key"), "key")


@query("SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'VARCHAR' WHEN 1 THEN 'UBIGINT' ELSE 'OBJECT' END AS kind FROM orders")
def drift_program(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    attr = F.when(F.col("id") % 3 == 0, F.lit('"text"')).when(F.col("id") % 3 == 1, F.lit("5")).otherwise(F.lit('{"a": 1}'))
    return o.select("id", S.variant_kind(F.parse_json(attr), {"STRING": "VARCHAR", "BIGINT": "UBIGINT"}).alias("kind"))


@query("SELECT id, NOT gated AND NOT finished AND (NOT held OR own OR expired) AS claimable FROM (SELECT n_nationkey AS id, n_nationkey % 4 = 3 AS gated, n_nationkey % 3 = 1 AS finished, n_nationkey % 2 = 0 AS held, n_nationkey % 5 = 0 AS own, n_nationkey * 20 + 120 < 400 AS expired FROM nation)")
def claimable(spark, sf_dir):
    i = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(i.alias("id"), S.claimable(i % 4 == 3, i % 3 == 1, i % 2 == 0, i % 5 == 0, i * 20, F.lit(400)).alias("claimable"))


@query("SELECT n_name AS lane, CASE WHEN n_nationkey % 3 = 0 THEN 'withdrawn' WHEN n_nationkey % 4 = 0 THEN 'new' ELSE 'kept' END AS plan, CASE WHEN n_nationkey % 3 <> 0 AND n_nationkey % 4 <> 0 THEN n_regionkey END AS worker FROM nation")
def replan_diff(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    old = n.where("n_nationkey % 3 = 0 or n_nationkey % 4 <> 0").select(F.col("n_name").alias("lane"), F.col("n_regionkey").alias("worker"))
    return S.replan(old, n.where("n_nationkey % 3 <> 0").select(F.col("n_name").alias("lane")))
