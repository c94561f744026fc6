"""Splitting, batching, shedding, token buckets, lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import flow
from .base import EVENTS, events, query

FOLD = """WITH RECURSIVE r AS (SELECT lane, seq, {weight} AS w, row_number() OVER (PARTITION BY lane ORDER BY seq) AS rn FROM {events}),
 f AS (SELECT lane, rn, seq, {init} FROM r WHERE rn = 1 UNION ALL SELECT r.lane, r.rn, r.seq, {step} FROM f JOIN r ON r.lane = f.lane AND r.rn = f.rn + 1)
 SELECT lane, seq, {out} FROM f"""


@query(f"SELECT lane, seq, chunk, chunk = max(chunk) OVER (PARTITION BY lane) AS carries_position FROM (SELECT lane, seq, (row_number() OVER (PARTITION BY lane ORDER BY seq) - 1) // 500 AS chunk FROM {EVENTS})")
def split_records(spark, sf_dir):
    return flow.split_records(events(spark, sf_dir), ["lane"], "seq", 500).select("lane", "seq", "chunk", "carries_position")


@query(FOLD.format(events=EVENTS, weight="length(body) * (1 + seq % 13)", init="w AS used, 0::BIGINT AS chunk", step="CASE WHEN f.used + r.w <= 400 THEN f.used + r.w ELSE r.w END, CASE WHEN f.used + r.w <= 400 THEN f.chunk ELSE f.chunk + 1 END", out="chunk"))
def split_bytes(spark, sf_dir):
    return flow.split_bytes(events(spark, sf_dir), ["lane"], "seq", F.length("body") * (1 + F.col("seq") % 13), 400)


@query(FOLD.format(events=EVENTS, weight="1 + seq % 7", init="w AS used, 0::BIGINT AS round", step="CASE WHEN f.used + r.w <= 40 THEN f.used + r.w ELSE r.w END, CASE WHEN f.used + r.w <= 40 THEN f.round ELSE f.round + 1 END", out="round"))
def lane_budget(spark, sf_dir):
    return flow.admission_rounds(events(spark, sf_dir), ["lane"], "seq", 1 + F.col("seq") % 7, 40)


@query(FOLD.format(events=EVENTS, weight="length(body)", init="w AS used, 0::BIGINT AS batch", step="CASE WHEN f.used < 200 THEN f.used + r.w ELSE r.w END, CASE WHEN f.used < 200 THEN f.batch ELSE f.batch + 1 END", out="batch"))
def batch_bytes(spark, sf_dir):
    return flow.batch_bytes(events(spark, sf_dir), ["lane"], "seq", F.length("body"), 200)


@query(FOLD.format(events=EVENTS, weight="tm", init="w AS first, 0::BIGINT AS batch", step="CASE WHEN r.w - f.first <= 600000000 THEN f.first ELSE r.w END, CASE WHEN r.w - f.first <= 600000000 THEN f.batch ELSE f.batch + 1 END", out="batch"))
def batch_age(spark, sf_dir):
    return flow.batch_age(events(spark, sf_dir), ["lane"], "seq", F.col("tm"), 600_000_000)


@query(FOLD.format(events=EVENTS, weight="(seq // 4)::DOUBLE", init="4.0::DOUBLE AS tokens, w AS last", step="least(5.0, f.tokens + (r.w - f.last) * 0.5) - 1, r.w", out="CASE WHEN tokens < 0 THEN -tokens / 0.5 ELSE 0 END AS wait"))
def token_bucket(spark, sf_dir):
    return flow.token_bucket(events(spark, sf_dir), ["lane"], "seq", F.floor(F.col("seq") / 4), 0.5, 5.0)


@query(f"SELECT lane, seq, (row_number() OVER (PARTITION BY lane ORDER BY seq) - 1) // 100 AS batch FROM {EVENTS}")
def batch_count(spark, sf_dir):
    return flow.batch_count(events(spark, sf_dir), ["lane"], "seq", 100).select("lane", "seq", "batch")


@query(f"SELECT lane, seq, coalesce(sum(CASE WHEN stream = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY lane ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS batch FROM {EVENTS}")
def batch_flush_on(spark, sf_dir):
    return flow.batch_flush_on(events(spark, sf_dir), ["lane"], "seq", F.col("stream") == "purchase").select("lane", "seq", "batch")


@query(f"SELECT lane, seq, row_number() OVER (PARTITION BY lane ORDER BY seq) <= 100 AS admitted FROM {EVENTS}")
def shed_newest(spark, sf_dir):
    return flow.shed_newest(events(spark, sf_dir), ["lane"], "seq", 100).select("lane", "seq", "admitted")


@query(f"SELECT seq, n - 1 AS part, string_split(stream || ',' || lane, ',')[n] AS body_part, seq AS parent, seq AS root, 1 AS refs FROM {EVENTS}, (VALUES (1), (2)) v(n)")
def derive_lineage(spark, sf_dir):
    e = events(spark, sf_dir).select("seq", F.lit(None).cast("bigint").alias("root"), F.concat_ws(",", "stream", "lane").alias("body"))
    return flow.derive(e, F.split("body", ","), "seq").select("seq", "part", "body_part", "parent", "root", "refs")


@query(f"SELECT lane, g, sum(1 + seq % 3)::BIGINT AS refs, arg_min(stream, seq) AS dest, arg_min(tm, seq) AS tm, count(*) AS parents FROM (SELECT *, seq // 50 AS g FROM {EVENTS}) GROUP BY lane, g")
def merge_refs(spark, sf_dir):
    e = events(spark, sf_dir).select("lane", F.floor(F.col("seq") / 50).cast("bigint").alias("g"), "seq", (1 + F.col("seq") % 3).alias("refs"), F.col("stream").alias("dest"), "tm")
    return flow.merge(e, ["lane", "g"], "seq").select("lane", "g", "refs", "dest", "tm", F.size("parents").cast("bigint").alias("parents"))
