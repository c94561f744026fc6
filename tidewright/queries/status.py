"""The read model and negotiation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import status as S
from .base import EVENTS, events, query, table


def lane_table(spark, sf_dir):
    n, i = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    return n.select(
        i.alias("id"), F.concat(F.lit("s"), F.col("n_regionkey")).alias("stream"), (i * 10).cast("bigint").alias("records"), F.when((i % 6 != 0) | (F.col("n_regionkey") > 2), (i + 1).cast("bigint")).alias("backlog"),
        (i % 4 == 0).alias("finished"), (i % 5 == 0).alias("blocked"), (i * 3).cast("bigint").alias("age"), (i % 7 + 1).cast("bigint").alias("weight"),
    )


L = """(SELECT n_nationkey AS id, 's' || n_regionkey AS stream, n_nationkey * 10 AS records, CASE WHEN n_nationkey % 6 <> 0 OR n_regionkey > 2 THEN n_nationkey + 1 END AS backlog,
 n_nationkey % 4 = 0 AS finished, n_nationkey % 5 = 0 AS blocked, n_nationkey * 3 AS age, n_nationkey % 7 + 1 AS weight FROM nation)"""


@query(f"SELECT stream, sum(records)::BIGINT AS records, max(age)::BIGINT AS age, count(*) FILTER (WHERE finished) AS finished, count(*) FILTER (WHERE blocked) AS blocked, count(*) AS lanes FROM {L} GROUP BY stream")
def stream_rollup(spark, sf_dir):
    return S.stream_rollup(lane_table(spark, sf_dir))


@query(f"SELECT stream, CASE WHEN count(backlog) = count(*) THEN sum(backlog)::BIGINT END AS backlog, bool_and(backlog IS NOT NULL) AS exact, min(age)::BIGINT AS as_of FROM {L} GROUP BY stream")
def backlog_rollup(spark, sf_dir):
    return S.backlog(lane_table(spark, sf_dir), ["stream"])


@query(f"SELECT node, count(id) AS lanes, sum(records)::BIGINT AS records FROM (VALUES ('s0'), ('s1'), ('idle')) v(node) LEFT JOIN {L} ON stream = node GROUP BY node")
def node_rollup(spark, sf_dir):
    spec = spark.createDataFrame([("s0",), ("s1",), ("idle",)], "node string")
    return S.node_rollup(spec, lane_table(spark, sf_dir).withColumnRenamed("stream", "node"))


@query(f"SELECT stream, CASE WHEN count(*) FILTER (WHERE weight = 1) = 0 THEN coalesce(sum(weight) FILTER (WHERE finished), 0) * 1.0 / sum(weight) END AS progress FROM {L} GROUP BY stream")
def scan_progress(spark, sf_dir):
    t = lane_table(spark, sf_dir).withColumn("weight", F.col("weight") - F.when(F.col("weight") == 1, 1).otherwise(0))  # weight 0: not known
    return S.scan_progress(t, ["stream"])


@query(f"""SELECT lane, t_ms, total, CASE WHEN t_ms - lag(t_ms) OVER w >= 500 THEN (total - lag(total) OVER w) * 1.0 / (t_ms - lag(t_ms) OVER w) END AS per_ms
 FROM (SELECT lane, max(tm) // 1000 AS t_ms, max(seq) AS total FROM {EVENTS} GROUP BY lane, seq // 100) WINDOW w AS (PARTITION BY lane ORDER BY t_ms)""")
def throughput(spark, sf_dir):
    s = events(spark, sf_dir).groupBy("lane", F.floor(F.col("seq") / 100).alias("step")).agg(F.floor(F.max("tm") / 1000).alias("t_ms"), F.max("seq").alias("total"))
    return S.throughput(s.drop("step"), ["lane"], "t_ms", "total")


@query(f"SELECT lane, count(*) - count(*) FILTER (WHERE seq % 11 NOT IN (3, 7)) - count(*) FILTER (WHERE seq % 11 = 3) AS delta FROM {EVENTS} GROUP BY lane")
def reconcile_delta(spark, sf_dir):
    n = F.col("seq") % 11
    return S.reconcile_delta(events(spark, sf_dir), ["lane"], ~n.isin(3, 7), n == 3)


@query(f"SELECT stream, CASE WHEN lane < 4 THEN 'a' ELSE 'b' END AS node, count(*) AS total FROM {EVENTS} GROUP BY ALL")
def metric_counters(spark, sf_dir):
    return S.counters(events(spark, sf_dir), {"stream": F.col("stream"), "node": F.when(F.col("lane") < 4, "a").otherwise("b")})


@query(f"SELECT stream, le, CASE le WHEN '+Inf' THEN count(value) ELSE count(*) FILTER (WHERE value <= try_cast(le AS DOUBLE)) END AS n FROM {EVENTS}, (VALUES ('1.0'), ('10.0'), ('50.0'), ('+Inf')) b(le) GROUP BY stream, le")
def histogram(spark, sf_dir):
    return S.histogram(events(spark, sf_dir), ["stream"], "value", [1.0, 10.0, 50.0])


@query(f"SELECT lane, CASE WHEN count(*) FILTER (WHERE seq % 11 <> 3) = 0 THEN 'unknown' WHEN (SELECT max(tm) FROM {EVENTS}) - max(tm) FILTER (WHERE seq % 5 = 0) <= 3000000000 THEN 'true' ELSE 'false' END AS progressing FROM {EVENTS} GROUP BY lane")
def condition_progressing(spark, sf_dir):
    e = events(spark, sf_dir)
    g = e.groupBy("lane").agg(F.count_if(F.col("seq") % 11 != 3).alias("seen"), F.max(F.when(F.col("seq") % 5 == 0, F.col("tm"))).alias("durable"))
    recent = F.coalesce(F.col("top") - F.col("durable") <= 3_000_000_000, F.lit(False))
    return g.withColumn("top", e.agg(F.max("tm")).scalar()).select("lane", F.when(F.col("seen") == 0, "unknown").when(recent, "true").otherwise("false").alias("progressing"))


@query(f"SELECT lane, stream AS node, count(*) AS records, count(*) FILTER (WHERE seq % 11 = 3) AS abandoned FROM {EVENTS} GROUP BY ALL")
def abandoned_by(spark, sf_dir):
    return S.acknowledged(events(spark, sf_dir).withColumnRenamed("stream", "node"), ["lane", "node"], F.col("seq") % 11 == 3)


@query(f"SELECT lane, seq FROM {EVENTS} WHERE seq % 11 = 7 AND (SELECT max(tm) FROM {EVENTS}) - tm > 600000000")
def leaks(spark, sf_dir):
    e = events(spark, sf_dir)
    return S.leaked(e, F.col("seq") % 11 == 7, "tm", 600_000_000).select("lane", "seq")


FACTS = """(SELECT n_nationkey AS id, n_nationkey % 3 AS applied, CASE WHEN n_nationkey % 4 > 0 THEN n_nationkey % 2 END AS stored, n_nationkey % 5 AS total, n_nationkey % 2 AS finished, n_nationkey % 6 // 5 AS blocked, n_nationkey % 7 // 6 AS abandoned,
 CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey % 3 = 1 END AS source_ready, n_nationkey % 2 = 0 AS caught_up, CASE WHEN n_nationkey % 4 > 1 THEN n_nationkey * 400000 END AS advanced, n_nationkey * 500000 AS started FROM nation)"""


@query(f"""SELECT id, c[1] AS condition, c[2] AS status FROM (SELECT id, unnest([['configured', 'true'], ['spec_applied', CASE WHEN stored IS NULL OR stored = applied THEN 'true' ELSE 'false' END], ['assigned', (total > 0)::VARCHAR],
 ['source_ready', coalesce(source_ready::VARCHAR, 'unknown')], ['sink_ready', 'true'],
 ['progressing', CASE WHEN total = 0 OR finished = total THEN 'false' WHEN advanced >= 7000000 THEN 'true' WHEN advanced IS NULL AND started >= 7000000 THEN 'unknown' ELSE 'false' END],
 ['caught_up', CASE WHEN total = 0 THEN 'unknown' ELSE caught_up::VARCHAR END], ['backpressured', (blocked > 0)::VARCHAR], ['degraded', (abandoned > 0)::VARCHAR]]) AS c FROM {FACTS})""")
def conditions(spark, sf_dir):
    i = F.col("n_nationkey")
    facts = table(spark, sf_dir, "nation").select(
        i.alias("id"), (i % 3).alias("applied"), F.when(i % 4 > 0, i % 2).alias("stored"), (i % 5).alias("total"), (i % 2).alias("finished"), F.floor(i % 6 / 5).alias("blocked"), F.floor(i % 7 / 6).alias("abandoned"),
        F.when(i % 3 > 0, i % 3 == 1).alias("source_ready"), F.lit(True).alias("sink_ready"), (i % 2 == 0).alias("caught_up"), F.when(i % 4 > 1, i * 400_000).alias("advanced"), (i * 500_000).alias("started"),
        F.lit(0).alias("leaked"), F.lit(0).alias("downgrades"), F.lit(None).cast("string").alias("fault"),
    )
    return S.conditions(facts, "id", F.lit(10_000_000), 1_000_000)


@query("SELECT n_nationkey AS id, CASE WHEN n_regionkey > 0 THEN least(1.0, greatest(0.0, (n_nationkey - 3) * 1.0 / (n_regionkey * 5))) END AS fraction FROM nation")
def position_fraction(spark, sf_dir):
    lo = F.lit(3)
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), S.fraction(lo, lo + F.col("n_regionkey") * 5, F.col("n_nationkey")).alias("fraction"))


@query("""SELECT id, ['at_most_once', 'at_least_once', 'effectively_once', 'exactly_once'][1 + least(want, CASE WHEN NOT replayable AND NOT redelivers THEN 0 WHEN NOT keys THEN 1 ELSE 3 END, CASE WHEN commits THEN 3 WHEN idempotent THEN 2 ELSE 1 END)] AS tier
 FROM (SELECT n_nationkey AS id, n_nationkey % 4 AS want, n_nationkey % 2 = 0 AS replayable, n_nationkey % 3 = 0 AS redelivers, n_nationkey % 5 <> 0 AS keys, n_nationkey % 7 = 0 AS commits, n_nationkey % 2 = 1 AS idempotent FROM nation)""")
def negotiate_tier(spark, sf_dir):
    from ..plans.negotiate import tier_columns

    i = F.col("n_nationkey")
    n = table(spark, sf_dir, "nation")
    tier = tier_columns(i % 4, i % 2 == 0, i % 3 == 0, i % 5 != 0, i % 7 == 0, i % 2 == 1)
    return n.select(i.alias("id"), tier.alias("tier"))


EDGES = "(SELECT n_nationkey AS a, (n_nationkey * 2 + 1) AS b FROM nation WHERE n_nationkey * 2 + 1 < 25)"


@query(f"SELECT n_nationkey AS node FROM nation WHERE n_nationkey NOT IN (SELECT a FROM {EDGES})")
def graph_terminals(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"))
    return n.join(n.where("node * 2 + 1 < 25"), "node", "left_anti")


@query(f"SELECT a AS node, count(*) AS consumers FROM {EDGES} GROUP BY a")
def graph_consumers(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"))
    return n.where("node * 2 + 1 < 25").groupBy("node").agg(F.count("*").alias("consumers"))


@query("SELECT n_name AS stream, CASE WHEN n_nationkey % 3 = 0 THEN 'scoped' WHEN n_nationkey % 2 = 0 THEN 'plain' ELSE 'default' END AS mode FROM nation")
def stream_config(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    rules = n.where("n_nationkey % 3 = 0").select("n_name", F.lit("scoped").alias("mode"), F.lit(2).alias("rank"))
    rules = rules.unionByName(n.where("n_nationkey % 2 = 0").select("n_name", F.lit("plain").alias("mode"), F.lit(1).alias("rank")))
    best = rules.groupBy("n_name").agg(F.max_by("mode", "rank").alias("mode"))
    return n.join(best, "n_name", "left").select(F.col("n_name").alias("stream"), F.coalesce("mode", F.lit("default")).alias("mode"))


@query("SELECT a.n_nationkey AS id, CASE WHEN a.n_nationkey % 4 = 0 OR b.n_nationkey % 4 = 0 THEN NULL WHEN a.n_name < b.n_name THEN -1 WHEN a.n_name > b.n_name THEN 1 ELSE 0 END AS order_ FROM nation a JOIN nation b ON b.n_nationkey = (a.n_nationkey * 7) % 25")
def position_compare(spark, sf_dir):
    order = F.when(F.col("n_nationkey") % 4 != 0, F.encode("n_name", "UTF-8"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", order.alias("o"))
    other = n.select(F.col("n_nationkey").alias("k"), F.col("o").alias("p"))
    return n.join(other, F.col("k") == F.col("n_nationkey") * 7 % 25).select(F.col("n_nationkey").alias("id"), S.compare_orders(F.col("o"), F.col("p")).alias("order_"))


@query("SELECT n_nationkey AS id, 't' || n_regionkey || '/dedupe/p%2Fq/node/' || replace(n_name, '%', '%25') || '/sink/' || n_nationkey AS key FROM nation")
def key_spaces(spark, sf_dir):
    from ..operators import keys

    key = keys.dedupe_key(F.concat(F.lit("t"), "n_regionkey"), F.lit("p/q"), F.lit("node"), F.col("n_name"), F.lit("sink"), F.col("n_nationkey"))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), keys.rendered(key).alias("key"))
