"""Edges, faults, retry, clocks, dead letters, transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import routing as R
from ..operators import shape
from .base import EVENTS, events, query, table


def faulted(spark, sf_dir):
    cls = F.when(F.col("seq") % 11 == 3, F.lit("permanent_mapping")).when(F.col("seq") % 11 == 7, F.lit("transient_upstream"))
    return events(spark, sf_dir).withColumn("fault", cls)


FAULTED = f"(SELECT *, CASE seq % 11 WHEN 3 THEN 'permanent_mapping' WHEN 7 THEN 'transient_upstream' END AS fault FROM {EVENTS})"


@query(f"SELECT seq, lane FROM {FAULTED} WHERE fault IS NULL")
def edge_main(spark, sf_dir):
    return R.edge(faulted(spark, sf_dir), "main").select("seq", "lane")


@query(f"SELECT seq, lane, fault FROM {FAULTED} WHERE fault IS NOT NULL")
def edge_failed(spark, sf_dir):
    return R.edge(faulted(spark, sf_dir), "failed").select("seq", "lane", "fault")


@query(f"SELECT seq, lane, fault FROM {FAULTED}")
def edge_all(spark, sf_dir):
    return R.edge(faulted(spark, sf_dir), "all").select("seq", "lane", "fault")


@query(f"""SELECT seq, bool_and(ended OR best_effort) AS settled, bool_or(NOT best_effort AND coalesce(outcome = 'abandoned', false)) AS abandoned FROM (
 SELECT seq, best_effort, outcome, coalesce(outcome IN ('delivered', 'abandoned'), false) AS ended FROM (
  SELECT seq, b = 'metrics' AS best_effort, CASE WHEN (seq + length(b)) % 11 = 3 THEN 'abandoned' WHEN (seq + length(b)) % 11 = 7 THEN NULL ELSE 'delivered' END AS outcome
  FROM {EVENTS}, (VALUES ('metrics'), ('queue'), ('warehouse')) v(b))) GROUP BY seq""")
def fan_out(spark, sf_dir):
    arms = R.fan_out(events(spark, sf_dir).select("seq"), {"queue": False, "warehouse": False, "metrics": True})
    n = (F.col("seq") + F.length("branch")) % 11
    return R.settle(arms.withColumn("outcome", F.when(n == 3, F.lit("abandoned")).when(n != 7, F.lit("delivered"))), ["seq"])


@query("SELECT 'left' AS node, o_orderkey AS k FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'right', o_orderkey FROM orders WHERE o_orderkey % 3 = 0")
def fan_in(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    side = lambda name, n: o.where(F.col("k") % n == 0).withColumn("node", F.lit(name))
    return side("left", 2).unionByName(side("right", 3))


CLASSES = "(VALUES ('unclassified'), ('transient_upstream'), ('throttled'), ('indeterminate'), ('permanent_mapping'), ('duplicate_idempotent'), ('not_connected'), ('clock_skew')) c(cls)"
POLICY = {"initial_ms": 100, "multiplier": 2.0, "max_ms": 5000, "max_attempts": 5, "max_elapsed_ms": 60_000, "terminal": "dead_letter", "on_indeterminate": "stall"}


@query(f"""SELECT cls, tries, idem, disposition, CASE WHEN disposition = 'retry' THEN CASE WHEN hint = 0 THEN 100 ELSE coalesce(hint, CASE WHEN n < 5 THEN least(5000, 100 * 2 ** (n - 1))::BIGINT ELSE 5000 END) END END AS delay_ms FROM (
 SELECT *, CASE WHEN cls = 'duplicate_idempotent' THEN 'delivered' WHEN cls = 'indeterminate' AND NOT idem THEN 'stall' WHEN cls IN ('unclassified', 'permanent_mapping') THEN 'dead_letter'
   WHEN elapsed >= 60000 THEN 'dead_letter' WHEN counted AND n >= 5 THEN 'dead_letter' ELSE 'retry' END AS disposition FROM (
  SELECT *, greatest(1, tries + counted::INT) AS n FROM (
   SELECT cls, tries, idem, tries * 11000 AS elapsed, CASE WHEN tries = 2 THEN 0 WHEN tries = 3 THEN 777 END AS hint, cls NOT IN ('throttled', 'not_connected') AS counted
   FROM {CLASSES}, (SELECT unnest(range(7)) AS tries), (VALUES (true), (false)) i(idem))))""")
def fault_route(spark, sf_dir):
    names = ["unclassified", "transient_upstream", "throttled", "indeterminate", "permanent_mapping", "duplicate_idempotent", "not_connected", "clock_skew"]
    cases = spark.range(7).withColumnRenamed("id", "tries").withColumn("cls", F.explode(F.array(*map(F.lit, names)))).withColumn("idem", F.explode(F.array(F.lit(True), F.lit(False))))
    hint = F.when(F.col("tries") == 2, F.lit(0).cast("bigint")).when(F.col("tries") == 3, F.lit(777).cast("bigint"))
    found = R.route_fault(F.col("cls"), F.col("tries"), F.col("tries") * 11000, hint, F.col("idem"), POLICY)
    return cases.select("cls", "tries", "idem", found["disposition"].alias("disposition"), found["delay_ms"].alias("delay_ms"))


@query("SELECT r_name || '-' || n AS k, CASE WHEN n BETWEEN 1 AND 9 THEN least(5000, 100 * 2 ** (n - 1))::BIGINT END AS ceiling_ms FROM region, (SELECT unnest(range(12)) AS n)")
def backoff_ceiling(spark, sf_dir):
    n = table(spark, sf_dir, "region").withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(11))))
    return n.select(F.concat_ws("-", "r_name", "n").alias("k"), R.backoff_ceiling(F.col("n"), 100, 2.0, 5000, 10).alias("ceiling_ms"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{b}', {str(t).lower()}, {str(n).lower()})" for c, (b, t, n) in R.FAULT_CLASSES.items()) + ") v(class, blame, terminal, counted)")
def fault_class(spark, sf_dir):
    c = spark.createDataFrame([(c,) for c in R.FAULT_CLASSES], "class string")
    return c.select("class", R.blame(F.col("class")).alias("blame"), R.is_terminal(F.col("class")).alias("terminal"), R.is_counted(F.col("class")).alias("counted"))


@query(f"SELECT seq, fault, 'dlq' AS dest FROM {FAULTED} WHERE fault IS NOT NULL UNION ALL SELECT seq, NULL, 'main' FROM {FAULTED} WHERE fault IS NULL")
def terminal_dead_letter(spark, sf_dir):
    parts = R.fault_terminal(faulted(spark, sf_dir), "dead_letter")
    main = parts["main"].select("seq", "fault", F.lit("main").alias("dest"))
    return main.unionByName(parts["dead_letter"].select("seq", "fault", F.lit("dlq").alias("dest")))


@query(f"SELECT lane, count(*) FILTER (WHERE fault IS NULL) AS delivered, count(fault) AS abandoned FROM {FAULTED} GROUP BY lane")
def terminal_drop(spark, sf_dir):
    return R.drop_counts(faulted(spark, sf_dir), ["lane"])


@query(f"""SELECT seq, lane, stream, fault AS class, CASE fault WHEN 'permanent_mapping' THEN 'config' ELSE 'upstream' END AS blame, 'write' AS op, 'row ' || seq AS message,
 seq % 3 AS attempts, 'sink' AS node, 4 AS revision, body AS payload, stream AS meta FROM {FAULTED} WHERE fault IS NOT NULL""")
def dead_letter_envelope(spark, sf_dir):
    f = F.struct(F.col("fault").alias("class"), F.lit("write").alias("op"), F.concat(F.lit("row "), F.col("seq")).alias("user"))
    rows = faulted(spark, sf_dir).withColumn("fault", F.when(F.col("fault").isNotNull(), f)).withColumn("attempts", F.col("seq") % 3)
    return R.dead_letter(rows, "sink", 4)


@query(f"SELECT lane, count(*) FILTER (WHERE fault IS NULL) AS admitted, count(fault) AS marked, max(seq) AS position FROM {FAULTED} GROUP BY lane")
def marked_route(spark, sf_dir):
    return R.dispose_marked(faulted(spark, sf_dir), ["lane"], "seq")


SKEW = 60_000_000
NOW = "(SELECT epoch_us(max(ts)) - 3600000000 FROM events)"


def now(spark, sf_dir):
    from .base import micros

    top = table(spark, sf_dir, "events").agg(F.max(micros("ts"))).scalar()
    return F.coalesce(top, F.lit(0)) - 3_600_000_000


@query(f"SELECT seq, least(tm, {NOW} + {SKEW}) AS tm, CASE WHEN tm > {NOW} + {SKEW} THEN 'rounded' END AS note FROM {EVENTS}")
def clock_clamp(spark, sf_dir):
    return R.clock(events(spark, sf_dir), "clamp", now(spark, sf_dir), SKEW, "tm").select("seq", "tm", "note")


@query(f"SELECT seq, tm, CASE WHEN tm > {NOW} + {SKEW} THEN 'clock_skew' END AS fault FROM {EVENTS}")
def clock_reject(spark, sf_dir):
    return R.clock(events(spark, sf_dir), "reject", now(spark, sf_dir), SKEW, "tm").select("seq", "tm", "fault")


@query(f"SELECT count(*) AS records, count(*) FILTER (WHERE tm > {NOW} + {SKEW}) AS ahead FROM {EVENTS}")
def clock_pass(spark, sf_dir):
    return R.clock(events(spark, sf_dir), "pass", now(spark, sf_dir), SKEW, "tm").agg(F.count("*").alias("records"), F.count_if("ahead").alias("ahead"))


@query(f"SELECT seq, stream FROM {EVENTS} WHERE stream <> 'error' AND value > 10")
def t_filter(spark, sf_dir):
    return events(spark, sf_dir).where((F.col("stream") != "error") & (F.col("value") > 10)).select("seq", "stream")


@query(f"SELECT seq, CASE WHEN stream = 'purchase' THEN 'billing' WHEN value > 50 THEN 'large' ELSE 'rest' END AS dest FROM {EVENTS}")
def t_route(spark, sf_dir):
    dest = F.when(F.col("stream") == "purchase", "billing").when(F.col("value") > 50, "large").otherwise("rest")
    return events(spark, sf_dir).select("seq", dest.alias("dest"))


@query("SELECT event_id, '{\"a\": ' || event_id || ', \"k\": \"***\", \"in\": {\"k\": \"***\", \"user\": ' || user_id || '}}' AS props FROM events")
def t_redact(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    props = F.concat(F.lit('{"a": '), "event_id", F.lit(', "k": "'), "event_type", F.lit('", "in": {"k": '), "user_id", F.lit(', "user": '), "user_id", F.lit("}}"))
    return shape.redact(e.select("event_id", props.alias("props")), "props", ["k"])


@query(f"SELECT seq, CASE WHEN seq % 11 = 3 THEN 'abandoned' WHEN seq % 11 = 7 THEN NULL WHEN seq % 7 = 0 THEN 'duplicate' ELSE 'delivered' END AS outcome, coalesce(seq % 11 NOT IN (3, 7), false) AS counts_as_delivered FROM {EVENTS}")
def disposition(spark, sf_dir):
    n = F.col("seq")
    out = R.sink_outcome(n % 11 == 3, n % 11 == 7, n % 7 == 0)
    return events(spark, sf_dir).select("seq", out.alias("outcome"), R.is_delivery(out).alias("counts_as_delivered"))


@query(f"SELECT lane, count(*) AS records, count(fault) AS failed, count(*) - count(fault) AS written FROM {FAULTED} GROUP BY lane")
def reconcile_writes(spark, sf_dir):
    g = faulted(spark, sf_dir).groupBy("lane").agg(F.count("*").alias("records"), F.count("fault").alias("failed"), F.count_if(F.col("fault").isNull()).alias("written"))
    return R.reconcile(g, "records", "written", "failed")


@query(f"SELECT seq, CASE WHEN lane = 5 THEN 'permanent_upstream' WHEN seq % 11 = 3 THEN 'permanent_mapping' END AS fault FROM {EVENTS}")
def partial_failure(spark, sf_dir):
    whole = spark.createDataFrame([(5, "permanent_upstream")], "lane long, request_fault string")  # a request-wide error is every record's
    own = F.when(F.col("seq") % 11 == 3, F.lit("permanent_mapping"))
    return R.spread_faults(events(spark, sf_dir), whole, ["lane"], own).select("seq", "fault")


@query(f"SELECT seq, sent, 'permanent_mapping' AS fault FROM (SELECT seq, count(*) OVER (PARTITION BY lane, seq // 500 ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sent FROM {EVENTS}) WHERE (seq + sent) % 997 = 0")
def queue_reject(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("request", F.floor(F.col("seq") / 500))
    return R.reject_full(e, ["lane", "request"], "seq", lambda key: (key + F.col("sent")) % 997 == 0).where("fault is not null").select("seq", "sent", "fault")


@query(f"SELECT seq, CASE WHEN max(value) OVER (PARTITION BY seq // 20) > 95 THEN 'throttled' END AS fault FROM {EVENTS}")
def load_shed(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("request", F.floor(F.col("seq") / 20))
    return R.shed_requests(e, ["request"], F.col("value"), 95).select("seq", "fault")
