"""Write modes, gates, commits, drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift, modes
from .base import EVENTS, events, query, table

T = "(SELECT o_orderkey AS k, o_totalprice AS price, o_orderstatus AS status FROM orders WHERE o_orderkey % 2 = 0)"
C = "(SELECT o_orderkey // 3 * 3 AS k, CASE WHEN o_orderkey % 2 = 1 THEN o_totalprice + 1 END AS price, 'U' AS status, o_orderkey AS pos FROM orders WHERE o_orderkey % 3 < 2)"
LAST = f"(SELECT k, price, status FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pos DESC) AS rn FROM {C}) WHERE rn = 1)"


def target(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))


def changes(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    price = F.when(k % 2 == 1, F.col("o_totalprice") + 1)
    return o.where(k % 3 < 2).select((F.floor(k / 3) * 3).cast("bigint").alias("k"), price.alias("price"), F.lit("U").alias("status"), k.alias("pos"))


@query(f"SELECT * FROM {T} UNION ALL SELECT k, price, status FROM {C}")
def mode_append(spark, sf_dir):
    return modes.append(target(spark, sf_dir), changes(spark, sf_dir).drop("pos"))


@query(f"SELECT * FROM {T} t WHERE NOT EXISTS (SELECT 1 FROM {LAST} c WHERE c.k = t.k) UNION ALL SELECT * FROM {LAST}")
def mode_upsert(spark, sf_dir):
    return modes.upsert(target(spark, sf_dir), changes(spark, sf_dir), ["k"], "pos")


@query(f"SELECT k, coalesce(c.price, t.price) AS price, coalesce(c.status, t.status) AS status FROM {T} t FULL JOIN {LAST} c USING (k)")
def upsert_partial(spark, sf_dir):
    return modes.upsert(target(spark, sf_dir), changes(spark, sf_dir), ["k"], "pos", partial=True)


@query(f"SELECT k, price, status FROM {C}")
def mode_overwrite(spark, sf_dir):
    return modes.overwrite(target(spark, sf_dir), changes(spark, sf_dir))


@query(f"SELECT * FROM {T} WHERE k NOT IN (SELECT k FROM {C})")
def mode_delete(spark, sf_dir):
    return modes.delete(target(spark, sf_dir), changes(spark, sf_dir), ["k"])


ATTR = """CASE event_id % 6 WHEN 0 THEN '1' WHEN 1 THEN '"x"' WHEN 2 THEN '{"m": {}}' WHEN 3 THEN 'null' WHEN 4 THEN '2.5' ELSE 'true' END"""


@query("SELECT event_id, CASE WHEN event_id % 6 IN (1, 2, 3, 5) THEN 'permanent_mapping' END AS fault FROM events")
def type_gate(spark, sf_dir):
    v = F.parse_json(F.expr(ATTR))
    return table(spark, sf_dir, "events").select("event_id", modes.type_fault(v, {"DECIMAL"}, nullable=False).alias("fault"))


@query(f"SELECT seq, CASE WHEN lane > CASE stream WHEN 'click' THEN 3 WHEN 'view' THEN 5 ELSE 0 END THEN 'permanent_contract' END AS fault FROM {EVENTS}")
def epoch_gate(spark, sf_dir):
    applied = spark.createDataFrame([("click", 3), ("view", 5)], "stream string, epoch long")
    return modes.epoch_fault(events(spark, sf_dir).withColumn("epoch", F.col("lane")), applied, "stream").select("seq", "fault")


@query("SELECT l_orderkey AS upload, l_linenumber AS checkpoint, CASE WHEN l_linenumber = max(l_linenumber) OVER (PARTITION BY l_orderkey) THEN 'committed' ELSE 'already_committed' END AS outcome FROM lineitem")
def commit_subsume(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("upload"), F.col("l_linenumber").alias("checkpoint"))
    return modes.subsume(c, "upload", "checkpoint")


@query("SELECT l_orderkey AS upload, sum(l_quantity) >= 100 OR max(l_linenumber) >= 6 OR bool_or(l_returnflag = 'R') AS sealed FROM lineitem GROUP BY 1")
def seal_files(spark, sf_dir):
    u = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("upload")).agg(F.sum("l_quantity").alias("size"), F.max("l_linenumber").alias("age"), F.bool_or(F.col("l_returnflag") == "R").alias("final"))
    return u.select("upload", modes.seal(F.col("size"), F.col("age"), F.col("final"), 100, 6).alias("sealed"))


@query(f"SELECT stream AS dest, count(*) AS records, min(seq) AS first FROM {EVENTS} GROUP BY stream")
def partition_dest(spark, sf_dir):
    return modes.by_destination(events(spark, sf_dir), "stream", "seq")


@query("SELECT event_id, event_type || '/' || strftime(CASE WHEN event_id % 5 = 0 THEN TIMESTAMP '2020-01-02 03:04:05' ELSE ts END, '%Y-%m-%d') AS dest FROM events")
def partition_day(spark, sf_dir):
    from .base import micros

    at = F.when(F.col("event_id") % 5 != 0, micros("ts"))
    return table(spark, sf_dir, "events").select("event_id", modes.day_partition(F.col("event_type"), at, F.lit(1577934245000000).cast("bigint")).alias("dest"))


@query(f"SELECT seq // 100 AS request, count(*) AS written, CASE WHEN (seq // 100) % 3 = 0 THEN count(*) ELSE 0 END AS duplicates FROM {EVENTS} GROUP BY 1")
def staged_dupes(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("request", F.floor(F.col("seq") / 100).cast("bigint"))
    return modes.staged_requests(e, "request", e.where("request % 3 = 0"))


@query(f"SELECT seq, CASE WHEN avg(length(body) + lane * 2) OVER (PARTITION BY seq // 10) > 16 THEN 'permanent_mapping' END AS fault FROM {EVENTS}")
def oversize_batch(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("request", F.floor(F.col("seq") / 10))
    return modes.oversize_requests(e, ["request"], F.length("body") + F.col("lane") * 2, 16).select("seq", "fault")


@query(f"SELECT lane, count(*) AS records, max(seq // 100) AS checkpoint FROM {EVENTS} GROUP BY lane")
def lane_counts(spark, sf_dir):
    return modes.merge_committable(events(spark, sf_dir), ["lane"], F.floor(F.col("seq") / 100).cast("bigint"))


@query("""SELECT upload, checkpoint, CASE WHEN checkpoint < top OR upload % 5 = 0 THEN 'already_committed' WHEN upload % 7 <> 0 THEN 'committed' ELSE 'dead_letter' END AS outcome
 FROM (SELECT l_orderkey AS upload, l_linenumber AS checkpoint, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS top FROM lineitem)""")
def commit_outcomes(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("upload"), F.col("l_linenumber").alias("checkpoint"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("name"))
    return modes.resolve_commits(c, c.where("upload % 5 = 0"), c.where("upload % 7 <> 0"), "upload", "checkpoint", "name").select("upload", "checkpoint", "outcome")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', {str(k in drift.DESTRUCTIVE).lower()})" for k in drift.KINDS) + ") v(kind, destructive)")
def drift_destructive(spark, sf_dir):
    return spark.createDataFrame([(k,) for k in drift.KINDS], "kind string").withColumn("destructive", drift.destructive(F.col("kind")))


@query("SELECT kind, policy, policy = 'evolve' OR policy IN ('lenient', 'try_evolve') AND kind NOT IN ('drop_field', 'alter_field_type', 'truncate_stream', 'drop_stream') AS permitted FROM (VALUES "
       + ", ".join(f"('{k}')" for k in drift.KINDS) + ") k(kind), (VALUES " + ", ".join(f"('{p}')" for p in drift.POLICIES) + ") p(policy)")
def drift_permits(spark, sf_dir):
    cases = spark.createDataFrame([(k, p) for k in drift.KINDS for p in drift.POLICIES], "kind string, policy string")
    return cases.withColumn("permitted", drift.permits(F.col("policy"), F.col("kind")))


@query("SELECT c_custkey AS id, c_nationkey AS nation_old, c_nationkey::VARCHAR AS nation FROM customer")
def drift_lenient(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    out = drift.apply_changes(c, [{"kind": "alter_field_type", "from": "nation", "type": "string"}], "lenient")
    return out.select("id", "nation_old", "nation")


@query("SELECT c_custkey AS id, c_name AS title, CAST(NULL AS VARCHAR) AS currency, CAST(c_nationkey AS BIGINT) AS n FROM customer")
def drift_apply(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("n"), F.col("c_acctbal").alias("gone"))
    return drift.apply_changes(c, [
        {"kind": "add_field", "to": "currency", "type": "string"}, {"kind": "drop_field", "from": "gone"},
        {"kind": "rename_field", "from": "name", "to": "title"}, {"kind": "alter_field_type", "from": "n", "type": "bigint"},
    ])


@query(f"SELECT seq, CASE WHEN seq >= 500 THEN 'v2' WHEN seq >= 100 THEN 'v1' END AS version FROM {EVENTS}")
def schema_as_of(spark, sf_dir):
    streams = events(spark, sf_dir).select("stream").distinct()
    history = streams.withColumn("h", F.explode(F.array(F.struct(F.lit(100).cast("bigint").alias("epoch"), F.lit("v1").alias("version")), F.struct(F.lit(500).cast("bigint").alias("epoch"), F.lit("v2").alias("version")))))
    rows = events(spark, sf_dir).select("stream", "seq", F.col("seq").alias("epoch"))
    return drift.as_of(rows, history.select("stream", "h.*"), "stream", "epoch", "version").select("seq", "version")
