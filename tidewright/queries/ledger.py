"""Prefixes, commits, replay, acknowledgements, fences, dedupe, stores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import dedupe, ledger
from .base import EVENTS, events, query, table



def resolved():
    return F.col("seq") % 1009 != 700


def safe():
    return F.col("seq") % 5 == 0


P = f"(SELECT *, bool_and(seq % 1009 <> 700) OVER (PARTITION BY lane ORDER BY seq) AS p FROM {EVENTS})"


@query(f"SELECT seq, lane, p AS in_prefix FROM {P}")
def resolved_prefix(spark, sf_dir):
    return ledger.with_prefix(events(spark, sf_dir), ["lane"], "seq", resolved()).select("seq", "lane", "in_prefix")


COMMIT = f"(SELECT lane, max(seq) FILTER (WHERE p) AS resolved_to, max(seq) FILTER (WHERE p AND seq % 5 = 0) AS commit_to FROM {P} GROUP BY lane)"


@query(f"SELECT * FROM {COMMIT}")
def commit_position(spark, sf_dir):
    return ledger.commit_position(events(spark, sf_dir), ["lane"], "seq", resolved(), safe())


@query(f"SELECT lane, count(*) FILTER (WHERE commit_to IS NULL OR seq > commit_to) AS replay FROM {EVENTS} JOIN {COMMIT} USING (lane) GROUP BY lane")
def replay_records(spark, sf_dir):
    return ledger.replay_window(events(spark, sf_dir), ["lane"], "seq", resolved(), safe())


C = f"(SELECT lane, seq AS step, (seq * 37) % 1000 AS s, CASE WHEN seq % 4 <> 0 THEN (seq * 53) % 1000 END AS o FROM {EVENTS})"


@query(f"""SELECT lane, step, coalesce(s > max(s) OVER w, true) AND coalesce(o > max(o) OVER w, true) AS flushes FROM {C}
 WINDOW w AS (PARTITION BY lane ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def cursor_monotone(spark, sf_dir):
    c = events(spark, sf_dir).select("lane", F.col("seq").alias("step"), (F.col("seq") * 37 % 1000).alias("s"), F.when(F.col("seq") % 4 != 0, F.col("seq") * 53 % 1000).alias("o"))
    return ledger.monotone_commits(c, ["lane"], "step", "s", "o").select("lane", "step", "flushes")


@query(f"""SELECT lane, min(seq) AS first, max(seq) AS last, count(*) AS positions FROM (SELECT *, sum(CASE WHEN i AND coalesce(b, false) THEN 0 ELSE 1 END) OVER (PARTITION BY lane ORDER BY seq) AS run FROM (
 SELECT lane, seq, stream <> 'purchase' AS i, lag(stream <> 'purchase') OVER (PARTITION BY lane ORDER BY seq) AS b FROM {EVENTS})) GROUP BY lane, run""")
def idle_coalesce(spark, sf_dir):
    return ledger.coalesce_idle(events(spark, sf_dir), ["lane"], "seq", F.col("stream") != "purchase")


@query(f"SELECT lane, seq, CASE seq % 11 WHEN 3 THEN 'abandoned' ELSE 'landed' END AS outcome FROM {EVENTS} WHERE seq % 11 <> 7")
def discrete_acks(spark, sf_dir):
    n = F.col("seq") % 11
    return ledger.settle_each(events(spark, sf_dir), F.when(n == 3, "abandoned").when(n != 7, "landed")).select("lane", "seq", "outcome")


@query(f"""SELECT seq, bool_or(stale) OVER (PARTITION BY seq // 10) AS rejected FROM (SELECT seq, coalesce(epoch < max(epoch) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stale
 FROM (SELECT seq, key, seq // 100 - CASE WHEN seq % 97 = 5 THEN 3 ELSE 0 END AS epoch FROM {EVENTS}))""")
def epoch_fence(spark, sf_dir):
    epoch = F.floor(F.col("seq") / 100) - F.when(F.col("seq") % 97 == 5, 3).otherwise(0)
    e = events(spark, sf_dir).withColumn("epoch", epoch).withColumn("batch", F.floor(F.col("seq") / 10))
    return ledger.fence(e, ["key"], "seq", "epoch", ["batch"]).select("seq", "rejected")


@query(f"SELECT lane, (SELECT max(tm) FROM {EVENTS}) - max(tm) >= 600000000 AS idle FROM {EVENTS} GROUP BY lane")
def idle_lanes(spark, sf_dir):
    return ledger.idle_lanes(events(spark, sf_dir), ["lane"], "tm", 600_000_000)


@query(f"SELECT lane, seq, NOT p AND coalesce(NOT lag(p) OVER (PARTITION BY lane ORDER BY seq), false) AS fault FROM (SELECT *, stream <> 'error' AS p FROM {EVENTS})")
def spin_fault(spark, sf_dir):
    return ledger.spin_faults(events(spark, sf_dir), ["lane"], "seq", F.col("stream") != "error").select("lane", "seq", "fault")


# every seventh record comes again a minute later, from the same source
AGAIN = f"(SELECT seq, key, lane, tm FROM {EVENTS} UNION ALL SELECT seq, key, lane, tm + 60000000 FROM {EVENTS} WHERE seq % 7 = 0)"


def again(spark, sf_dir):
    e = events(spark, sf_dir).select("seq", "key", "lane", "tm")
    return e.unionByName(e.where("seq % 7 = 0").withColumn("tm", F.col("tm") + 60_000_000))


@query(f"SELECT seq, tm, row_number() OVER (PARTITION BY seq ORDER BY tm) > 1 AS duplicate FROM {AGAIN}")
def dedupe_upstream(spark, sf_dir):
    return dedupe.mark_duplicates(again(spark, sf_dir), ["seq"], "tm", 120_000_000, ["seq"]).select("seq", "tm", "duplicate")


@query(f"SELECT seq, tm, coalesce(tm - lag(tm) OVER (PARTITION BY key ORDER BY tm, seq) <= 3600000000, false) AS duplicate FROM {AGAIN}")
def dedupe_key(spark, sf_dir):
    return dedupe.mark_duplicates(again(spark, sf_dir), ["key"], "tm", 3_600_000_000, ["seq"]).select("seq", "tm", "duplicate")


@query(f"SELECT key, arg_max(value, seq) AS value, max(seq) AS version FROM {EVENTS} GROUP BY key HAVING arg_max(stream, seq) <> 'error'")
def compact_latest(spark, sf_dir):
    return ledger.latest(events(spark, sf_dir), ["key"], "seq", F.col("stream") == "error", "value")


@query("""WITH RECURSIVE w AS (SELECT event_id AS seq, user_id AS key, (event_id * 7) % 5 AS want, event_type = 'error' AS drop_, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
 f AS (SELECT key, rn, seq, want = 0 AS applied, CASE WHEN want = 0 AND NOT drop_ THEN 1 ELSE 0 END AS version FROM w WHERE rn = 1
  UNION ALL SELECT w.key, w.rn, w.seq, w.want = f.version, CASE WHEN w.want <> f.version THEN f.version WHEN w.drop_ THEN 0 ELSE f.version + 1 END FROM f JOIN w ON w.key = f.key AND w.rn = f.rn + 1)
 SELECT seq, applied, version FROM f""")
def cas_apply(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    e = e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"), (F.col("event_id") * 7 % 5).alias("want"), (F.col("event_type") == "error").alias("drop"))
    return dedupe.compare_and_set(e, "key", "seq", "want", "drop").select("seq", "applied", "version")


@query("SELECT tenant || '/' || key AS path FROM (SELECT n_regionkey::VARCHAR AS tenant, n_name AS key FROM nation) WHERE tenant = '1' AND (key = 'C' OR starts_with(key, 'C')) OR tenant = '2'")
def key_range(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("tenant"), F.col("n_name").alias("key"))
    from ..operators.status import key_range as under

    return under(n, ["tenant", "key"], ("1", "C")).unionByName(under(n, ["tenant", "key"], ("2",))).select("path")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey > 50 ORDER BY id LIMIT 200")
def lane_page(spark, sf_dir):
    from ..operators.status import page

    return page(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), "id", F.lit(50), 200).select("id")


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 32")
def recent_events(spark, sf_dir):
    from ..operators.status import last_n

    return last_n(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id")
