"""Queries work on the whole of their tables."""

import pytest
from pyspark.sql import functions as F

from tidewright.functions.text import json_float
from tidewright.operators import flow
from tidewright.queries import QUERIES
from tidewright.queries.base import events

BIG = "/root/testdata/sf0.01"


def folded(rows, first, step):
    """(lane, seq, value) by a plain loop over rows (lane, seq, weight); ``step(state, weight) -> (state, value)``."""
    states, out = {}, []
    for lane, seq, w in sorted(rows):
        states[lane], value = step(states[lane], w) if lane in states else first(w)
        out.append((lane, seq, value))
    return out


def bytes_step(stays):
    return lambda s, w: (((s[0] + w, s[1]), s[1]) if stays(s[0], w) else ((w, s[1] + 1), s[1] + 1))


def bucket_step(s, w):
    left = min(5.0, s[0] + (w - s[1]) * 0.5) - 1
    return (left, w), -left / 0.5 if left < 0 else 0.0


FOLDS = {
    "split_bytes": (lambda e: F.length("body") * (1 + F.col("seq") % 13), lambda w: ((w, 0), 0), bytes_step(lambda used, w: used + w <= 400)),
    "batch_bytes": (lambda e: F.length("body"), lambda w: ((w, 0), 0), bytes_step(lambda used, w: used < 200)),
    "batch_age": (lambda e: F.col("tm"), lambda w: ((w, 0), 0), lambda s, w: (s, s[1]) if w - s[0] <= 600_000_000 else ((w, s[1] + 1), s[1] + 1)),
    "token_bucket": (lambda e: F.floor(F.col("seq") / 4).cast("double"), lambda w: ((4.0, w), 0.0), bucket_step),
}


@pytest.mark.parametrize("name", sorted(FOLDS))
def test_folds_take_every_event(spark, name):
    weight, first, step = FOLDS[name]
    e = events(spark, BIG)
    rows = [tuple(r) for r in e.select("lane", "seq", weight(e)).collect()]
    assert len(rows) > 4000
    assert sorted(tuple(r) for r in QUERIES[name](spark, BIG).collect()) == folded(rows, first, step)


def test_fold_is_linear_in_a_lane(spark):
    rows = spark.range(300_000).select(F.lit(1).alias("lane"), F.col("id").alias("seq"))
    got = flow.split_bytes(rows, ["lane"], "seq", F.lit(1), 100).agg(F.count(F.lit(1)), F.max("chunk"), F.sum("chunk")).first()
    assert tuple(got) == (300_000, 2999, 100 * sum(range(3000)))


def test_cas_apply_decides_every_write(spark):
    rows = spark.read.parquet(f"{BIG}/events.parquet").select("event_id", "user_id", "event_type").collect()
    versions, want = {}, []
    for r in sorted(rows, key=lambda r: r.event_id):
        version = versions.get(r.user_id, 0)
        applied = r.event_id * 7 % 5 == version
        versions[r.user_id] = (0 if r.event_type == "error" else version + 1) if applied else version
        want.append((r.event_id, applied, versions[r.user_id]))
    assert len(rows) > 3000
    assert sorted(tuple(r) for r in QUERIES["cas_apply"](spark, BIG).select("seq", "applied", "version").collect()) == want


def test_drift_program_reads_every_order(spark):
    kinds = ("VARCHAR", "UBIGINT", "OBJECT")
    want = sorted((r[0], kinds[r[0] % 3]) for r in spark.read.parquet(f"{BIG}/orders.parquet").select("o_orderkey").collect())
    assert len(want) == 15_000 and sorted(tuple(r) for r in QUERIES["drift_program"](spark, BIG).collect()) == want


def test_encode_json_takes_large_ids(spark, tmp_path):
    ids = [5, 999_999, 1_000_000, 2_000_000, 2_000_001, 2_400_000, 20_000_000, 20_000_001, 1 << 40]
    rows = spark.createDataFrame([(i,) for i in ids], "event_id long")
    rows = rows.select("event_id", F.lit("{}").alias("props"), F.lit("x").alias("event_type"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("ts"))
    rows.write.parquet(str(tmp_path / "events.parquet"))
    got = {r.event_id: r.json for r in QUERIES["encode_json"](spark, str(tmp_path)).collect()}
    assert sorted(got) == ids
    halves = ["2.5", "499999.5", "500000", "1e+06", "1.0000005e+06", "1.2e+06", "1e+07", "1.00000005e+07", "5.49755813888e+11"]
    assert [got[i].split('"half":')[1].split(",")[0] for i in ids] == halves


def test_json_float_is_the_shortest_form(spark):
    want = {0.0: "0", 1.5: "1.5", -7.0: "-7", 999999.5: "999999.5", 1e6: "1e+06", -1234567.25: "-1.23456725e+06", 1e10: "1e+10", 1.5e100: "1.5e+100", 0.001: "0.001",
            0.0001: "0.0001", -0.00025: "-0.00025", 0.00001: "1e-05", 2.5e-12: "2.5e-12"}
    got = spark.createDataFrame([(x,) for x in want], "x double").select("x", json_float(F.col("x"))).collect()
    assert {r[0]: r[1] for r in got} == want
