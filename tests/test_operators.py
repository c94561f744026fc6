"""Operators whose every case no query shows."""

import random

from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructType

from tidewright.functions import text
from tidewright.functions.codec import decimal_text, resolve_chain
from tidewright.functions.predicate import compile_predicate
from tidewright.operators import asof, dedupe, identity, routing, snapshot, status


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_last_mark_over_spans_groups_and_texts(spark):
    marks = [(g, k, f"{g}{k}") for g in "ab" for k in range(-50, 4000, 37)]
    asked = [(g, k) for g in "abc" for k in range(-60, 4100, 13)]
    m, r = spark.createDataFrame(marks, "g string, k long, v string"), spark.createDataFrame(asked, "g string, k long")
    want = [(g, k, max(((mk, v) for mg, mk, v in marks if mg == g and mk <= k), default=(0, None))[1]) for g, k in asked]
    for width in (1, 100, 1 << 20):
        assert rows(asof.last_mark(r, m, ["g"], "k", "v", width)) == sorted(want, key=lambda x: x[:2])
    words = spark.createDataFrame([(w,) for w in ("", "apple", "apples", "b", "zz", "é")], "w string")
    starts = spark.createDataFrame([("apples", 1), ("b", None), ("z", 3)], "w string, n long")
    assert {r.w: r.n for r in asof.last_mark(words, starts, [], "w", "n").collect()} == {"": None, "apple": None, "apples": 1, "b": None, "zz": 3, "é": 3}


def test_chunks_of_sparse_and_textual_keys(spark):
    keys = [f"k{n * n:07d}" for n in range(100)]
    got = sorted(snapshot.chunk_plan(spark.createDataFrame([(k,) for k in keys], "k string"), "k", 30).collect(), key=lambda r: r.ord)
    assert [(r.lo, r.hi, r.est) for r in got] == [(keys[0], keys[30], 30), (keys[30], keys[60], 30), (keys[60], keys[90], 30), (keys[90], None, 10)]
    assert snapshot.chunk_plan(spark.createDataFrame([], "k long"), "k", 3).count() == 0


def test_lanes_are_announced_finished_forgotten(spark):
    lanes = spark.createDataFrame([(1, False, None)], "id long, finished boolean, finished_at long")
    twice = snapshot.announce(snapshot.announce(lanes, spark.createDataFrame([(1,), (2,)], "id long")), spark.createDataFrame([(2,)], "id long"))
    assert sorted(r.id for r in twice.collect()) == [1, 2]
    ended = snapshot.finish(lanes, spark.createDataFrame([(1, 9)], "id long, finished_at long"))
    assert rows(snapshot.finish(ended, spark.createDataFrame([(1, 11)], "id long, finished_at long"))) == [(1, True, 9)]
    assert snapshot.forget(lanes, ended).count() == 0
    assert snapshot.letter_bounds(4) == ["", "g", "n", "t"]


def test_pins_overflow(spark):
    e = spark.createDataFrame([(n, n) for n in range(10)], "id long, at long")
    assert [r.id for r in snapshot.pin(e, "id", "at", F.lit(9), 3, 4).orderBy("id").collect()] == [6, 7, 8, 9]
    assert [tuple(r) for r in snapshot.pin(e, "id", "at", F.lit(9), 3, 3).collect()] == [(None, True)]
    assert spark.range(1).select(snapshot.poll_from(F.lit(None), F.lit(50), 10), snapshot.poll_from(F.lit(20), F.lit(50), 10)).first()[:] == (40, 10)


def test_compare_and_set_fences_by_epoch(spark):
    writes = [("k", 1, 0, False, 5), ("k", 2, 1, False, 4), ("k", 3, 1, True, 6), ("k", 4, 0, False, 5), ("k", 5, 0, False, 6), ("j", 1, 1, False, 1)]
    got = dedupe.compare_and_set(spark.createDataFrame(writes, "key string, seq long, want long, drop boolean, epoch long"), "key", "seq", "want", "drop", "epoch")
    assert rows(got) == [("j", 1, False, 0), ("k", 1, True, 1), ("k", 2, False, 1), ("k", 3, True, 0), ("k", 4, False, 0), ("k", 5, True, 1)]


def test_transactions_are_all_or_nothing(spark):
    store = spark.createDataFrame([("a", 2, 5), ("b", 0, 7)], "key string, version long, floor long")
    ask = lambda *w: rows(dedupe.transact(store, spark.createDataFrame(list(w), "key string, want long, drop boolean, epoch long"), "key"))
    assert ask(("a", 2, False, 5), ("c", 0, False, 1)) == [("a", True, 3, 5), ("b", False, 0, 7), ("c", True, 1, 1)]
    assert ask(("a", 2, True, 9), ("b", 0, False, 6)) == [("a", False, 2, 5), ("b", False, 0, 7)]
    assert ask(("a", 2, True, 9), ("b", 0, False, 7)) == [("a", True, 0, 9), ("b", True, 1, 7)]
    assert ask(("a", 1, False, 9)) == [("a", False, 2, 5), ("b", False, 0, 7)]


def test_counters_progress_and_shedding(spark):
    d = spark.createDataFrame([(1, "x", 3), (2, "y", None)], "id long, l string, v long")
    assert rows(status.counters(d, {"l": F.col("l")}, F.col("v"))) == [("x", 3)]
    try:
        status.counters(d, {"l": F.col("l")}, most=1).collect()
        raise AssertionError("too many series")
    except Exception as e:
        assert "more than 1 series" in str(e)
    assert spark.range(1).select(status.eta(F.lit(0.25), F.lit(100.0)), status.eta(F.lit(0.0), F.lit(1.0)), status.eta(F.lit(1.0), F.lit(1.0))).first()[:] == (300.0, None, None)
    assert {r.id: r.fault for r in routing.shed_requests(d.withColumn("r", F.lit(1)), ["r"], F.col("v"), 2).collect()} == {1: "throttled", 2: "throttled"}


def test_clock_keeps_an_earlier_fault(spark):
    d = spark.createDataFrame([(99, "permanent_mapping"), (99, None), (1, None)], "at long, fault string")
    assert [r.fault for r in routing.clock(d, "reject", F.lit(10), 5).collect()] == ["permanent_mapping", "clock_skew", None]


def test_members_by_any_name(spark):
    d = spark.createDataFrame([('{"a\'b": {"c\\"d": 7}, "x?": 1, "e.f": 2}',)], "j string").select(F.parse_json("j").alias("d"))
    for path, value in ((["a'b", 'c"d'], 7), (["x?"], 1), (["e.f"], 2)):
        assert d.select(compile_predicate({"path": path, "op": "equals", "value": value}, F.col("d"))).first()[0]


def test_decimal_text_of_any_scale(spark):
    cases = [("5", -2, "500"), ("0", -2, "0"), ("-5", 3, "-0.005"), ("12345678901234567890123456789012345678", 2, "123456789012345678901234567890123456.78"), ("100", 2, "1.00"), ("-7", 0, "-7")]
    for unscaled, scale, want in cases:
        assert spark.range(1).select(decimal_text(F.lit(unscaled).cast("decimal(38,0)"), scale)).first()[0] == want


def test_json_floats_of_every_decade(spark):
    rng = random.Random(3)
    values = [s * m * 10.0**e for e in range(-7, 23) for m in (1, 2.5, 1.2345675, rng.random(), rng.random() * 1e-3) for s in (1, -1)] + [0.0]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", text.json_float(F.col("x"))).collect()

    def shortest(x):
        mantissa, exponent = (f"{x:.17g}", 0) if x == 0 else ("", 0)
        for n in range(17):
            t = f"{x:.{n}e}"
            if float(t) == x:
                mantissa, exponent = t.split("e")[0], int(t.split("e")[1])
                break
        if x == 0:
            return "0"
        mantissa = mantissa.rstrip("0").rstrip(".") if "." in mantissa else mantissa
        if exponent < -4 or exponent >= 6:
            return f"{mantissa}e{exponent:+03d}"
        return f"{x:.{max(0, len(mantissa.lstrip('-').replace('.', '')) - 1 - exponent)}f}"

    assert {r[0]: r[1] for r in got} == {v: shortest(v) for v in values}


def test_chains_and_fingerprints(spark):
    chain, wrong = resolve_chain({})
    assert not wrong and chain.encoder == "json" and "base64" in chain.notes[0]
    assert [w.split("; ")[0] for w in resolve_chain({"encoder": "xml", "framer": "x", "more": 1})[1]] == ["codec.more: unknown field", "no encoder is named 'xml'", "no framer is named 'x'"]
    a, b = (StructType.fromDDL(x) for x in ("a int, b struct<c:string>", "a int, b struct<c:binary>"))
    assert identity.schema_fingerprint(a) != identity.schema_fingerprint(b) != identity.schema_fingerprint(StructType([])) != identity.schema_fingerprint(None)
    assert identity.schema_fingerprint(a) == identity.schema_fingerprint(StructType.fromDDL("a int, b struct<c:string>"))


def test_scopes_do_not_collide(spark):
    keys = spark.range(1).select(dedupe.scoped(F.lit("a/b"), F.lit("c")), dedupe.scoped(F.lit("a"), F.lit("b/c"))).first()
    assert keys[0] != keys[1]


def test_sized_frames_and_compression(spark):
    import bz2
    import gzip

    from tidewright.functions.codec import decode_sized, decompress

    pack = lambda *xs: b"".join(len(x).to_bytes(4, "big") + x for x in xs)
    frames = [(1, pack(b"one", b"", b"three")), (2, pack(b"a") + b"\0\0\0\x09cut"), (3, b""), (4, pack(b"x") + b"\0")]
    got = decode_sized(spark.createDataFrame(frames, "id long, frame binary"), "frame", ["id"]).collect()
    told = [(r.id, None if r.body is None else bytes(r.body), r.fault) for r in got]
    bad = "permanent_mapping"
    assert told == [(1, b"one", None), (1, b"", None), (1, b"three", None), (2, b"a", None), (2, None, bad), (4, b"x", None), (4, None, bad)]
    packed = spark.createDataFrame([(1, gzip.compress(b"hello")), (2, b"no"), (3, None), (4, bz2.compress(b"x"))], "id long, body binary")
    assert [(r.body and bytes(r.body), r.fault) for r in decompress(packed, "body", "gzip").orderBy("id").collect()] == [(b"hello", None), (None, bad), (None, None), (None, bad)]


def test_status_over_http():
    import json
    import urllib.error
    import urllib.request

    from tidewright.streaming.status import serve

    rows = [{"stream": s, "batch": 1, "records": n, "per_second": None, "active": True, "fault": None, "offsets": []} for n, s in enumerate(("a", "b", 'c"'))]
    server = serve(lambda: rows)
    ask = lambda path: urllib.request.urlopen(f"http://127.0.0.1:{server.server_address[1]}{path}").read().decode()
    try:
        first = json.loads(ask("/status?limit=2"))
        assert [r["stream"] for r in first["rows"]] == ["a", "b"] and first["truncated"] and first["cursor"] == "b"
        assert [r["stream"] for r in json.loads(ask("/status?cursor=b"))["rows"]] == ['c"'] and json.loads(ask("/status?stream=b"))["rows"] == rows[1:2]
        text = ask("/metrics")
        assert 'tidewright_records{stream="b"} 1' in text and "per_second" not in text
        for path, code in (("/status?limit=x", 400), ("/status?what=1", 400), ("/else", 404)):
            try:
                ask(path)
                raise AssertionError(path)
            except urllib.error.HTTPError as e:
                assert e.code == code
    finally:
        server.shutdown()


def test_times_are_utc_in_any_zone(spark):
    from tidewright.operators.modes import day_partition

    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            at = F.lit(1_710_054_000_120_000).cast("bigint")  # within the hour that New York's clocks skip
            d = spark.range(1).select(text.json_time(at), text.json_time(F.lit(-1).cast("bigint")), day_partition(F.lit("d"), at, at), text.json_value(F.timestamp_micros(at), T.TimestampType()), text.json_value(F.lit("2024-03-10 02:30:00").cast("timestamp_ntz"), T.TimestampNTZType()))
            assert d.first()[:] == ('"2024-03-10T07:00:00.12Z"', '"1969-12-31T23:59:59.999999Z"', "d/2024-03-10", '"2024-03-10T07:00:00.12Z"', '"2024-03-10T02:30:00Z"')
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
