"""Specifications, negotiation, sources and streaming sinks."""

import json
import threading
import time
import urllib.request

import pytest
from pyspark.sql import functions as F

from tidewright.functions.predicate import compile_predicate
from tidewright.operators import dedupe
from tidewright.plans.negotiate import SinkCaps, SourceCaps, negotiate
from tidewright.plans.pipeline import Registry, check, standard
from tidewright.plans.spec import SpecError, load
from tidewright.queries.flagship import SPEC
from tidewright.sources.line_file import LineFile, lines
from tidewright.streaming.sinks import staged_commit, upsert_batches


def test_predicates_are_two_valued(spark):
    rows = [('{"a": null}',), ('{"a": ""}',), ("{}",), (None,), ('{"a": []}',), ('{"a": "0"}',), ('{"a": 0}',)]
    d = spark.createDataFrame(rows, "j string").select(F.try_parse_json("j").alias("d"))
    ask = lambda p: [r[0] for r in d.select(compile_predicate(p, F.col("d"))).collect()]
    assert ask({"path": ["a"], "op": "present"}) == [True, True, False, False, True, True, True]
    assert ask({"path": ["a"], "op": "equals", "value": ""}) == [True, True, False, False, False, False, False]
    assert ask({"path": ["a"], "op": "not_equals", "value": ""}) == [False, False, True, True, True, True, True]
    assert ask({"path": ["a"], "op": "truthy"}) == [False, False, False, False, True, True, False]
    assert ask({"any": []}) == [True] * 7
    assert ask({"path": ["a"], "op": "matches", "value": "(?=x)"}) == [False] * 7


def test_spec_is_strict_and_diagnosed_at_once():
    with pytest.raises(SpecError, match="unknown field 'grap'"):
        load(json.dumps({"id": "x", "graph": [], "grap": 1}))
    bad = load(json.dumps({"id": "x", "retry": {"terminal": "dead_letter"}, "graph": [
        {"id": "a", "kind": "source", "name": "parquet"}, {"id": "b", "kind": "sink", "name": "nowhere", "inputs": [{"from": "c"}, {"from": "b"}]}, {"id": "b", "kind": "sink", "name": "collect"},
    ]}))
    found, contract = check(bad, standard())
    assert contract is None and len(found) >= 6
    assert any("used twice" in x for x in found) and any("feeds itself" in x for x in found) and any("dead_letter" in x for x in found)


def test_check_negotiates():
    r = standard()
    r.add_source("events", lambda s, c: None, SourceCaps(stable_keys=False))
    r.add_sink("counted", lambda d, c: d, SinkCaps(commits=True))
    found, contract = check(load(json.dumps(SPEC | {"guarantee": "exactly_once"})), r)
    assert not found and contract.tier == "at_least_once" and contract.ack_point == "commit"
    assert negotiate("exactly_once", {"a": SourceCaps()}, {"x": SinkCaps(idempotent=True), "y": SinkCaps()}, {"y"}).tier == "effectively_once"
    assert negotiate("exactly_once", {"a": SourceCaps(replayable=False)}, {"x": SinkCaps(commits=True)}).tier == "at_most_once"
    with pytest.raises(ValueError, match="registered already"):
        r.add_sink("counted", None, SinkCaps())
    with pytest.raises(ValueError, match="token"):
        Registry().add_sink("t", None, SinkCaps(stores_token=True))


def test_stream_config_prefers_the_node():
    s = load(json.dumps({"id": "x", "graph": [], "streams": [{"stream": "t", "write": "append"}, {"stream": "t", "node": "k", "write": "upsert"}]}))
    assert s.stream_config("k", "t")["write"] == "upsert" and s.stream_config("j", "t")["write"] == "append" and s.stream_config("k", "u") is None


def test_line_file_splits_and_resumes(spark, tmp_path):
    path = tmp_path / "in.txt"
    body = b"".join(b"line-%05d\n" % n for n in range(1200)) + b"crlf\r\nlast"
    path.write_bytes(body)
    want = [line.rstrip(b"\r") for line in body.split(b"\n")]
    for span in (1, 7, 11, 1000, 1 << 20):
        got = [x for at in range(0, len(body), span) for x in lines(str(path), at, min(len(body), at + span))]
        assert [x[1] for x in got] == want and got[-1][0] == len(body)
        if span == 1:
            break
    spark.dataSource.register(LineFile)
    df = spark.read.format("line_file").options(path=str(path), span=4000).load()
    assert sorted(bytes(r.body) for r in df.collect()) == sorted(want)


def test_stream_commits_once_over_a_restart(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    for n in range(3):
        spark.range(n * 10, n * 10 + 10).withColumn("lane", F.col("id") % 2).coalesce(1).write.mode("append").parquet(str(source))
    write = staged_commit(out)

    def once(fail_at):
        def run(df, batch):
            write(df, batch)
            if batch == fail_at:
                raise RuntimeError("lost after publishing")

        stream = spark.readStream.schema("id long, lane long").option("maxFilesPerTrigger", 1).parquet(str(source))
        return stream.writeStream.foreachBatch(run).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()

    with pytest.raises(Exception):  # noqa: B017
        once(1).awaitTermination()
    once(None).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(f"{out}/batch=*").collect()) == list(range(30))


def test_upsert_batches_rebuilds_the_same_version(spark, tmp_path):
    write = upsert_batches(str(tmp_path / "t"), ["k"], "pos")
    first = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (1, "c", 3)], "k long, v string, pos long")
    second = spark.createDataFrame([(2, "z", 9)], "k long, v string, pos long")
    for df, n in ((first, 0), (second, 1), (second, 1)):
        write(df, n)
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "t/v=1")).select("k", "v").collect()) == [(1, "c"), (2, "z")]


def test_stream_dedupe(spark, tmp_path):
    rows = spark.sql("select id % 5 as k, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id) as at from range(20)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = dedupe.stream_dedupe(spark.readStream.schema("k long, at timestamp").parquet(str(tmp_path / "in")), ["k"], "at", "1 hour")
    q = stream.writeStream.format("memory").queryName("deduped").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("deduped").count() == 5


def test_push_inbox_acknowledges_after_commit():
    from tidewright.sources.push import Inbox

    box = Inbox(0, limit=1, timeout=5)
    status = []
    post = lambda: status.append(urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{box.port}/", data=b"x", method="POST")).status)
    t = threading.Thread(target=post)
    t.start()
    while not box.rows:
        time.sleep(0.01)
    assert not status and box.between(0, 1)[0][3] == b"x"
    with pytest.raises(urllib.error.HTTPError, match="429"):
        post()
    box.settle(1)
    t.join()
    assert status == [204]
    box.server.shutdown()


def test_push_inbox_bounds_bodies_and_joins_repeats():
    from tidewright.sources.push import Inbox

    box, status = Inbox(0, limit=5, timeout=5, most_bytes=8), []
    ask = lambda body, **headers: urllib.request.Request(f"http://127.0.0.1:{box.port}/", data=body, method="POST", headers=headers)
    with pytest.raises(urllib.error.HTTPError, match="413"):
        urllib.request.urlopen(ask(b"x" * 9))
    threads = [threading.Thread(target=lambda b=b: status.append(urllib.request.urlopen(ask(b, **{"Idempotency-Key": "k"})).status)) for b in (b"1", b"2")]
    for t in threads:
        t.start()
    while not box.rows:
        time.sleep(0.01)
    time.sleep(0.3)
    assert len(box.rows) == 1 and not status
    box.settle(1)
    for t in threads:
        t.join()
    assert status == [204, 204] and not box.keys
    box.server.shutdown()


def test_push_as_a_stream(spark, tmp_path):
    import socket

    from tidewright.sources.push import Push

    with socket.socket() as s:
        s.bind(("127.0.0.1", 0))
        port = s.getsockname()[1]
    spark.dataSource.register(Push)
    stream = spark.readStream.format("http_push").options(port=str(port), ack_timeout="60").load()
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        status, until = [], time.time() + 60
        while time.time() < until and not status:
            try:
                status.append(urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{port}/", data=b"hello", method="POST"), timeout=60).status)
            except (urllib.error.URLError, ConnectionError):
                time.sleep(0.2)  # the server begins with the first micro-batch
    finally:
        query.stop()
    assert status == [204] and [bytes(r.body) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [b"hello"]
