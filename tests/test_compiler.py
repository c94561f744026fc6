"""Compiled specifications: terminal policy, admission, waivers, sinks, the command line."""

import json

import pytest

from tidewright.__main__ import main
from tidewright.plans.config import Field, json_schema, redact, validate
from tidewright.plans.negotiate import SinkCaps, SourceCaps
from tidewright.plans.pipeline import check, compile_plan, run, standard
from tidewright.plans.spec import SpecError, load

ROWS = [(n, "l", "s", None, body) for n, body in enumerate(['{"k": 1}', '{"k": 5}', "not json", '{"k": 9}', None])]


def spec(terminal="stop", dlq=False, **more):
    graph = [
        {"id": "in", "kind": "source", "name": "rows", "config": {"decoder": "json"}},
        {"id": "bad", "kind": "transform", "name": "mark", "config": {"where": {"path": ["k"], "op": "gt", "value": 4}, "class": "permanent_contract"}, "inputs": [{"from": "in"}]},
        {"id": "out", "kind": "sink", "name": "collect", "inputs": [{"from": "bad"}]},
    ]
    if dlq:
        graph.append({"id": "letters", "kind": "sink", "name": "collect", "inputs": [{"from": "bad", "select": "failed"}]})
    return load(json.dumps({"id": "x", "graph": graph, "retry": {"terminal": terminal}} | more))


@pytest.fixture()
def registry(spark):
    r = standard()
    r.add_source("rows", lambda s, c: s.createDataFrame(ROWS, "seq long, lane string, stream string, at long, body string"), SourceCaps())
    return r


def seqs(df):
    return sorted(r.seq for r in df.collect())


def test_stop_raises_at_the_first_fault(spark, registry):
    with pytest.raises(Exception, match="stopped: permanent"):
        compile_plan(spark, spec(), registry).sinks["out"].collect()


def test_drop_counts_what_it_drops(spark, registry):
    plan = compile_plan(spark, spec("drop"), registry)
    assert seqs(plan.sinks["out"]) == [0, 4]
    assert sorted(tuple(r) for r in plan.abandoned().collect()) == [("bad", "permanent_contract", 2), ("in", "permanent_mapping", 1)]


def test_dead_letters_come_from_every_node(spark, registry):
    plan = compile_plan(spark, spec("dead_letter", dlq=True), registry)
    assert seqs(plan.sinks["out"]) == [0, 4] and seqs(plan.sinks["letters"]) == [1, 2, 3]
    assert {(r["class"], r.records) for r in plan.abandoned().collect()} == {("permanent_mapping", 1)}


def test_admission_sheds_over_the_budget(spark, registry):
    plan = compile_plan(spark, spec("drop", when_full="drop_newest", lane_budget=2), registry)
    assert seqs(plan.sinks["out"]) == [0]
    assert ("in.shed", "shed", 3) in {tuple(r) for r in plan.abandoned().collect()}
    assert any("overflow" in x for x in check(spec("drop", when_full="overflow"), registry)[0])


def test_stream_entries_dedupe_at_the_sink(spark, registry):
    registry.add_source("twice", lambda s, c: s.createDataFrame([(n, "l", "s", 10 * n, '{"k": 0}') for n in (1, 2, 3)], "seq long, lane string, stream string, at long, body string"), SourceCaps())
    entry = {"stream": "s", "dedupe": {"key": ["lane"], "window_us": 10}}
    graph = [{"id": "in", "kind": "source", "name": "twice"}, {"id": "out", "kind": "sink", "name": "collect", "inputs": [{"from": "in"}]}]
    s = load(json.dumps({"id": "x", "graph": graph, "streams": [entry]}))
    assert seqs(compile_plan(spark, s, registry).sinks["out"]) == [1]
    s = load(json.dumps({"id": "x", "graph": graph, "streams": [{"stream": "s", "dedupe": {"key": ["lane"]}, "write": "upsert"}]}))
    found = check(s, registry)[0]
    assert any("window is required" in x for x in found) and any("to be written by upsert" in x for x in found)


def test_waivers(registry):
    asked = {"guarantee": "exactly_once"}
    assert any("exactly_once" in x for x in check(spec("drop", **asked), registry)[0])
    signed = {"node": "out", "missing": ["commits"], "acknowledged_by": "ops", "reason": "append only"}
    found, contract = check(spec("drop", **asked, waivers=[signed]), registry)
    assert not found and contract.tier == "at_least_once" and "waived by ops" in contract.warnings[0]
    for wrong in ({"reason": None}, {"missing": []}, {"node": "in"}, {"missing": ["keys"]}):
        assert check(spec("drop", **asked, waivers=[{k: v for k, v in (signed | wrong).items() if v is not None}]), registry)[0]
    registry.add_sink("whole", lambda d, c: d, SinkCaps(needs_whole_images=True))
    registry.add_source("partial", lambda s, c: None, SourceCaps(complete_images=False))
    s = load(json.dumps({"id": "x", "graph": [{"id": "a", "kind": "source", "name": "partial"}, {"id": "b", "kind": "sink", "name": "whole", "inputs": [{"from": "a"}]}]}))
    assert any("whole images" in x for x in check(s, registry)[0])


def test_spec_values_are_validated():
    for more, said in (({"lane_budget": 0}, "below 1"), ({"guarantee": "twice"}, "not permitted"), ({"retry": {"terminal": "shrug"}}, "not permitted"), ({"retry": {"tries": 1}}, "unknown field"), ({"clock": {"max_skew_us": "1"}}, "int is expected")):
        with pytest.raises(SpecError, match=said):
            load(json.dumps({"id": "x", "graph": []} | more))


def test_config_fields():
    fields = (
        Field("url", required=True, pattern="^http"), Field("wait", "duration"), Field("room", "size"), Field("n", "int", least=1, most=5), Field("mode", "enum", values=("a", "b")),
        Field("auth", "union", variants=(("basic", (Field("user"), Field("password", secret=True))), ("none", ()))), Field("parts", "array", item=Field("part", "object", fields=(Field("token", secret=True), Field("name")))),
    )
    good = {"url": "http://x", "wait": "1m30s", "room": "64MiB", "n": 3, "mode": "a", "auth": {"type": "basic", "user": "u", "password": "p"}, "parts": [{"token": "t", "name": "m"}]}
    assert validate(good, fields) == []
    bad = {"wait": "soon", "room": "big", "n": 9, "mode": "c", "auth": {"type": "x"}, "parts": [{"nam": 1}], "more": 1}
    assert len(validate(bad, fields)) == 8
    assert redact(good, fields)["auth"] == {"type": "basic", "user": "u", "password": "[redacted]"} and redact(good, fields)["parts"] == [{"token": "[redacted]", "name": "m"}]
    schema = json_schema(fields)
    assert schema["required"] == ["url"] and schema["properties"]["n"] == {"type": "integer", "minimum": 1, "maximum": 5} and schema["additionalProperties"] is False


def test_run_writes_files_and_letters(spark, tmp_path):
    source = tmp_path / "in.txt"
    source.write_text('{"k": 1}\n{"k": 5}\n{"k": 2}\n')
    graph = [
        {"id": "in", "kind": "source", "name": "line_file", "config": {"path": str(source), "decoder": "json"}},
        {"id": "bad", "kind": "transform", "name": "mark", "config": {"where": {"path": ["k"], "op": "gt", "value": 4}, "class": "permanent_mapping"}, "inputs": [{"from": "in"}]},
        {"id": "out", "kind": "sink", "name": "file", "config": {"path": str(tmp_path / "out"), "codec": {"encoder": "raw"}}, "inputs": [{"from": "bad"}]},
        {"id": "dlq", "kind": "sink", "name": "dead_letters", "config": {"path": str(tmp_path / "dlq")}, "inputs": [{"from": "bad", "select": "failed"}]},
    ]
    text = json.dumps({"id": "x", "graph": graph, "retry": {"terminal": "dead_letter"}})
    assert run(spark, load(text), standard()) == {"dlq": "written", "out": "written"}
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"k": 1}', '{"k": 2}']
    (letter,) = spark.read.json(str(tmp_path / "dlq")).collect()
    assert (letter["class"], letter.blame, letter.payload) == ("permanent_mapping", "config", '{"k": 5}')
    path = tmp_path / "spec.json"
    path.write_text(text)
    assert main(["check", str(path)]) == 0 and main(["version"]) == 0 and main(["walk"]) == 2 and main(["schema", "sink", "file"]) == 0
    path.write_text(text.replace('"raw"', '"xml"'))
    assert main(["check", str(path)]) == 1


def test_failed_writes_are_tried_again(spark, registry):
    calls, waits = [], []

    def write(df, c):
        calls.append(df.count())
        if len(calls) < 3:
            raise OSError("not now")

    registry.add_sink("shy", lambda d, c: d, SinkCaps(flushes=True), None, write)
    s = spec("drop")
    s.graph[-1].name = "shy"
    assert run(spark, s, registry, sleep=waits.append) == {"out": "written"} and calls == [2, 2, 2] and len(waits) == 2
    calls.clear()
    s.retry["max_attempts"] = 2
    with pytest.raises(OSError):
        run(spark, s, registry, sleep=waits.append)


def test_torn_last_line_waits_for_its_end(spark, tmp_path):
    from tidewright.sources.line_file import LineFileStream

    path = tmp_path / "in.txt"
    path.write_bytes(b"one\ntwo-par")
    stream = LineFileStream(str(path))
    rows, at = stream.read({"offset": 0})
    assert [bytes(r[1]) for r in rows] == [b"one"] and at == {"offset": 4}
    path.write_bytes(b"one\ntwo-partial\nthree")
    rows, at = stream.read(at)
    assert [bytes(r[1]) for r in rows] == [b"two-partial"] and [bytes(r[1]) for r in stream.readBetweenOffsets({"offset": 0}, at)] == [b"one", b"two-partial"]


def test_store_ceilings():
    from tidewright.plans.negotiate import StoreCaps, negotiate

    ask = lambda **caps: negotiate("exactly_once", {"a": SourceCaps()}, {"x": SinkCaps(commits=True)}, store=StoreCaps(**caps)).tier
    assert ask() == "exactly_once" and ask(outlives="process") == "at_least_once" and ask(atomic_keys=False) == "at_least_once"
    for caps in ({"durable_writes": False}, {"compare_and_set": False}, {"fences_epochs": False}):
        with pytest.raises(ValueError, match="durable when it returns|two workers"):
            ask(**caps)
