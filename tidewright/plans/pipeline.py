"""Compiles a specification to DataFrames: one for each sink, by edges, clock rule, transforms and codecs."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import decode_json, frame_lines, resolve_chain
from ..functions.predicate import compile_predicate
from ..operators import dedupe, flow, routing, shape
from ..streaming import writers
from .config import Field, validate
from .negotiate import Contract, SinkCaps, SourceCaps, apply_waivers, capability_gaps, negotiate
from .spec import Node, Spec, SpecError, diagnose

Source = Callable[[SparkSession, dict], DataFrame]
Transform = Callable[[DataFrame, dict], DataFrame]
Writer = Callable[[DataFrame, dict], None]


class Registry:
    """Components by kind and name. Sources give seq, lane, stream, at, body; transforms and sinks take and give such tables."""

    def __init__(self):
        self.sources: dict[str, tuple[Source, SourceCaps]] = {}
        self.transforms: dict[str, Transform] = {}
        self.sinks: dict[str, tuple[Transform, SinkCaps]] = {}
        self.writers: dict[str, Writer] = {}
        self.fields: dict[tuple[str, str], tuple[Field, ...]] = {}

    def add_source(self, name: str, make: Source, caps: SourceCaps, fields: tuple[Field, ...] | None = None) -> None:
        self._new(self.sources, name)
        self.sources[name] = make, caps
        self._describe("source", name, fields)

    def add_transform(self, name: str, make: Transform, fields: tuple[Field, ...] | None = None) -> None:
        self._new(self.transforms, name)
        self.transforms[name] = make
        self._describe("transform", name, fields)

    def add_sink(self, name: str, make: Transform, caps: SinkCaps, fields: tuple[Field, ...] | None = None, write: Writer | None = None) -> None:
        """``make`` gives what the sink is sent; ``write``, if there is one, writes that, and must be harmless when it is repeated or say so."""
        self._new(self.sinks, name)
        if caps.stores_token and not caps.commits:
            raise ValueError(f"{name}: a token is stored with a commit, and it declares none")
        self.sinks[name] = make, caps
        if write is not None:
            self.writers[name] = write
        self._describe("sink", name, fields)

    def _describe(self, kind: str, name: str, fields: tuple[Field, ...] | None) -> None:
        if fields is not None:
            self.fields[kind, name] = fields

    def lint(self) -> list[str]:
        """What registered sinks declare and cannot do, or could do and do not declare."""
        out = [f"{name}: it declares a durable flush or commit and has no writer" for name, (_, c) in sorted(self.sinks.items()) if (c.flushes or c.commits) and name not in self.writers]
        return out + [f"{name}: it has a writer and declares neither flush nor commit, so writes count as durable at once" for name in sorted(self.writers) if not (self.sinks[name][1].flushes or self.sinks[name][1].commits)]

    @staticmethod
    def _new(kind: dict, name: str) -> None:
        if name in kind:
            raise ValueError(f"{name} is registered already")

    def names(self) -> dict[str, set[str]]:
        return {"source": set(self.sources), "transform": set(self.transforms), "sink": set(self.sinks), "buffer": {"none"}}


DECODER = Field("decoder", "enum", values=("json", "none"), doc="json: a body that is no JSON bears a fault")


def _holds(c: dict) -> Column:
    return compile_predicate(c["where"], F.col("doc"), {"stream": F.col("stream")})


def _encoded(df: DataFrame, c: dict) -> DataFrame:
    """What a byte sink is sent: its chain's text of each record; records that the encoder refuses stay behind with their fault."""
    chain, _ = resolve_chain(c.get("codec"))
    return chain.encode(df)


def standard() -> Registry:
    any_of = lambda name, **more: Field(name, "any", **more)
    codec, path = Field("codec", "object", fields=(Field("encoder"), Field("framer"), Field("compressor"))), Field("path", required=True)
    r = Registry()
    r.add_source("parquet", lambda spark, c: spark.read.parquet(c["path"]), SourceCaps(), (path, DECODER))
    r.add_source("table", lambda spark, c: spark.table(c["name"]), SourceCaps(), (Field("name", required=True), DECODER))
    r.add_source("line_file", line_records, SourceCaps(stable_keys=False), (path, DECODER, Field("stream"), Field("span", "int", least=1)))
    r.add_transform("filter", lambda df, c: df.where(_holds(c)), (any_of("where", required=True),))
    r.add_transform("route", lambda df, c: df.withColumn("dest", F.coalesce(*[F.when(_holds(w), F.lit(w["dest"])) for w in c["rules"]], F.lit(c.get("default")))), (any_of("rules", required=True), Field("default")))
    r.add_transform("mark", lambda df, c: df.withColumn("fault", F.coalesce("fault", F.when(_holds(c), F.lit(c["class"])))), (any_of("where", required=True), Field("class", "enum", required=True, values=tuple(routing.FAULT_CLASSES))))
    r.add_transform("redact", lambda df, c: shape.redact(df, "body", c["keys"], c.get("mask", "***")), (Field("keys", "array", required=True, item=Field("key")), Field("mask")))
    r.add_sink("collect", lambda df, c: df, SinkCaps(), ())
    r.add_sink("discard", lambda df, c: df, SinkCaps(idempotent=True), (), lambda df, c: df.write.format("noop").mode("overwrite").save())
    r.add_sink("ndjson", lambda df, c: frame_lines(flow.batch_count(df, ["lane"], "seq", c.get("batch", 1000)), ["lane", "batch"], "seq", F.col("body")), SinkCaps(), (Field("batch", "int", least=1, default=1000),))
    r.add_sink("stdout", _encoded, SinkCaps(), (codec,), writers.print_lines)
    r.add_sink("file", _encoded, SinkCaps(flushes=True), (path, codec), writers.append_lines)
    r.add_sink("parquet", lambda df, c: df, SinkCaps(flushes=True), (path,), lambda df, c: writers.storable(df).write.mode("append").parquet(c["path"]))
    r.add_sink("dead_letters", lambda df, c: df, SinkCaps(flushes=True), (path,), writers.append_letters)
    return r


def line_records(spark: SparkSession, c: dict) -> DataFrame:
    """Lines of a file as records: seq is the offset behind the line, the file is the lane."""
    from ..sources.line_file import LineFile

    spark.dataSource.register(LineFile)
    rows = spark.read.format("line_file").options(**{k: str(c[k]) for k in ("path", "span") if k in c}).load()
    return rows.select(F.col("offset").alias("seq"), F.lit(c["path"]).alias("lane"), F.lit(c.get("stream", "lines")).alias("stream"), F.lit(None).cast("bigint").alias("at"), F.col("body").cast("string").alias("body"))


def check(spec: Spec, registry: Registry) -> tuple[list[str], Contract | None]:
    """Diagnostics, and the contract if there are none; no job runs."""
    found = diagnose(spec, registry.names())
    if found:
        return found, None
    for n in spec.graph:
        if (n.kind, n.name) in registry.fields:
            found += validate(n.config, registry.fields[n.kind, n.name], n.id)
        if n.kind == "sink" and "codec" in n.config:
            found += [f"{n.id}: {x}" for x in resolve_chain(n.config["codec"])[1]]
    sources = {n.id: registry.sources[n.name][1] for n in spec.graph if n.kind == "source"}
    data = {n.id: registry.sinks[n.name][1] for n in spec.graph if n.kind == "sink" and any(e.select != "failed" for e in n.inputs)}
    best_effort = {n.id for n in spec.graph if n.kind == "sink" and n.inputs and all(e.best_effort for e in n.inputs)}
    errors, warnings = apply_waivers(capability_gaps(spec.guarantee, sources, {k: v for k, v in data.items() if k not in best_effort}, spec.streams_at), spec.waivers)
    if found + errors:
        return found + errors, None
    contract = negotiate(spec.guarantee, sources, data, best_effort)
    contract.warnings += warnings
    return [], contract


@dataclass
class Plan:
    """What each sink is given, and what a terminal policy took out on the way (node, class, records are its counts)."""

    sinks: dict[str, DataFrame]
    given_up: dict[str, DataFrame]

    def abandoned(self) -> DataFrame | None:
        """node, class, records of what was dropped or dead-lettered; None where no node can give up records."""
        parts = [df.groupBy(F.lit(node).alias("node"), F.col("fault").alias("class")).agg(F.count(F.lit(1)).alias("records")) for node, df in sorted(self.given_up.items())]
        out = parts[0] if parts else None
        for part in parts[1:]:
            out = out.unionByName(part)
        return out


def compile_spec(spark: SparkSession, spec: Spec, registry: Registry, now_us: int | None = None) -> dict[str, DataFrame]:
    """Sink id -> what it is given. Nothing runs until a sink is written; Catalyst sees each branch as one plan."""
    return compile_plan(spark, spec, registry, now_us).sinks


def compile_plan(spark: SparkSession, spec: Spec, registry: Registry, now_us: int | None = None) -> Plan:
    """The plan of a spec, with its terminal policy, admission, clock rule and stream entries.

    A record that fails at a node leaves it by the edges that select failed records. Where no edge does, ``retry.terminal`` decides: stop
    raises when such a record comes by, drop takes it out and counts it, dead_letter sends it to the sinks that read failed records of
    any node, as well as counting it. No failed record goes on as if nothing had happened, and none vanishes uncounted.
    """
    found, _ = check(spec, registry)
    if found:
        raise SpecError("; ".join(found))
    made: dict[str, DataFrame] = {}
    given_up: dict[str, DataFrame] = {}
    by = {n.id: n for n in spec.graph}
    handled = {e.source for n in spec.graph for e in n.inputs if e.select in ("failed", "all")}
    letter_sinks = {n.id for n in spec.graph if n.kind == "sink" and any(e.select == "failed" for e in n.inputs)}
    how = spec.retry["terminal"]

    def admit(df: DataFrame, node: Node) -> DataFrame:
        df = decode_json(df) if node.config.get("decoder") == "json" else df.withColumn("doc", F.try_parse_json("body"))
        df = df if "fault" in df.columns else df.withColumn("fault", F.lit(None).cast("string"))
        if now_us is not None:
            df = routing.clock(df, spec.clock["policy"], F.lit(now_us), spec.clock["max_skew_us"])
        if spec.when_full in ("drop_newest", "reject"):
            shed = flow.shed_newest(df, ["lane"], "seq", spec.lane_budget)
            given_up[f"{node.id}.shed"] = shed.where("not admitted").withColumn("fault", F.lit("shed"))
            df = shed.where("admitted").drop("admitted")
        return df

    def dispose(df: DataFrame, node: str) -> DataFrame:
        if node in handled:
            return df
        parts = routing.fault_terminal(df, how)
        if how != "stop":
            given_up[node] = parts["abandoned"]
        return parts["main"]

    def build(i: str) -> DataFrame:
        if i in made:
            return made[i]
        node = by[i]
        if node.kind == "source":
            df = dispose(admit(registry.sources[node.name][0](spark, node.config), node), i)
        else:
            parts = [routing.edge(build(e.source), e.select) for e in node.inputs]
            if i in letter_sinks and how == "dead_letter":
                parts += [df for name, df in sorted(given_up.items()) if not name.endswith(".shed")]
            df = parts[0]
            for part in parts[1:]:
                df = df.unionByName(part, allowMissingColumns=True)
            if node.kind == "transform":
                df = dispose(registry.transforms[node.name](df, node.config), i)
            elif node.kind == "sink":
                for entry in spec.streams_at(i):
                    df = _by_entry(df, entry)
                df = registry.sinks[node.name][0](df, node.config)
        made[i] = df
        return df

    for n in spec.graph:
        if n.id not in letter_sinks:
            build(n.id)  # first, so that what they give up is known
    return Plan({n.id: build(n.id) for n in spec.graph if n.kind == "sink"}, given_up)


def _by_entry(df: DataFrame, entry: dict) -> DataFrame:
    """A stream entry at a sink: within its window a repeat of a key is not sent again (and counts as delivered)."""
    rule = entry.get("dedupe")
    if not rule:
        return df
    mine = F.col("stream") == entry["stream"]
    marked = dedupe.mark_duplicates(df.where(mine), rule.get("key") or ["lane", "seq"], "at", rule["window_us"], ["seq"])
    return df.where(~F.coalesce(mine, F.lit(False))).unionByName(marked.where("not duplicate").drop("duplicate"))


def run(spark: SparkSession, spec: Spec, registry: Registry, now_us: int | None = None, sleep: Callable[[float], None] = time.sleep) -> dict[str, str]:
    """Write every sink that has a writer: sink id -> "written" or "skipped". Dead letters are written before anything counts as given up.

    A failed write is tried again by the retry policy, if the sink can take it twice or had not begun; then its error ends the run.
    """
    plan = compile_plan(spark, spec, registry, now_us)
    by, done = {n.id: n for n in spec.graph}, {}
    letters_first = sorted(plan.sinks, key=lambda i: (not any(e.select == "failed" for e in by[i].inputs), i))
    for i in letters_first:
        node = by[i]
        write = registry.writers.get(node.name)
        if write is None:
            done[i] = "skipped"
            continue
        policy, attempt = spec.retry | (node.retry or {}), 1
        while True:
            try:
                write(plan.sinks[i], node.config)
                break
            except Exception as e:
                again = registry.sinks[node.name][1].idempotent or registry.sinks[node.name][1].flushes or policy["on_indeterminate"] == "retry"
                if "stopped: " in str(e) or not again or attempt >= policy["max_attempts"]:
                    raise
                top = min(float(policy["max_ms"] or routing.UNBOUNDED_MS), policy["initial_ms"] * max(1.0, policy["multiplier"]) ** (attempt - 1))
                sleep(random.uniform(0, top) / 1000)
                attempt += 1
        done[i] = "written"
    return done
