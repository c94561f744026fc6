"""Pipeline specifications: strict JSON to dataclasses, and all diagnostics of a graph at once."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from typing import Any

from .config import Field, validate
from .negotiate import TIERS


@dataclass
class Edge:
    source: str
    select: str = "main"
    best_effort: bool = False


@dataclass
class Node:
    id: str
    kind: str
    name: str
    config: dict[str, Any] = field(default_factory=dict)
    inputs: list[Edge] = field(default_factory=list)
    retry: dict[str, Any] | None = None


@dataclass
class Spec:
    id: str
    graph: list[Node]
    tenant: str = "default"
    guarantee: str = "at_least_once"
    retry: dict[str, Any] = field(default_factory=lambda: dict(DEFAULT_RETRY))
    clock: dict[str, Any] = field(default_factory=lambda: dict(DEFAULT_CLOCK))
    when_full: str = "block"
    lane_budget: int = 1000
    drift: str = "lenient"
    streams: list[dict[str, Any]] = field(default_factory=list)
    waivers: list[dict[str, str]] = field(default_factory=list)

    def streams_at(self, node: str) -> list[dict[str, Any]]:
        """The entries that hold at a node, one for each stream."""
        return [self.stream_config(node, name) for name in dict.fromkeys(s["stream"] for s in self.streams) if self.stream_config(node, name)]

    def stream_config(self, node: str, stream: str) -> dict[str, Any] | None:
        """The entry for a stream: one of the node's own beats one for all nodes."""
        found = [s for s in self.streams if s["stream"] == stream and s.get("node") in (None, node)]
        return max(found, key=lambda s: s.get("node") is not None, default=None)


#: What a spec may hold besides its graph: types, ranges and permitted values.
FIELDS = (
    Field("id", required=True, pattern=r"^\S+$"), Field("tenant"), Field("guarantee", "enum", values=TIERS), Field("drift", "enum", values=("lenient", "evolve", "try_evolve", "ignore", "fail")),
    Field("when_full", "enum", values=("block", "drop_newest", "reject", "overflow")), Field("lane_budget", "int", least=1), Field("graph", "array", item=Field("node", "any")),
    Field("retry", "object", fields=(
        Field("terminal", "enum", values=("stop", "drop", "dead_letter")), Field("on_indeterminate", "enum", values=("stall", "retry", "dead_letter")), Field("initial_ms", "int", least=1),
        Field("multiplier", "float", least=1), Field("max_ms", "int", least=0), Field("max_attempts", "int", least=1), Field("max_elapsed_ms", "int", least=0),
    )),
    Field("clock", "object", fields=(Field("policy", "enum", values=("pass", "clamp", "reject")), Field("max_skew_us", "int", least=0))),
    Field("streams", "array", item=Field("stream", "object", fields=(
        Field("stream", required=True), Field("node"), Field("read", "enum", values=("full_refresh", "incremental", "append_dedup")), Field("write", "enum", values=("append", "upsert", "insert", "update", "overwrite", "delete")),
        Field("key", "array", item=Field("name")), Field("dedupe", "object", fields=(Field("key", "array", item=Field("name")), Field("window_us", "int", least=0))),
    ))),
    Field("waivers", "array", item=Field("waiver", "object", fields=(Field("node", required=True), Field("missing", "array", item=Field("name")), Field("acknowledged_by"), Field("reason")))),
)
DEFAULT_RETRY = {"terminal": "stop", "on_indeterminate": "stall", "initial_ms": 100, "multiplier": 2.0, "max_ms": 30_000, "max_attempts": 5}
DEFAULT_CLOCK = {"policy": "pass", "max_skew_us": 0}


class SpecError(ValueError):
    pass


def _build(kind: type, data: Any, where: str) -> Any:
    if not isinstance(data, dict):
        raise SpecError(f"{where}: an object is expected")
    known = {f.name for f in fields(kind)}
    unknown = sorted(set(data) - known)
    if unknown:
        raise SpecError(f"{where}: unknown field {unknown[0]!r}")
    try:
        return kind(**data)
    except TypeError as e:
        raise SpecError(f"{where}: {e}") from None


def load(text: str) -> Spec:
    """Strict: a field that is not known is an error. "from" of an edge reads as its source."""
    data = json.loads(text)
    graph = []
    for n, node in enumerate(data.get("graph", [])):
        node = dict(node)
        node["inputs"] = [_build(Edge, {("source" if k == "from" else k): v for k, v in e.items()}, f"graph[{n}].inputs") for e in node.get("inputs", [])]
        graph.append(_build(Node, node, f"graph[{n}]"))
    spec = _build(Spec, data | {"graph": graph}, "spec")
    wrong = validate(data | {"graph": []}, FIELDS, "spec")
    if wrong:
        raise SpecError("; ".join(wrong))
    spec.retry, spec.clock = DEFAULT_RETRY | spec.retry, DEFAULT_CLOCK | spec.clock
    return spec


def diagnose(spec: Spec, registry: dict[str, set[str]]) -> list[str]:
    """Everything that is wrong with a spec's graph; ``registry``: kind -> names."""
    out = []
    ids = [n.id for n in spec.graph]
    by = {n.id: n for n in spec.graph}
    out += [f"{i}: the id is used twice" for i in sorted({i for i in ids if ids.count(i) > 1})]
    if spec.guarantee not in TIERS:
        out.append(f"guarantee {spec.guarantee!r} is none of {', '.join(TIERS)}")
    for n in spec.graph:
        if n.kind not in ("source", "transform", "sink", "buffer"):
            out.append(f"{n.id}: unknown kind {n.kind!r}")
        elif n.name not in registry.get(n.kind, set()):
            out.append(f"{n.id}: no {n.kind} is named {n.name!r}; there are {', '.join(sorted(registry.get(n.kind, set()))) or 'none'}")
        if n.kind == "source" and n.inputs:
            out.append(f"{n.id}: a source has no inputs")
        if n.kind != "source" and not n.inputs:
            out.append(f"{n.id}: it has no input")
        if n.kind == "buffer" and len(n.inputs) > 1:
            out.append(f"{n.id}: a buffer has one input")
        for e in n.inputs:
            if e.source == n.id:
                out.append(f"{n.id}: it feeds itself")
            elif e.source not in by:
                out.append(f"{n.id}: input {e.source!r} does not exist")
            if e.select not in ("main", "failed", "all"):
                out.append(f"{n.id}: unknown select {e.select!r}")
            elif e.select == "failed" and e.source in by and by[e.source].kind == "buffer":
                out.append(f"{n.id}: {e.source} fails no single records")
    fed = {e.source for n in spec.graph for e in n.inputs}
    out += [f"{n.id}: nothing reads it and it is no sink" for n in spec.graph if n.id not in fed and n.kind != "sink"]
    seen: dict[str, int] = {}

    def cyclic(i: str) -> bool:
        if seen.get(i) == 1:
            return True
        if seen.get(i) == 2 or i not in by:
            return False
        seen[i] = 1
        found = any(cyclic(e.source) for e in by[i].inputs if e.source != i)
        seen[i] = 2
        return found

    out += [f"{i}: it is part of a cycle" for i in by if cyclic(i)]
    if spec.when_full == "overflow":
        out.append("when_full is overflow, and no buffer holds what overflows")
    if spec.retry.get("terminal") == "dead_letter" and not any(e.select == "failed" for n in spec.graph for e in n.inputs):
        out.append("retry.terminal is dead_letter, but no edge selects failed records")
    return out
