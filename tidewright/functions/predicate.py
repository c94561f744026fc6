"""The closed predicate vocabulary, compiled to boolean Columns that are never null.

A predicate is a dict: {"path": [...], "op": ..., "value"/"values"/"other": ...} and/or "all", "any", "not"; what stands side by side is ANDed.
Paths start in the payload (a VARIANT), or are ["meta", ns, key], or one of the envelope's names.
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import parse_duration, parse_size

ENVELOPE = ("dest", "stream", "key", "op", "tx_id")


class Value:
    """A resolved path: whether it is there, whether it is an explicit null, its kind, and its text."""

    def __init__(self, present: Column, null: Column, kind: Column, text: Column):
        self.present, self.null, self.kind, self.text = F.coalesce(present, F.lit(False)), F.coalesce(null, F.lit(False)), kind, text
        self.number = text.try_cast("double")

    def shown(self) -> Column:
        """Text for comparing: an explicit null reads as the empty string."""
        return F.when(self.null, F.lit("")).otherwise(self.text)


def resolve(path: list[str], doc: Column, envelope: dict[str, Column] | None = None, meta: Column | None = None) -> Value:
    envelope = envelope or {}
    if len(path) == 1 and path[0] in ENVELOPE:
        c = envelope.get(path[0], F.lit(None).cast("string"))
        return Value(c.isNotNull(), F.lit(False), F.lit("string"), c.cast("string"))
    if len(path) == 3 and path[0] == "meta" and meta is not None:
        c = F.get(F.filter(meta, lambda m: (m["ns"] == path[1]) & (m["key"] == path[2])), F.lit(0))["value"]
        return Value(c.isNotNull(), F.lit(False), F.lit("string"), c.cast("string"))
    found = doc
    for segment in path:
        found = member(found, segment)
    kind = F.regexp_extract(F.schema_of_variant(found), r"^[A-Z]+", 0)
    return Value(found.isNotNull(), F.is_variant_null(found), kind, F.try_variant_get(found, "$", "string"))


def member(doc: Column, name: str) -> Column:
    """A member of an object by any name; names that a path expression cannot hold are looked up in the object as a map."""
    if name and not re.search(r"['\\?]", name):
        return F.try_variant_get(doc, f"$['{name}']", "variant")
    return F.get(F.map_values(F.map_filter(F.try_variant_get(doc, "$", "map<string,variant>"), lambda k, _: k == name)), F.lit(0))


def literal(value: Any) -> Value:
    text = {True: "true", False: "false"}.get(value) if isinstance(value, bool) else None if value is None else str(value)
    kind = {bool: "BOOLEAN", int: "BIGINT", float: "DOUBLE", str: "STRING"}.get(type(value), "VOID")
    return Value(F.lit(True), F.lit(value is None), F.lit(kind), F.lit(text).cast("string"))


def loosely_equal(a: Value, b: Value) -> Column:
    """As numbers where both read as numbers, else as text."""
    numbers = a.number.isNotNull() & b.number.isNotNull() & ~a.null & ~b.null
    return F.coalesce(F.when(numbers, a.number == b.number).otherwise(a.shown() == b.shown()), F.lit(False))


def quantity(v: Value) -> Column:
    """A number, else a duration in nanoseconds, else a size in bytes, else null."""
    return F.coalesce(v.number, parse_duration(v.text).cast("double"), parse_size(v.text).cast("double"))


def truthy(v: Value) -> Column:
    empty = v.null | (v.kind == "VOID") | ((v.kind == "BOOLEAN") & (v.text == "false")) | ((v.kind == "STRING") & (v.text == ""))
    zero = v.kind.isin("BIGINT", "DOUBLE", "DECIMAL", "FLOAT") & (v.number == 0)
    return v.present & ~F.coalesce(empty, F.lit(False)) & ~F.coalesce(zero, F.lit(False))


def compile_predicate(p: dict | None, doc: Column, envelope: dict[str, Column] | None = None, meta: Column | None = None) -> Column:
    if p is None:
        return F.lit(True)
    parts: list[Column] = []
    sub = lambda q: compile_predicate(q, doc, envelope, meta)
    if p.get("all"):
        parts.extend(map(sub, p["all"]))
    if p.get("any"):
        some = F.lit(False)
        for q in p["any"]:
            some = some | sub(q)
        parts.append(some)
    if p.get("not") is not None:
        parts.append(~sub(p["not"]))
    if "path" in p:
        left = resolve(p["path"], doc, envelope, meta)
        op = p.get("op", "truthy")
        right = resolve(p["other"], doc, envelope, meta) if "other" in p else literal(p.get("value"))
        there = left.present & right.present
        if op == "present":
            leaf = left.present
        elif op == "truthy":
            leaf = truthy(left)
        elif op == "equals":
            leaf = there & loosely_equal(left, right)
        elif op == "not_equals":  # holds where the left side is absent, but never without a right side
            leaf = right.present & ~(left.present & loosely_equal(left, right))
        elif op == "in":
            leaf = F.lit(False)
            for v in p.get("values", []):
                leaf = leaf | (left.present & loosely_equal(left, literal(v)))
        elif op in ("gt", "lt"):
            a, b = quantity(left), quantity(right)
            leaf = there & F.coalesce(a > b if op == "gt" else a < b, F.lit(False))
        elif op == "matches":
            leaf = left.present & F.coalesce(left.shown().rlike(p["value"]), F.lit(False)) if compiles(p["value"]) else F.lit(False)
        else:
            raise ValueError(f"unknown predicate {op!r}")
        parts.append(leaf)
    out = F.lit(True)
    for part in parts:
        out = out & part
    return F.coalesce(out, F.lit(False))


def compiles(pattern: str) -> bool:
    """Whether a pattern is in the subset that all the regex dialects here share: no look-around, no back references."""
    if re.search(r"\(\?[=!<]|\\[1-9]|\(\?>|[*+?}]\+", pattern):
        return False
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True
