"""Projections: field mappings, metadata filters, redaction, deep equality."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicate import resolve


def project(df: DataFrame, mapping: dict[str, dict], keep: list[str] = (), doc: str = "doc") -> DataFrame:
    """target <- payload_field (path) | payload | envelope | meta_field | origin_key | event_time | literal, with an optional default."""
    out = []
    for target, how in mapping.items():
        if "literal" in how:
            c = F.lit(how["literal"])
        elif "payload_field" in how:
            c = resolve(how["payload_field"], F.col(doc)).text
        elif "payload" in how:
            c = F.to_json(doc)
        elif "envelope" in how:
            c = F.col(how["envelope"])
        elif "meta_field" in how:
            ns, key = how["meta_field"]
            c = F.get(F.filter("meta", lambda m: (m["ns"] == ns) & (m["key"] == key)), F.lit(0))["value"]
        elif "origin_key" in how:
            c = F.col("origin.key")
        else:
            c = F.col("event_time")
        if how.get("default") is not None:
            c = F.coalesce(c, F.lit(how["default"]))
        if how.get("required"):
            c = F.coalesce(c, F.raise_error(F.lit(f"permanent_mapping: {target} is required")))
        out.append(c.alias(target))
    return df.select(*keep, *out)


def filter_meta(meta: Column, include: list[str], exclude: list[str] = ()) -> Column:
    """Entries whose ns.key matches one of ``include`` (shell patterns; none: all) and none of ``exclude``."""
    full = lambda m: F.concat_ws(".", m["ns"], m["key"])
    regex = lambda patterns: "|".join(fnmatch.translate(p).replace(r"\Z", "$").replace(r"\z", "$") for p in patterns)
    inside = lambda m: full(m).rlike(regex(include)) if include else F.lit(True)
    outside = lambda m: ~full(m).rlike(regex(exclude)) if exclude else F.lit(True)
    return F.filter(meta, lambda m: inside(m) & outside(m))


def same_value(a: Column, b: Column) -> Column:
    """Deep equality of two VARIANT values: kinds must match, so 1 is not "1" and 1.0 is not 1.00."""
    return (F.schema_of_variant(a) == F.schema_of_variant(b)) & (F.to_json(a) == F.to_json(b))


def redact(df: DataFrame, column: str, keys: list[str], mask: str = "***") -> DataFrame:
    """Text members of a JSON column, masked by name at any depth."""
    names = "|".join(map(re.escape, keys))
    return df.withColumn(column, F.regexp_replace(column, f'("(?:{names})"\\s*:\\s*)("(?:[^"\\\\\\\\]|\\\\\\\\.)*"|-?[0-9.eE+-]+|true|false|null)', f'$1"{re.escape(mask)}"'.replace("\\*", "*")))
