"""Component configuration as data: one list of fields gives validation, redaction, JSON Schema and docs."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from ..functions.text import DURATION_UNITS, NUMBER, SIZE_UNITS

#: Fixed value: what stands in place of a secret.
REDACTED = "[redacted]"
JSON_TYPES = {"string": "string", "enum": "string", "duration": "string", "size": "string", "bool": "boolean", "int": "integer", "float": "number", "object": "object", "map": "object", "array": "array", "any": None}


@dataclass(frozen=True)
class Field:
    """One member of a configuration. ``type`` is a key of JSON_TYPES or "union" (``variants``: value of ``tag`` -> fields)."""

    name: str
    type: str = "string"
    required: bool = False
    default: Any = None
    least: float | None = None
    most: float | None = None
    pattern: str | None = None
    values: tuple[str, ...] = ()
    fields: tuple[Field, ...] = ()
    item: Field | None = None
    tag: str = "type"
    variants: tuple[tuple[str, tuple[Field, ...]], ...] = ()
    secret: bool = False
    doc: str = ""

    def of_variant(self, value: Any) -> tuple[Field, ...] | None:
        chosen = dict(self.variants).get(value.get(self.tag)) if isinstance(value, dict) else None
        return None if chosen is None else (Field(self.tag, required=True), *chosen)


def duration_ns(value: Any) -> int | None:
    """Nanoseconds of a text such as 1h30m, or of a number of seconds; null where it is neither."""
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return int(value * 1_000_000_000)
    unit = "|".join(sorted(DURATION_UNITS, key=len, reverse=True))
    if not isinstance(value, str) or not re.fullmatch(rf"[-+]?(?:(?:{NUMBER}(?:{unit}))+|0)", value):
        return None
    total = sum(float(n) * DURATION_UNITS[u] for n, u in re.findall(rf"({NUMBER})({unit})", value))
    return int(-total if value[0] == "-" else total)


def size_bytes(value: Any) -> int | None:
    """Bytes of a text such as 64MiB, or of a whole number; null where it is neither."""
    if isinstance(value, int) and not isinstance(value, bool):
        return value
    found = re.fullmatch(rf"\s*(-?{NUMBER})\s*([A-Za-z]*)\s*", value) if isinstance(value, str) else None
    unit = SIZE_UNITS.get(found[2].lower()) if found else None
    return None if unit is None else int(float(found[1]) * unit)


def validate(config: Any, fields: tuple[Field, ...], where: str = "config") -> list[str]:
    """Everything that is wrong with a configuration: unknown and missing members, types, ranges, patterns, permitted values."""
    if not isinstance(config, dict):
        return [f"{where}: an object is expected, not {_kind(config)}"]
    known = {f.name: f for f in fields}
    out = [f"{where}.{name}: unknown field; there are {', '.join(known) or 'none'}" for name in config if name not in known]
    for name, f in known.items():
        if config.get(name) is None:
            out += [f"{where}.{name}: it is required"] * (f.required and f.default is None)
        else:
            out += _value(f, config[name], f"{where}.{name}")
    return out


def _kind(value: Any) -> str:
    return {bool: "a boolean", int: "an integer", float: "a number", str: "a string", list: "an array", dict: "an object", type(None): "null"}.get(type(value), type(value).__name__)


def _value(f: Field, value: Any, where: str) -> list[str]:
    wrong = [f"{where}: {f.type} is expected, not {_kind(value)}"]
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    match f.type:
        case "any":
            return []
        case "string":
            if not isinstance(value, str):
                return wrong
            return [f"{where}: it must match {f.pattern}"] if f.pattern and not re.search(f.pattern, value) else []
        case "enum":
            return wrong if not isinstance(value, str) else [] if value in f.values else [f"{where}: {value!r} is not permitted; permitted are {', '.join(f.values)}"]
        case "bool":
            return [] if isinstance(value, bool) else wrong
        case "int" | "float":
            if not number or (f.type == "int" and value != int(value)):
                return wrong
            low, high = f.least is not None and value < f.least, f.most is not None and value > f.most
            return [f"{where}: {value} is below {f.least}"] * low + [f"{where}: {value} is above {f.most}"] * high
        case "duration":
            return [] if duration_ns(value) is not None else [f'{where}: a duration is expected, for example "250ms" or "1m"']
        case "size":
            return [] if size_bytes(value) is not None else [f'{where}: a size is expected, for example "64MiB"']
        case "object":
            return validate(value, f.fields, where)
        case "array":
            return wrong if not isinstance(value, list) else [x for n, v in enumerate(value) if f.item for x in _value(f.item, v, f"{where}[{n}]")]
        case "map":
            return wrong if not isinstance(value, dict) else [x for k, v in value.items() if f.item for x in _value(f.item, v, f"{where}.{k}")]
        case "union":
            chosen = f.of_variant(value)
            return validate(value, chosen, where) if chosen is not None else [f"{where}.{f.tag}: one of {', '.join(v for v, _ in f.variants)} is expected"]
    return [f"{where}: unknown type {f.type!r}"]


def redact(config: Any, fields: tuple[Field, ...]) -> Any:
    """The configuration with every declared secret replaced, at any depth; lists are gone through with the fields of their items."""
    known = {f.name: f for f in fields}
    if isinstance(config, list):
        return [redact(x, fields) for x in config]
    if not isinstance(config, dict):
        return config
    out = {}
    for name, value in config.items():
        f = known.get(name, Field(name, "any"))
        if f.secret:
            out[name] = REDACTED
        elif f.type == "map" and f.item and isinstance(value, dict):
            out[name] = {k: redact(v, f.item.fields) for k, v in value.items()}
        else:
            inner = f.fields or (f.item.fields if f.item else ()) or (f.of_variant(value) or () if f.type == "union" else ())
            out[name] = redact(value, inner)
    return out


def json_schema(fields: tuple[Field, ...]) -> dict:
    """JSON Schema of a configuration; members that are not listed are refused."""
    return {"type": "object", "properties": {f.name: _schema(f) for f in fields}, "required": [f.name for f in fields if f.required and f.default is None], "additionalProperties": False}


def _schema(f: Field) -> dict:
    if f.type == "union":
        out: dict = {"oneOf": [json_schema((Field(f.tag, "enum", True, values=(v,)), *inner)) for v, inner in f.variants]}
    elif f.type == "object":
        out = json_schema(f.fields)
    else:
        out = {"type": JSON_TYPES[f.type]} if JSON_TYPES[f.type] else {}
    if f.item:
        out["items" if f.type == "array" else "additionalProperties"] = _schema(f.item)
    for key, value in (("enum", list(f.values)), ("minimum", f.least), ("maximum", f.most), ("pattern", f.pattern), ("default", f.default), ("description", f.doc), ("writeOnly", f.secret)):
        if value not in (None, [], "", False):
            out[key] = value
    return out


def docs(fields: tuple[Field, ...], at: str = "") -> str:
    """Markdown, from the same fields."""
    parts = []
    for f in fields:
        facts = [f"Type: `{f.type}`", "required" if f.required else "optional", *([f"default `{f.default}`"] if f.default is not None else []), *([f"one of {', '.join(f.values)}"] if f.values else [])]
        inner = f.fields or (f.item.fields if f.item else ())
        parts.append(f"### `{at}{f.name}`\n\n{', '.join(facts)}\n\n" + (f"{f.doc}\n\n" if f.doc else "") + docs(inner, f"{at}{f.name}."))
    return "".join(parts)
