"""Keys and identifiers derived from content."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, StructField, StructType


def request_key(headers: list[Column], body: Column) -> Column:
    """The first header that is given, else the body's hash."""
    return F.coalesce(*headers, F.concat(F.lit("sha256:"), F.sha2(body, 256)))


def commit_id(table: Column, files: Column, mark: str = "\0") -> Column:
    """Half a SHA-256 of the table and its files, in order of name, each name ended by ``mark``."""
    return F.substring(F.sha2(F.concat(table, F.lit(mark), F.array_join(F.transform(F.array_sort(files), lambda f: F.concat(f, F.lit(mark))), "")), 256), 1, 32)


def fingerprint(normal_form: Column) -> Column:
    return F.substring(F.sha2(normal_form, 256), 1, 32)


def normal_form(schema: StructType, keys: list[str] = (), opened: bool = False) -> str:
    """A schema as text, the same for the same schema: keys, then each field's name, type, whether it may be null, and its logical type."""
    parts = ["open;" if opened else "", *(f"k:{k};" for k in keys), *map(_field_form, schema.fields)]
    return "s{" + "".join(parts) + "}"


def _field_form(field: StructField) -> str:
    kind, more = field.dataType, ""
    if isinstance(kind, DecimalType):
        more = f";l:p{kind.precision}:s{kind.scale}"
    if isinstance(kind, StructType):
        more = ";" + "".join(map(_field_form, kind.fields))
    return f"f{{{field.name}:{TYPE_NAMES.get(kind.typeName(), kind.typeName())}{';null' if field.nullable else ''}{more}}}"


#: Names of plain types in the normal form, where Spark has another.
TYPE_NAMES = {"byte": "int8", "short": "int16", "integer": "int32", "long": "int64", "float": "float32", "double": "float64", "boolean": "bool", "binary": "bytes"}


def schema_fingerprint(schema: StructType | None, keys: list[str] = (), opened: bool = False) -> str:
    """32 hex digits; that of no schema is all zeros, so that no schema and an empty one differ."""
    return "0" * 32 if schema is None else hashlib.sha256(normal_form(schema, keys, opened).encode()).hexdigest()[:32]
