"""Text forms: durations, sizes, escaped paths, length-prefixed keys, JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Nanoseconds of duration units, bytes of size units.
DURATION_UNITS = {"ns": 1, "us": 1_000, "µs": 1_000, "ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000, "h": 3_600_000_000_000}
SIZE_UNITS = {"": 1, "b": 1, "kib": 1 << 10, "mib": 1 << 20, "gib": 1 << 30, "tib": 1 << 40, "kb": 10**3, "mb": 10**6, "gb": 10**9, "tb": 10**12}
NUMBER = r"(?:[0-9]+\.?[0-9]*|\.[0-9]+)"


def lookup(key: Column, values: dict) -> Column:
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def parse_duration(text: Column) -> Column:
    """Nanoseconds of texts such as 1h30m or 500ms; null where the text is none. A bare number is no duration text (but seconds, as a number)."""
    unit = "(?:ns|us|µs|ms|s|m|h)"
    terms = F.regexp_extract_all(text, F.lit(f"{NUMBER}{unit}"), F.lit(0))
    total = F.aggregate(
        terms,
        F.lit(0.0),
        lambda sum_, t: sum_ + F.regexp_extract(t, f"^({NUMBER})", 1).cast("double") * lookup(F.regexp_extract(t, f"({unit})$", 1), DURATION_UNITS).cast("double"),
    )
    signed = F.when(text.startswith("-"), -total).otherwise(total).cast("bigint")
    return F.when(text.rlike(f"^[-+]?(?:{NUMBER}{unit})+$"), signed).when(text.rlike("^[-+]?0$"), F.lit(0).cast("bigint"))


def parse_size(text: Column) -> Column:
    """Bytes of texts such as 64MiB, 1.5 GB or 512; null where the text is none."""
    t = F.trim(text)
    pattern = r"^(-?[0-9]+\.?[0-9]*|-?\.[0-9]+)\s*([A-Za-z]*)$"
    number = F.regexp_extract(t, pattern, 1).try_cast("double")
    return (number * lookup(F.lower(F.regexp_extract(t, pattern, 2)), SIZE_UNITS).cast("double")).cast("bigint")


def escape_part(part: Column) -> Column:
    return F.replace(F.replace(part, F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F"))


def joined_path(*parts: Column) -> Column:
    """Parts escaped and joined by slashes: distinct part lists give distinct texts."""
    return F.concat_ws("/", *[escape_part(p) for p in parts])


def prefixed_key(*segments: Column) -> Column:
    """Lower-case hex of each segment's length (4 bytes, big-endian) and UTF-8 bytes."""
    return F.lower(F.concat(*[F.concat(F.lpad(F.hex(F.octet_length(s)), 8, "0"), F.hex(F.encode(s, "UTF-8"))) for s in segments]))


def json_string(text: Column) -> Column:
    """A JSON string: quotes, backslash and controls escaped, U+2028 and U+2029 too, no HTML escaping."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, name in (("\b", "b"), ("\f", "f"), ("\n", "n"), ("\r", "r"), ("\t", "t")):
        out = F.replace(out, F.lit(raw), F.lit("\\" + name))
    for code in [*(c for c in range(32) if chr(c) not in "\b\f\n\r\t"), 0x2028, 0x2029]:
        out = F.replace(out, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.concat(F.lit('"'), out, F.lit('"'))


def utc(micros: Column) -> Column:
    """The UTC time without zone of microseconds since 1970, whatever the session's zone."""
    seconds = (micros.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def micros_of(at: Column) -> Column:
    """Microseconds since 1970 of a time without zone, whatever the session's zone."""
    day = F.unix_date(at.cast("date")).cast("bigint") * 86_400_000_000
    return day + F.hour(at).cast("bigint") * 3_600_000_000 + F.minute(at).cast("bigint") * 60_000_000 + (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("bigint")


def json_time(micros: Column) -> Column:
    """UTC with fraction digits as needed, from microseconds."""
    return F.concat(F.lit('"'), F.replace(utc(micros).cast("string"), F.lit(" "), F.lit("T")), F.lit('Z"'))


def shortest(x: Column) -> Column:
    """A double as text with the fewest digits that read back as itself. The platform's own text has up to two more for some numbers: where it is
    long, shorter ones are tried."""
    text, size = x.cast("string"), F.abs(x)
    digits = F.length(F.regexp_replace(F.regexp_replace(text, "E.*$", ""), "[^0-9]", ""))

    def like_text(c: Column) -> Column:
        mantissa = F.regexp_replace(F.regexp_replace(F.regexp_extract(c, "^([^e]+)e", 1), "0+$", ""), r"\.$", ".0")
        plain = F.regexp_replace(F.regexp_replace(c.cast("decimal(38,20)").cast("string"), "0+$", ""), r"\.$", ".0")
        return F.when((size >= 1e-3) & (size < 1e7), plain).otherwise(F.concat(mantissa, F.lit("E"), F.regexp_extract(c, "e(.*)$", 1).cast("int").cast("string")))

    fifteen, sixteen = F.format_string("%.14e", x), F.format_string("%.15e", x)
    return F.when(digits <= 15, text).when(fifteen.cast("double") == x, like_text(fifteen)).when(sixteen.cast("double") == x, like_text(sixteen)).otherwise(text)


def json_float(x: Column) -> Column:
    """Shortest digits, in exponent form (two exponent digits at least) from a million on and below 1e-4, as the encoder's contract pins."""
    text, size = shortest(x), F.abs(x)
    million = F.concat(F.regexp_replace(F.regexp_replace(text, r"^(-?\d)(\d{6})\.(\d+)$", "$1.$2$3"), r"\.?0+$", ""), F.lit("e+06"))
    small = F.concat(F.when(x < 0, "-0.000").otherwise("0.000"), F.regexp_replace(F.regexp_replace(text, r"^-?(\d)\.(\d+)E-4$", "$1$2"), "0+$", ""))
    power = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\.0E", "E"), r"E(\d)", "e+$1"), "E-", "e-")
    power = F.regexp_replace(power, r"(?<=e[+-])(\d)$", "0$1")
    plain = F.regexp_replace(text, r"\.0$", "")
    usual = (x == 0) | ((size >= 1e-3) & (size < 1e6))
    return F.when(usual, plain).when((size >= 1e7) | (size < 1e-4), power).when(size >= 1e6, million).otherwise(small)


def json_object(fields: dict[str, Column], optional: set[str] = frozenset()) -> Column:
    """Members in byte order of their names; a null value is written as null, or left out where the name is in ``optional``."""
    parts = []
    for name in sorted(fields, key=lambda n: n.encode()):
        member = F.concat(json_string(F.lit(name)), F.lit(":"), fields[name])
        parts.append(member if name in optional else F.coalesce(member, F.concat(json_string(F.lit(name)), F.lit(":null"))))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def json_value(value: Column, kind: T.DataType) -> Column:
    """The JSON text of a column of any type, by its schema; null where the value is null.

    A null member of a struct or map was not supplied and is left out; a null entry of a list, or a null at the top, is written as null
    by whoever asks. Names are in byte order. Bytes are base64, decimals are strings, times are UTC; a number that JSON has not
    (NaN, infinite) is a contract fault.
    """
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), json_object({f.name: json_value(value[f.name], f.dataType) for f in kind.fields}, {f.name for f in kind.fields}))
    if isinstance(kind, T.ArrayType):
        items = F.transform(value, lambda x: F.coalesce(json_value(x, kind.elementType), F.lit("null")))
        return F.when(value.isNotNull(), F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")))
    if isinstance(kind, T.MapType):
        supplied = F.filter(F.map_entries(value), lambda e: e["value"].isNotNull())
        members = F.transform(F.array_sort(F.transform(supplied, lambda e: F.struct(e["key"].cast("string").alias("k"), json_value(e["value"], kind.valueType).alias("v")))), lambda e: F.concat(json_string(e["k"]), F.lit(":"), e["v"]))
        return F.when(value.isNotNull(), F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}")))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        finite = ~F.isnan(value) & (F.abs(value) != float("inf"))
        refused = F.raise_error(F.lit("permanent_contract: JSON cannot represent NaN or Infinity")).cast("string")
        return F.when(value.isNull(), F.lit(None).cast("string")).when(finite, json_float(value.cast("double"))).otherwise(refused)
    if isinstance(kind, T.BinaryType):
        return F.concat(F.lit('"'), F.replace(F.base64(value), F.lit("\r\n"), F.lit("")), F.lit('"'))
    if isinstance(kind, T.TimestampType):
        return json_time(F.unix_micros(value))
    if isinstance(kind, T.TimestampNTZType):
        return json_time(micros_of(value))
    if isinstance(kind, (T.DecimalType, T.DateType)):
        return json_string(value.cast("string"))
    if isinstance(kind, T.VariantType):
        return F.to_json(value)
    return json_string(value) if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)) else value.cast("string")
