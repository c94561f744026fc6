"""Encoders, framers and decoders as Columns and DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from . import text as T


def encode_raw(body: Column) -> Column:
    """Bytes as they are; null where a record has none, see ``raw_fault``."""
    return body


def raw_fault(body: Column) -> Column:
    """Why a record cannot be written raw: it holds no bytes, only a structure."""
    return F.when(body.isNull(), F.lit("permanent_contract"))


def requests(df: DataFrame, by: list[str], order: str, body: Column, framed: bool) -> DataFrame:
    """What a byte sink is sent: with a framer one frame for each batch (``by``), without one a request for each record."""
    if framed:
        return frame_lines(df, by, order, body)
    return df.select(*by, F.col(order).alias("request"), body.alias("frame"), F.lit(1).alias("records"))


@dataclass(frozen=True)
class Chain:
    """A sink's resolved codec."""

    encoder: str
    framer: str | None
    compressor: str | None
    notes: tuple[str, ...]

    def encode(self, df: DataFrame) -> DataFrame:
        """``frame`` (text) of each record; a record that its encoder cannot take bears a fault."""
        how, fault = ENCODERS[self.encoder]
        return df.withColumn("fault", F.coalesce("fault", fault(df))).withColumn("frame", how(df))


def _json(df: DataFrame) -> Column:
    """The decoded payload where there is one; else the bytes, which JSON can only hold as base64."""
    doc = F.to_json("doc") if "doc" in df.columns else F.lit(None).cast("string")
    return F.coalesce(doc, T.json_value(F.col("body").cast("binary"), BinaryType()), F.lit("null"))


#: name -> (text of a record, its fault); framers and compressors by name, the latter as Spark's writers know them.
ENCODERS: dict[str, tuple[Callable[[DataFrame], Column], Callable[[DataFrame], Column]]] = {
    "json": (_json, lambda df: F.lit(None).cast("string")),
    "raw": (lambda df: F.col("body").cast("string"), lambda df: raw_fault(F.col("body"))),
}
FRAMERS = ("newline",)
COMPRESSORS = ("gzip", "bzip2", "deflate", "snappy", "lz4", "zstd")


def resolve_chain(config: dict | None) -> tuple[Chain | None, list[str]]:
    """The chain that a sink's ``codec`` block asks for, or everything that is wrong with it. What the engine fills in is noted as such."""
    config, wrong, notes = config or {}, [], ()
    wrong += [f"codec.{name}: unknown field" for name in config if name not in ("encoder", "framer", "compressor")]
    if "encoder" not in config:
        notes = ("codec.encoder is json by default, which writes bytes as base64",)
    for part, known in (("encoder", ENCODERS), ("framer", FRAMERS), ("compressor", COMPRESSORS)):
        name = config.get(part)
        if name is not None and name not in known:
            wrong.append(f"no {part} is named {name!r}; there are {', '.join(known)}")
    return (None, wrong) if wrong else (Chain(config.get("encoder", "json"), config.get("framer"), config.get("compressor"), notes), [])


def decode_json(df: DataFrame, body: str = "body") -> DataFrame:
    """doc (VARIANT) of a JSON body; a body that is none bears a fault, which an earlier one outranks."""
    out = df.withColumn("doc", F.try_parse_json(F.col(body).cast("string")))
    malformed = F.when(F.col(body).isNotNull() & F.col("doc").isNull(), F.lit("permanent_mapping"))
    return out.withColumn("fault", F.coalesce(F.col("fault"), malformed) if "fault" in df.columns else malformed)


def decimal_text(unscaled: Column, scale: int) -> Column:
    """Plain digits of an integer times 10**-scale, by text: any number of digits, zeros appended where the scale is negative."""
    digits = F.regexp_replace(unscaled.cast("string"), "^-", "")
    sign = F.when(unscaled.cast("string").startswith("-"), "-").otherwise("")
    if scale <= 0:
        return F.when(digits == "0", "0").otherwise(F.concat(sign, digits, F.lit("0" * -scale)))
    wide = F.lpad(digits, F.greatest(F.length(digits), F.lit(scale + 1)), F.lit("0"))
    return F.concat(sign, F.substr(wide, F.lit(1), F.length(wide) - scale), F.lit("."), F.right(wide, F.lit(scale)))


def frame_lines(df: DataFrame, by: list[str], order: str, line: Column) -> DataFrame:
    """One frame for each group: its lines in order, each ended by a newline; the group should be one request's batch."""
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line"))))
    out = df.groupBy(*by).agg(lines.alias("lines"))
    return out.select(*by, F.concat(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("\n")).alias("frame"), F.size("lines").cast("bigint").alias("records"))


def decode_lines(df: DataFrame, frame: str, keep: list[str]) -> DataFrame:
    """One row for each line of a frame; the end of the last line opens no further one."""
    return df.select(*keep, F.explode(F.split(F.regexp_replace(frame, "\n$", ""), "\n")).alias("line"))


def decode_sized(df: DataFrame, frame: str, keep: list[str], width: int = 4) -> DataFrame:
    """One row for each record of a frame (binary) of records that follow their big-endian length of ``width`` bytes; a cut last record is a fault."""
    length = lambda at: F.conv(F.hex(F.substr(F.col(frame), at, F.lit(width))), 16, 10).cast("int")
    step = lambda s, _: F.when(s["at"] > F.octet_length(frame), s).otherwise(F.struct((s["at"] + width + F.coalesce(length(s["at"]), F.lit(0))).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts")))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("starts"))
    most = F.greatest(F.floor(F.octet_length(frame) / width).cast("int"), F.lit(0))
    starts = F.aggregate(F.sequence(F.lit(0), most), start, step)["starts"]
    out = df.select("*", F.explode(starts).alias("_at")).withColumn("_n", length(F.col("_at")))
    body = F.substr(F.col(frame), F.col("_at") + width, F.col("_n"))
    cut = F.col("_n").isNull() | (F.col("_at") + width + F.col("_n") - 1 > F.octet_length(frame))
    return out.select(*keep, F.when(~cut, body).alias("body"), F.when(cut, F.lit("permanent_mapping")).alias("fault"))


def decompress(df: DataFrame, column: str, how: str) -> DataFrame:
    """A binary column without its gzip, zlib or bzip2 compression; null, with a fault, where it is not that."""
    import bz2
    import gzip
    import zlib

    unpack = {"gzip": gzip.decompress, "zlib": zlib.decompress, "bzip2": bz2.decompress}[how]

    @F.pandas_udf("binary")
    def plain(packed: pd.Series) -> pd.Series:
        def one(x):
            try:
                return None if x is None else unpack(bytes(x))
            except (OSError, EOFError, ValueError, zlib.error):
                return None

        return packed.map(one)

    out = df.withColumn("_plain", plain(column))
    broken = F.when(F.col(column).isNotNull() & F.col("_plain").isNull(), F.lit("permanent_mapping"))
    out = out.withColumn("fault", F.coalesce(F.col("fault"), broken) if "fault" in df.columns else broken)
    return out.withColumn(column, F.col("_plain")).drop("_plain")
