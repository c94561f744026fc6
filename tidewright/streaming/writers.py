"""Writers of the sinks that a specification can name. Spark's commit protocol publishes a write as a whole or not at all."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codec import resolve_chain
from ..operators.routing import blame


def storable(df: DataFrame) -> DataFrame:
    """Documents as their JSON text, which every reader knows."""
    return df.withColumn("doc", F.to_json("doc")) if "doc" in df.columns else df


def refused(df: DataFrame) -> DataFrame:
    """A record that the encoder could not take ends the write, before anything of it is published."""
    stop = F.when(F.col("fault").isNotNull() & F.col("frame").isNull(), F.raise_error(F.concat(F.lit("stopped: "), F.col("fault"))).cast("string"))
    return df.select(F.coalesce(stop, F.col("frame")).alias("frame"))


def print_lines(df: DataFrame, config: dict) -> None:
    """To standard output, one partition at a time in the driver's memory, flushed at the end."""
    for row in refused(df).toLocalIterator():
        sys.stdout.write(row.frame + "\n")
    sys.stdout.flush()


def append_lines(df: DataFrame, config: dict) -> None:
    """Appended to a folder of text files; what is there is never truncated."""
    chain, _ = resolve_chain(config.get("codec"))
    out = refused(df).write.mode("append")
    (out.option("compression", chain.compressor) if chain.compressor else out).text(config["path"])


def append_letters(df: DataFrame, config: dict) -> None:
    """Dead letters as JSON lines: where the record came from, its fault, who is to blame, and its payload."""
    letter = df.select("lane", "seq", "stream", F.col("fault").alias("class"), blame(F.col("fault")).alias("blame"), F.col("body").alias("payload"))
    letter.write.mode("append").json(config["path"])
