"""The registry, and the derived tables that queries and their SQL share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import micros_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    return micros_of(F.col(ts))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream: seq, lane, stream, key, tm (microseconds), body, value."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), (F.col("user_id") % 8).alias("lane"), F.col("event_type").alias("stream"), F.col("user_id").alias("key"),
        micros("ts").alias("tm"), F.col("props").alias("body"), "value",
    )


EVENTS = "(SELECT event_id AS seq, user_id % 8 AS lane, event_type AS stream, user_id AS key, epoch_us(ts) AS tm, props AS body, value FROM events)"
