"""Streaming writes whose repetition changes nothing: the batch id is the transaction's name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def staged_commit(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: stage the batch under its id, then publish it by one rename. A batch that is published is not written again."""

    def write(df: DataFrame, batch: int) -> None:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        stage, final = (jvm.org.apache.hadoop.fs.Path(f"{path}/{sub}batch={batch}") for sub in ("_staged/", ""))
        fs = final.getFileSystem(conf)
        if fs.exists(final):  # published before a restart
            return
        df.write.mode("overwrite").parquet(stage.toString())
        fs.mkdirs(final.getParent())
        if not fs.rename(stage, final) and not fs.exists(final):
            raise RuntimeError(f"batch {batch} could not be published")

    return write


def upsert_batches(path: str, key: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: a new version of a keyed table for each batch, named by the batch id and built on the last lower one. The version
    before stays for readers and for a repeated batch; older ones go."""
    from ..operators.modes import last_per_key, upsert

    def write(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        versions = [int(s.getPath().getName().removeprefix("v=")) for s in (fs.listStatus(root) if fs.exists(root) else []) if s.getPath().getName().startswith("v=")]
        older = max((v for v in versions if v < batch), default=None)
        new = last_per_key(df, key, order).drop(order) if older is None else upsert(spark.read.parquet(f"{path}/v={older}"), df, key, order)
        new.write.mode("overwrite").parquet(f"{path}/v={batch}")
        for old in versions:
            if older is not None and old < older:
                fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v={old}"), True)

    return write


def with_lateness(df: DataFrame, at: str, delay: str) -> DataFrame:
    return df.withWatermark(at, delay)


def progress_rows(query) -> list[dict]:
    """Status of a running query, as rows: what is not reported is null."""
    return [{"batch": p["batchId"], "rows": p.get("numInputRows"), "per_second": p.get("processedRowsPerSecond"), "sources": len(p.get("sources", []))} for p in query.recentProgress]


def count_by_lane(df: DataFrame) -> DataFrame:
    return df.groupBy("lane").agg(F.count("*").alias("records"))
