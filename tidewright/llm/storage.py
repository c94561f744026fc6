"""Where intermediate tables live: a folder that the driver and every executor share."""

from __future__ import annotations

import ctypes
import os
import re
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Spark's setting for the bytes of a batch that goes to a Python worker, and its most here.
ARROW_BYTES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20

#: Most labels whose counts are sent to every task.
SENT_LABELS = 100_000

#: The tables that the running stage has made, where one runs, and those of the stage before.
_RUNNING: list[DataFrame] | None = None
_BEFORE: list[DataFrame] = []


@contextmanager
def stage_tables() -> Iterator[None]:
    """Around the code that plans a stage of a pipeline: the tables it works with go when the next stage begins, as its result has
    been written then. Tables that are made outside a stage are left alone, whatever a stage raises."""
    global _RUNNING
    drop_stage_tables()
    _RUNNING = []
    try:
        yield
    finally:
        _BEFORE.extend(_RUNNING)
        _RUNNING = None


def drop_stage_tables() -> None:
    """Delete what the last stage worked with, once its result has been written."""
    while _BEFORE:
        drop_materialized(_BEFORE.pop())


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset, a temporary folder is set in local mode (tests); on a cluster it raises, as
    executors could not read one another's files."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jvm_dir.get() if jvm_dir.isDefined() else None
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidewright-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def file_options(spark: SparkSession) -> dict[str, str]:
    """Options of writes that leave out checksum files beside local files; folders of another scheme than file:// ignore them, and a site's own
    class for local files stays. Without its native library Hadoop starts a command (chmod) for each folder, file and checksum file that it
    creates, and until such a child has become that command it shares the executor's memory, which is counted once more with it."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    if conf.get("fs.file.impl") or spark.conf.get("fs.file.impl", None):
        return {}
    return {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def materialize(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends here and survives a lost executor.

    Within a stage of a pipeline the table goes when the next one begins, unless ``keep``; else it stays until ``drop_application_tables``.
    Pages are checked by their own checksums when they are read.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewright/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{label}"
    df.write.mode("error").options(**file_options(spark)).option("parquet.page.write-checksum.enabled", "true").parquet(path)
    out = spark.read.schema(df.schema).option("parquet.page.verify-checksum.enabled", "true").parquet(path)
    if _RUNNING is not None and not keep:
        _RUNNING.append(out)
    return out


def drop_application_tables(spark: SparkSession) -> None:
    """Delete all tables that this application has materialized, once none of their readers is needed any more."""
    _delete(spark, f"{shared_dir(spark)}/tidewright/{spark.sparkContext.applicationId}")


def portions(batch: pa.RecordBatch, column: int, most_bytes: int, most_rows: int = 256) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of at most ``most_rows`` rows and, but for single rows, ``most_bytes`` bytes in ``column``."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).tolist()
    start, held = 0, 0
    for n, length in enumerate(lengths):
        if n > start and (n - start >= most_rows or held + length > most_bytes):
            yield batch.slice(start, n - start)
            start, held = n, 0
        held += length
    if lengths:
        yield batch.slice(start)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker gives back the memory it no longer uses: idle workers stay, and count against their executor."""

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # another C library
                ctypes.CDLL(None).malloc_trim(0)

    return call


def chosen_rows(known: DataFrame, label: str, salt: int, most_each: int, most_rows: int) -> DataFrame:
    """(i, y, n): of the rows (i: id, y: label) ``most_each`` of each label or all there are, least hash of the id first, numbered
    alike; at most ``most_rows`` in all, whatever the number of labels. Rows that surely are not among them leave no task."""
    counts = materialize(known.groupBy("y").agg(F.count(F.lit(1)).alias("k")), f"{label}-counts")
    kinds = counts.count()
    each = max(1, min(most_each, most_rows // max(1, kinds)))
    counts = F.broadcast(counts) if kinds <= SENT_LABELS else counts  # so that rows are thinned out before any of them moves
    draw = F.xxhash64("i", F.lit(salt))
    share = F.pmod(draw, F.lit(1 << 30)) / float(1 << 30)
    likely = known.join(counts, "y").where(share * F.col("k") < each + 8 * each**0.5).select("i", "y").distinct()
    order = Window.partitionBy("y").orderBy(F.pmod(draw, F.lit(1 << 30)), "i")
    chosen = likely.withColumn("n", F.row_number().over(order)).where(F.col("n") <= each).orderBy("n", F.xxhash64("y"), "y").limit(most_rows)
    return materialize(chosen, label)


def sampled_texts(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str, most_rows: int, most_bytes: int, also: Column | None = None) -> list[tuple]:
    """(text, label) of chosen rows, in their order, as many as have at most ``most_bytes`` bytes together. ``chosen`` has at most
    ``most_rows`` rows, so it may be sent to every task. Texts are taken whole or not at all."""
    on = F.col(f"`{id_col}`") == F.col("i")
    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("_text"), (F.lit(True) if also is None else also).alias("_also"))
    rows = rows.join(F.broadcast(chosen), on).where(F.col("_also") if also is None else F.col("_also").eqNullSafe(F.col("y"))).where("_text is not null")
    # repeated rows of one id: the first by text; so there are at most as many rows as were chosen
    rows = rows.groupBy("i", "y", "n").agg(F.min("_text").alias("_text"))
    before = Window.orderBy("n", "i", "y").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = materialize(rows.withColumn("size", F.octet_length("_text").cast("long")), "sample")
    within = sizes.select("i", "y", "n", F.sum("size").over(before).alias("sum")).where(F.col("sum") <= most_bytes).select("i", "y")
    found = sizes.join(F.broadcast(within), ["i", "y"]).orderBy("n", "i", "y").limit(most_rows)
    return [(r[0], r[1]) for r in found.select("_text", "y").collect()]


def drop_materialized(df: DataFrame) -> None:
    """Delete the folder of a table that ``materialize`` returned, once nothing reads it any more."""
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tidewright/" in name:
            _delete(df.sparkSession, name)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, once for each Spark context: executors run elsewhere, whatever the driver's own path holds.
    Batches that go to them are bounded by bytes, as texts may be long. There is nothing to ship where the package itself comes from an archive, or where workers of a local run find it by their path."""
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(ARROW_BYTES)) > BATCH_BYTES:
        spark.conf.set(ARROW_BYTES, f"{BATCH_BYTES}b")
    root, context = Path(__file__).resolve().parents[2], spark.sparkContext
    known = [os.path.realpath(p) for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()] if p]
    if root.is_file() or getattr(context, "_tidewright_shipped", False) or (re.match(r"local(\[|$)", context.master) and str(root) in known):
        return
    at = Path(tempfile.mkdtemp(prefix="tidewright-"))  # executors fetch the file when they first run a task
    shutil.copytree(root / "tidewright", at / "src/tidewright", ignore=shutil.ignore_patterns("__pycache__"))
    before = list(sys.path)
    context.addPyFile(shutil.make_archive(f"{at}/tidewright", "zip", at / "src"))
    sys.path[:] = before  # the driver has it already
    context._tidewright_shipped = True
