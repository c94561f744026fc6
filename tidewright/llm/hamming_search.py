"""Exact top-k search over binary codes by incremental multi-index hashing.

A code of ``bits`` bits is cut into segments. Codes within distance m*(r+1)-1 of each other, m segments, agree in some
segment up to r bits. So round r looks up, for the queries that are still open, all segment values r bits away, verifies the
whole distance of what it finds, and closes the queries whose k-th verified distance is at most m*(r+1)-1: nothing nearer
can be missing. Rows of equal code are one entry, which keeps its least k+1 ids: no other of them can be among k nearest.
"""

from __future__ import annotations

from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

#: Most bits of a segment, whatever the table's size.
WIDEST = 32


def sign_code(embedding: Column, bits: int = 64) -> Column:
    """Bit i is set where entry i is positive; null for a null embedding, one of another length, or one with a null entry."""
    bit = F.transform(embedding, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).when(x.isNotNull(), F.lit(0).cast("bigint")))
    code = F.aggregate(bit, F.lit(0).cast("bigint"), lambda s, b: s.bitwiseOR(b))
    return F.when(F.size(embedding) == bits, code)


def nearest_codes(df: DataFrame, queries: Column, k: int = 10, bits: int = 64, id_col: str = "vec_id", code_col: str = "code") -> DataFrame:
    """query_id, rank, neighbor_id, distance: for each row that ``queries`` selects its k nearest other rows, ties by least id.

    A query never finds its own row. Rows of a null code or id are left out; repeated rows of one id count once. Fewer than k other rows:
    all of them. An empty table, or no queries: no rows. Columns other than id_col, code_col and those of ``queries`` are not read.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(code_col).cast("bigint").alias("code"), queries.alias("asks")).where("id is not null and code is not null")
    # the least k+1 ids of a code, by a limit that applies before the shuffle
    least = Window.partitionBy("code").orderBy("id")
    ids = rows.select("code", "id").distinct().withColumn("n", F.row_number().over(least)).where(F.col("n") <= k + 1)
    entries = materialize(ids.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "codes")
    size = entries.count()
    m = max(-(-bits // WIDEST), min(bits, round(bits / max(4.0, log2(max(2, size))))))
    cuts = [bits * s // m for s in range(m + 1)]
    widths = [b - a for a, b in zip(cuts, cuts[1:], strict=False)]
    segment = lambda code, s: F.call_function("shiftrightunsigned", code, F.lit(cuts[s])).bitwiseAND(F.lit((1 << widths[s]) - 1).cast("bigint"))
    parts = lambda code: F.explode(F.array(*[F.struct(F.lit(s).alias("s"), segment(F.col(code), s).alias("v")) for s in range(m)])).alias("p")
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index = materialize(entries.repartition(tasks, "code").select("code", "ids", parts("code")).select("code", "ids", "p.s", "p.v"), "index")
    asked = materialize(rows.where("asks").select(F.col("id").alias("q"), F.col("code").alias("qc")).distinct(), "asked")
    # of the codes met, the k+1 nearest by (distance, least id) hold every answer met so far; a code met twice counts once
    near, of_query = Window.partitionBy("qc").orderBy("distance", F.col("ids")[0], "code"), Window.partitionBy("qc")
    found, done = asked.select("qc").distinct(), []
    for radius in range(max(widths) + 1):
        probes = found.select("qc").distinct().repartition(tasks, "qc").select("qc", parts("qc")).select("qc", "p.s", "p.v")
        met = _values(probes, widths, radius).join(index.hint("merge"), ["s", "v"])
        met = met.select("qc", "code", "ids", F.bit_count(F.col("qc").bitwiseXOR(F.col("code"))).alias("distance"))
        met = met.unionByName(found.select(met.columns)) if radius else met
        met = met.withColumn("n", F.dense_rank().over(near)).where(F.col("n") <= k + 1).dropDuplicates(["qc", "code"])
        # a query's own row is met too, so k others are sure where k+1 ids lie within what this radius covers
        covered = m * (radius + 1) - 1
        sure = F.sum(F.when(F.col("distance") <= covered, F.size("ids")).otherwise(0)).over(of_query) >= k + 1
        found = materialize(met.select("qc", "code", "ids", "distance", sure.alias("closed")), f"found{radius}")
        if covered >= bits or radius == max(widths):
            done.append(found)
            break
        done.append(found.where("closed"))
        found = found.where(~F.col("closed"))
        if found.isEmpty():
            break
    out = reduce(DataFrame.unionByName, done)
    answers = asked.join(out.hint("merge"), "qc").select("q", "distance", F.explode("ids").alias("neighbor_id")).where("neighbor_id <> q")
    by = Window.partitionBy("q").orderBy("distance", "neighbor_id")
    answers = answers.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return answers.select(F.col("q").alias("query_id"), F.col("rank").cast("int"), "neighbor_id", F.col("distance").cast("int"))


def _values(probes: DataFrame, widths: list[int], radius: int) -> DataFrame:
    """(qc, s, v) with ``radius`` bits of v flipped in every way: each step flips one bit above those flipped before, so that the
    plan has one generator for each bit and no list of masks."""
    width = F.element_at(F.array(*map(F.lit, widths)), F.col("s") + 1)
    probes = probes.withColumn("top", F.lit(-1))
    for left in range(radius, 0, -1):  # so many bits are still to be flipped, this one with them
        wide = probes.where(F.col("top") + left < width)
        wide = wide.select("qc", "s", "v", F.explode(F.sequence(F.col("top") + 1, width - left)).alias("bit"))
        flipped = F.col("v").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit")))
        probes = wide.select("qc", "s", flipped.alias("v"), F.col("bit").alias("top"))
    return probes.select("qc", "s", "v")


SEARCH_SQL = """
WITH codes AS (
  SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS code
  FROM embeddings WHERE len(embedding) = 64
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS neighbor_id, CAST(hamming(q.code, c.code) AS INTEGER) AS distance
  FROM codes q JOIN codes c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank FROM pairs
)
SELECT query_id, rank, neighbor_id, distance FROM ranked WHERE rank <= 10
"""
