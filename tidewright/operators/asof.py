"""The last mark at or before each row's key, without a task that sees all keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def span_of(df: DataFrame, key: str, width: int) -> Column:
    """A number that does not fall as the key grows: numbers and times by ``width``, texts by their first six bytes."""
    c = F.col(key)
    if isinstance(df.schema[key].dataType, StringType):
        return F.conv(F.rpad(F.hex(F.substring(F.encode(c, "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("bigint")
    return F.floor(c.cast("double") / width if df.schema[key].dataType.typeName() in ("date", "timestamp") else c / width).cast("bigint")


def last_mark(rows: DataFrame, marks: DataFrame, by: list[str], key: str, value: str, width: int = 1 << 20) -> DataFrame:
    """``rows`` with ``value`` of the last of ``marks`` (by, key, value) at or before each row's key; null where there is none.

    Keys are dealt to spans of ``width``. Inside a span a window carries marks to rows; what is in force at a span's start follows from the
    last mark of each earlier span, one row a span. One shuffle of the rows, whatever the number of marks.
    """
    mark = F.struct(F.col(value).alias("v"))
    m = marks.select(*by, F.col(key).alias("_k"), mark.alias("_v"), F.lit(0).alias("_o"), span_of(marks, key, width).alias("_s"))
    r = rows.withColumn("_k", F.col(key)).withColumn("_o", F.lit(1)).withColumn("_s", span_of(rows, key, width))
    heads = m.groupBy(*by, "_s").agg(F.max_by("_v", "_k").alias("_h"))
    spans = heads.unionByName(r.select(*by, "_s").distinct(), allowMissingColumns=True).groupBy(*by, "_s").agg(F.first("_h", ignorenulls=True).alias("_h"))
    earlier = Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select(*by, "_s", F.last("_h", ignorenulls=True).over(earlier).alias("_c"))
    inside = Window.partitionBy(*by, "_s").orderBy("_k", "_o").rowsBetween(Window.unboundedPreceding, 0)
    both = r.unionByName(m, allowMissingColumns=True).withColumn("_v", F.last("_v", ignorenulls=True).over(inside)).where("_o = 1")
    return both.join(carried, [*by, "_s"], "left").select(*rows.columns, F.coalesce("_v", "_c")["v"].alias(value))
