"""The read model: paging, rollups, progress, histograms. What is not known is null, never 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(df: DataFrame, key: str, cursor: Column, limit: int = 200) -> DataFrame:
    """Rows after the cursor, by key, with ``truncated``: whether more follow. Limit 0: no rows but the answer."""
    found = df.where(F.col(key) > cursor).orderBy(key).limit(limit + 1)
    ranked = found.withColumn("_n", F.row_number().over(Window.orderBy(key)))  # at most limit + 1 rows
    return ranked.withColumn("truncated", F.lit(limit) < F.max("_n").over(Window.partitionBy())).where(F.col("_n") <= limit).drop("_n")


def all_or_null(value: str) -> Column:
    """The sum, if every row reports one."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))


def fraction(low: Column, high: Column, at: Column) -> Column:
    """Progress in 0..1, null unless high > low."""
    return F.when(high > low, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (at - low) / (high - low))))


def histogram(df: DataFrame, by: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Cumulative counts: a bound includes its own value, the last is infinite. One pass, no join and no row multiplication."""
    counts = [F.count_if(F.col(value) <= b).alias(f"_{n}") for n, b in enumerate(bounds)]
    wide = df.groupBy(*by).agg(*counts, F.count(value).alias("_inf"))
    arms = [F.struct(F.lit(str(b)).alias("le"), F.col(f"_{n}").alias("n")) for n, b in enumerate(bounds)] + [F.struct(F.lit("+Inf").alias("le"), F.col("_inf").alias("n"))]
    return wide.select(*by, F.explode(F.array(*arms)).alias("x")).select(*by, "x.*")


def rates(samples: DataFrame, by: list[str], at: str, total: str) -> DataFrame:
    """per_second between neighbouring samples of a running total; null for the first."""
    w = Window.partitionBy(*by).orderBy(at)
    return samples.withColumn("per_second", (F.col(total) - F.lag(total).over(w)) / (F.col(at) - F.lag(at).over(w)))


def stream_rollup(lanes: DataFrame, by: list[str] = ["stream"]) -> DataFrame:  # noqa: B006
    """Counts add up, ages are the oldest lane's."""
    return lanes.groupBy(*by).agg(F.sum("records").alias("records"), F.max("age").alias("age"), F.count_if("finished").alias("finished"), F.count_if("blocked").alias("blocked"), F.count(F.lit(1)).alias("lanes"))


def backlog(lanes: DataFrame, by: list[str], value: str = "backlog", age: str = "age") -> DataFrame:
    """backlog: known only if every lane reports one; exact: whether all do; as_of: the newest age among them."""
    return lanes.groupBy(*by).agg(all_or_null(value).alias("backlog"), F.bool_and(F.col(value).isNotNull()).alias("exact"), F.min(age).alias("as_of"))


def node_rollup(nodes: DataFrame, lanes: DataFrame, node: str = "node") -> DataFrame:
    """Every node of the specification, idle ones with no lanes and no record count."""
    return nodes.join(lanes, node, "left").groupBy(node).agg(F.count("id").alias("lanes"), F.sum("records").alias("records"))


def scan_progress(lanes: DataFrame, by: list[str], weight: str = "weight", finished: str = "finished") -> DataFrame:
    """progress: finished weight over all, null where a lane's weight is 0 (not known)."""
    done = F.coalesce(F.sum(F.when(F.col(finished), F.col(weight))), F.lit(0))
    return lanes.groupBy(*by).agg(F.when(F.count_if(F.col(weight) == 0) == 0, done / F.sum(weight)).alias("progress"))


def eta(progress: Column, elapsed: Column) -> Column:
    """What is left, if it goes on as so far; null before anything is done and once all is."""
    return F.when((progress > 0) & (progress < 1), elapsed * (1 - progress) / progress)


def throughput(samples: DataFrame, by: list[str], at: str, total: str, apart: int = 500) -> DataFrame:
    """per_ms between a sample and the one before it, at least ``apart`` ms earlier; null where there is none (``at`` in ms)."""
    w = Window.partitionBy(*by).orderBy(at)
    gap = F.col(at) - F.lag(at).over(w)
    return samples.withColumn("per_ms", F.when(gap >= apart, (F.col(total) - F.lag(total).over(w)) / gap))


def reconcile_delta(df: DataFrame, by: list[str], settled: Column, abandoned: Column) -> DataFrame:
    """delta: admitted - settled - abandoned, what is still on its way."""
    return df.groupBy(*by).agg((F.count(F.lit(1)) - F.count_if(settled) - F.count_if(abandoned)).alias("delta"))


#: Most series that one metric may have.
MOST_SERIES = 4096


def counters(df: DataFrame, labels: dict[str, Column], value: Column | None = None, most: int = MOST_SERIES) -> DataFrame:
    """total by closed labels; a series that cannot be measured (null) is left out. More than ``most`` series are an error, not a cut."""
    out = df.groupBy(*[c.alias(n) for n, c in labels.items()]).agg((F.count(F.lit(1)) if value is None else F.sum(value)).alias("total")).where("total is not null")
    many = F.count(F.lit(1)).over(Window.partitionBy()) > most  # one row a series
    return out.withColumn("total", F.when(many, F.raise_error(F.lit(f"a metric has more than {most} series")).cast("bigint")).otherwise(F.col("total")))


def acknowledged(df: DataFrame, by: list[str], abandoned: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("records"), F.count_if(abandoned).alias("abandoned"))


def leaked(df: DataFrame, open_: Column, at: str, ttl: int) -> DataFrame:
    """What has been open for more than ``ttl`` before the newest record."""
    return df.where(open_).where(df.agg(F.max(at)).scalar() - F.col(at) > ttl)


def last_n(df: DataFrame, order: str, n: int = 32) -> DataFrame:
    """The last ``n`` rows, oldest first."""
    return df.orderBy(F.desc(order)).limit(n).orderBy(order)


def key_range(df: DataFrame, parts: list[str], prefix: tuple) -> DataFrame:
    """Keys under a prefix, each with its rendered path, in path order: all parts but the prefix's last are equal, that one begins so."""
    out = df
    for part, value in zip(parts, prefix, strict=False):
        last = part == parts[len(prefix) - 1] and len(prefix) > 1
        out = out.where(F.col(part).startswith(value) if last else F.col(part) == value)
    return out.withColumn("path", F.concat_ws("/", *parts)).orderBy("path")


#: The conditions, in the order they are told.
CONDITIONS = ("configured", "spec_applied", "assigned", "source_ready", "sink_ready", "progressing", "caught_up", "backpressured", "degraded")


def condition_columns(now: Column, window: int) -> dict[str, Column]:
    """Condition -> true, false or unknown, over one row of facts for each pipeline: applied, stored (revisions), total, finished, blocked,
    idle (lanes), in_flight, abandoned, leaked, downgrades (counts), source_ready, sink_ready, caught_up (booleans), fault, started, advanced.

    Progressing speaks of the durable cursor alone: neither a connection nor records that are read make it true.
    """
    c = F.col
    say = lambda yes: F.when(yes, "true").otherwise("false")
    ready = lambda name: F.when(c(name).isNull(), "unknown").otherwise(say(c(name)))
    moved = F.coalesce(now - c("advanced") <= window, F.lit(False))
    starting = c("advanced").isNull() & (now - c("started") <= window)
    return {
        "configured": F.lit("true"),
        "spec_applied": F.when(c("stored").isNull(), "true").otherwise(say(c("stored") == c("applied"))),
        "assigned": say(c("total") > 0),
        "source_ready": ready("source_ready"),
        "sink_ready": ready("sink_ready"),
        "progressing": F.when((c("total") == 0) | (c("finished") == c("total")), "false").when(moved, "true").when(starting, "unknown").otherwise("false"),
        "caught_up": F.when(c("total") == 0, "unknown").otherwise(say(c("caught_up"))),
        "backpressured": say(c("blocked") > 0),
        "degraded": say(c("fault").isNotNull() | (c("downgrades") > 0) | (c("leaked") > 0) | (c("abandoned") > 0)),
    }


def conditions(facts: DataFrame, key: str, now: Column, flush: int) -> DataFrame:
    """key, condition, status; the window of progress is three flush intervals, a second at least (times in microseconds)."""
    found = condition_columns(now, max(3 * flush, 1_000_000))
    arms = F.array(*[F.struct(F.lit(n).alias("condition"), found[n].alias("status")) for n in CONDITIONS])
    return facts.select(key, F.explode(arms).alias("x")).select(key, "x.*")


def compare_orders(a: Column, b: Column) -> Column:
    """-1, 0 or 1 of two positions' order bytes, bytewise; null (unknown) where either has none."""
    known = a.isNotNull() & b.isNotNull()
    return F.when(known, F.when(a < b, -1).when(a > b, 1).otherwise(0))
