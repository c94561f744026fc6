"""Fault classes, routing of faults and edges, retry, clock skew, dead letters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lookup

#: Class -> (blame, terminal, counted as an attempt).
FAULT_CLASSES = {
    "unclassified": ("engine", False, True), "transient_upstream": ("upstream", False, True), "transient_internal": ("engine", False, True),
    "throttled": ("upstream", False, False), "indeterminate": ("upstream", False, True), "permanent_upstream": ("upstream", True, True),
    "permanent_internal": ("engine", True, True), "permanent_mapping": ("config", True, True), "permanent_contract": ("config", True, True),
    "duplicate_idempotent": ("upstream", False, True), "clock_skew": ("config", False, True), "fenced": ("engine", False, True),
    "not_connected": ("upstream", False, False), "end_of_input": ("upstream", False, False),
}
FLOOR_MS, UNBOUNDED_MS = 100, 3_600_000


def _of(cls: Column, n: int) -> Column:
    return lookup(cls, {c: v[n] for c, v in FAULT_CLASSES.items()})


def blame(cls: Column) -> Column:
    return F.coalesce(_of(cls, 0), F.lit("unknown"))


def is_terminal(cls: Column) -> Column:
    return F.coalesce(_of(cls, 1), F.lit(False))


def is_counted(cls: Column) -> Column:
    return F.coalesce(_of(cls, 2), F.lit(True))


def backoff_ceiling(attempt: Column, initial_ms: int, multiplier: float, max_ms: int, max_attempts: int) -> Column:
    """The largest delay before the next try; null where there is none. Jitter is drawn below it."""
    top = float(max_ms if max_ms > 0 else UNBOUNDED_MS)
    grown = F.least(F.lit(top), F.lit(float(initial_ms)) * F.pow(F.lit(max(1.0, multiplier)), attempt - 1))
    return F.when((attempt >= 1) & (attempt < max_attempts), grown.cast("bigint"))


def route_fault(cls: Column, attempts: Column, elapsed_ms: Column, hint_ms: Column, idempotent: Column, policy: dict) -> dict[str, Column]:
    """disposition, attempts, delay ceiling of one fault, in the order of the rules: see the comments."""
    cls = F.when(cls == "unclassified", F.lit("permanent_internal")).otherwise(cls)
    end = F.lit({"dead_letter": "dead_letter", "drop": "drop"}.get(policy["terminal"], "stop"))
    unsure = (cls == "indeterminate") & ~idempotent
    count = attempts + F.when(is_counted(cls), 1).otherwise(0)
    n = F.greatest(count, F.lit(1))
    delay = backoff_ceiling(n, policy["initial_ms"], policy["multiplier"], policy["max_ms"], policy["max_attempts"])
    spent = (elapsed_ms >= policy["max_elapsed_ms"]) if policy.get("max_elapsed_ms") else F.lit(False)
    choice = {"retry": None, "dead_letter": "dead_letter"}.get(policy["on_indeterminate"], "stall")
    out = F.when(cls == "duplicate_idempotent", F.lit("delivered"))  # a duplicate is a delivery
    if choice:
        out = out.when(unsure, F.lit(choice))  # not known whether it was written, and a second write would show
    out = out.when(is_terminal(cls), end).when(spent, end).when(is_counted(cls) & delay.isNull(), end).otherwise(F.lit("retry"))
    wait = F.greatest(F.coalesce(hint_ms, delay, F.lit(policy["max_ms"])), F.lit(FLOOR_MS)) if policy.get("floor_hint") else F.coalesce(hint_ms, delay, F.lit(policy["max_ms"]).cast("bigint"))
    wait = F.when(wait <= 0, F.lit(FLOOR_MS).cast("bigint")).otherwise(wait)
    return {"disposition": out, "attempts": count, "delay_ms": F.when(out == "retry", wait)}


def edge(df: DataFrame, select: str, fault: str = "fault") -> DataFrame:
    """main: rows without a fault; failed: rows with one; all: both."""
    return df if select == "all" else df.where(F.col(fault).isNull() if select == "main" else F.col(fault).isNotNull())


def fan_out(df: DataFrame, branches: dict[str, bool]) -> DataFrame:
    """Each row once for each branch (name -> best effort), in order of name."""
    arms = F.array(*[F.struct(F.lit(n).alias("branch"), F.lit(b).alias("best_effort")) for n, b in sorted(branches.items())])
    return df.withColumn("_b", F.explode(arms)).select(*df.columns, "_b.*")


def settle(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """A record is settled when every branch that is not best effort has ended, and abandoned when one of those gave it up."""
    ended = F.coalesce(F.col("outcome").isin("delivered", "duplicate", "abandoned"), F.lit(False))
    counts = F.coalesce(~F.col("best_effort"), F.lit(True))
    return outcomes.groupBy(*by).agg(
        F.bool_and(ended | ~counts).alias("settled"), F.bool_or(counts & F.coalesce(F.col("outcome") == "abandoned", F.lit(False))).alias("abandoned")
    )


def dead_letter(df: DataFrame, node: str, revision: int) -> DataFrame:
    """The envelope: origin, and the fault with who is to blame, attempts, node, revision, payload and metadata."""
    f = F.col("fault")
    return df.where(f.isNotNull()).select(
        "seq", "lane", "stream", f["class"].alias("class"), blame(f["class"]).alias("blame"), f["op"].alias("op"), f["user"].alias("message"), F.col("attempts"),
        F.lit(node).alias("node"), F.lit(revision).alias("revision"), F.col("body").alias("payload"), F.col("stream").alias("meta"),
    )


def clock(df: DataFrame, policy: str, now: Column, max_skew: int, at: str = "at") -> DataFrame:
    """One-sided clock rule: times after now + max_skew (strictly; 0 turns it off; null times pass) are clamped, rejected or counted."""
    ahead = F.coalesce(F.col(at) > now + max_skew, F.lit(False)) if max_skew else F.lit(False)
    out = df.withColumn("ahead", ahead)
    ahead = F.col("ahead")  # decided on the time as it came
    if policy == "clamp":
        out = out.withColumn(at, F.when(ahead, now + max_skew).otherwise(F.col(at)))
        return out.withColumn("note", F.when(ahead, F.lit("rounded")))
    if policy == "reject":
        return out.withColumn("fault", F.coalesce(F.col("fault"), F.when(ahead, F.lit("clock_skew"))) if "fault" in df.columns else F.when(ahead, F.lit("clock_skew")))
    return out


def fault_terminal(df: DataFrame, how: str) -> dict[str, DataFrame]:
    """Rows that go on, rows for the dead-letter sink (delivered before they are given up), and what is abandoned.

    With ``stop`` the first row that bears a fault ends whatever job reads ``main``.
    """
    faulted = df.where(F.col("fault").isNotNull())
    main = df.where(F.col("fault").isNull())
    if how == "stop":
        stopped = F.raise_error(F.concat(F.lit("stopped: "), F.col("fault")))
        main = df.where(F.when(F.col("fault").isNull(), F.lit(True)).otherwise(stopped.cast("boolean")))
        faulted = faulted.limit(0)
    return {"main": main, "dead_letter": faulted if how == "dead_letter" else faulted.limit(0), "abandoned": faulted}


def dispose_marked(df: DataFrame, by: list[str], order: str, fault: str = "fault") -> DataFrame:
    """by, admitted, marked, position: records that their source marked are disposed of before admission, and the position moves on over them."""
    return df.groupBy(*by).agg(F.count_if(F.col(fault).isNull()).alias("admitted"), F.count(fault).alias("marked"), F.max(order).alias("position"))


def drop_counts(df: DataFrame, by: list[str], fault: str = "fault") -> DataFrame:
    """by, delivered, abandoned under the drop policy."""
    return df.groupBy(*by).agg(F.count_if(F.col(fault).isNull()).alias("delivered"), F.count(fault).alias("abandoned"))


def sink_outcome(abandoned: Column, pending: Column, duplicate: Column) -> Column:
    """What became of a record at a sink: abandoned, not known yet (null), duplicate or delivered."""
    return F.when(abandoned, "abandoned").when(pending, F.lit(None)).when(duplicate, "duplicate").otherwise("delivered")


def is_delivery(outcome: Column) -> Column:
    """A duplicate that a sink reports is a delivery; it is counted separately as well."""
    return F.coalesce(outcome.isin("duplicate", "delivered"), F.lit(False))


def reconcile(counts: DataFrame, records: str, written: str, failed: str, deferred: str | None = None) -> DataFrame:
    """The counts as they are, if written = records - failed - deferred; else a contract fault ends the job."""
    expected = F.col(records) - F.col(failed) - (F.col(deferred) if deferred else F.lit(0))
    broken = F.raise_error(F.lit("permanent_contract: written does not add up")).cast("bigint")
    return counts.withColumn(written, F.when(F.col(written) == expected, F.col(written)).otherwise(broken))


def spread_faults(df: DataFrame, requests: DataFrame, by: list[str], own: Column) -> DataFrame:
    """fault: a request's own (by, request_fault) is that of each of its records; otherwise the record's."""
    return df.join(requests.select(*by, "request_fault"), by, "left").withColumn("fault", F.coalesce("request_fault", own)).drop("request_fault")


def reject_full(df: DataFrame, request: list[str], order: str, full: Callable[[Column], Column]) -> DataFrame:
    """fault, sent: a queue that takes a request's records one by one rejects those for which ``full(key + sent before)`` holds, and what it
    rejects was not sent. ``sent`` is what its request had sent before the record."""
    before = Window.partitionBy(*request).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("sent", F.count(F.lit(1)).over(before))
    return out.withColumn("fault", F.when(full(F.col(order)), F.lit("permanent_mapping")))


def shed_requests(df: DataFrame, request: list[str], in_flight: Column, limit: int) -> DataFrame:
    """fault: every record of a request that finds more than ``limit`` in flight is throttled."""
    most = F.max(in_flight).over(Window.partitionBy(*request))
    return df.withColumn("fault", F.when(most > limit, F.lit("throttled")))
