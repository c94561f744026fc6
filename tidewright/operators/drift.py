"""Schema drift: kinds of change, policies, applying changes, schemas as of an epoch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .asof import last_mark

#: Fixed values.
KINDS = ("create_stream", "add_field", "drop_field", "rename_field", "alter_field_type", "alter_nullability", "alter_keys", "truncate_stream", "drop_stream", "rename_stream")
DESTRUCTIVE = ("drop_field", "alter_field_type", "truncate_stream", "drop_stream")
POLICIES = ("lenient", "evolve", "try_evolve", "ignore", "fail")


def destructive(kind: Column) -> Column:
    return F.coalesce(kind.isin(*DESTRUCTIVE), F.lit(False))


def permits(policy: Column, kind: Column) -> Column:
    return F.when(policy == "evolve", True).when(policy.isin("ignore", "fail"), False).otherwise(~destructive(kind))


def apply_changes(df: DataFrame, changes: list[dict], policy: str = "evolve") -> DataFrame:
    """Field changes in order. lenient turns a type change into keeping the old column as <name>_old and adding the new one."""
    for change in changes:
        kind, name = change["kind"], change.get("from")
        if policy in ("ignore", "fail") or (policy in ("lenient", "try_evolve") and kind in DESTRUCTIVE and not (policy == "lenient" and kind == "alter_field_type")):
            if policy == "fail":
                raise ValueError(f"drift: {kind} is refused")
            continue
        if kind == "add_field":
            df = df.withColumn(change["to"], F.lit(None).cast(change["type"]))
        elif kind == "drop_field":
            df = df.drop(name)
        elif kind == "rename_field":
            df = df.withColumnRenamed(name, change["to"])
        elif kind == "alter_field_type":
            if policy == "lenient":
                df = df.withColumnRenamed(name, f"{name}_old").withColumn(name, F.col(f"{name}_old").cast(change["type"]))
            else:
                df = df.withColumn(name, F.col(name).cast(change["type"]))
        else:
            raise ValueError(f"{kind} is no change of a field")
    return df


def as_of(rows: DataFrame, history: DataFrame, by: str, epoch: str, value: str) -> DataFrame:
    """``value`` of the newest history entry at or before each row's epoch; rows of one stream are worked on span by span of epochs."""
    return last_mark(rows, history, [by], epoch, value)
