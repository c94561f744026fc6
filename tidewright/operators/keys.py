"""Keys of the state store: structured, so that no tenant or pipeline can be taken for another by its name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import joined_path

#: The key spaces, and the part that stands for a node's own state among those of its lanes.
SPACES = ("lane", "checkpoint", "schema", "dedupe", "connector")
OF_NODE = "@node"


def store_key(tenant: Column, space: str, *parts: Column) -> Column:
    """A key as a struct (tenant, space, parts); compare and join by it, not by its text."""
    if space not in SPACES:
        raise ValueError(f"unknown space {space!r}; there are {', '.join(SPACES)}")
    return F.struct(tenant.alias("tenant"), F.lit(space).alias("space"), F.array(*[p.cast("string") for p in parts]).alias("parts"))


def lane_key(tenant: Column, pipeline: Column, lane: Column) -> Column:
    return store_key(tenant, "lane", pipeline, lane)


def checkpoint_key(tenant: Column, pipeline: Column) -> Column:
    """The one of a pipeline: there is no history of checkpoints."""
    return store_key(tenant, "checkpoint", pipeline)


def schema_key(tenant: Column, pipeline: Column, fingerprint: Column) -> Column:
    return store_key(tenant, "schema", pipeline, fingerprint)


def dedupe_key(tenant: Column, pipeline: Column, node: Column, stream: Column, layer: Column, identity: Column) -> Column:
    return store_key(tenant, "dedupe", pipeline, node, stream, layer, identity)


def connector_key(tenant: Column, pipeline: Column, node: Column, lane: Column | None = None) -> Column:
    """State of one lane at a node, or the node's own."""
    return store_key(tenant, "connector", pipeline, node, F.lit(OF_NODE) if lane is None else lane)


def rendered(key: Column) -> Column:
    """A key as a path, parts escaped: for order, logs and prefix scans."""
    escaped = F.transform(key["parts"], lambda p: joined_path(p))
    return F.concat_ws("/", joined_path(key["tenant"]), key["space"], F.array_join(escaped, "/"))
