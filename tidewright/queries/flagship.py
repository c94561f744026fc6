"""The minimum slice: a specification, compiled and run over events."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.pipeline import SinkCaps, SourceCaps, compile_spec, standard
from ..plans.spec import load
from .base import EVENTS, events, query

SPEC = {
    "id": "flagship", "retry": {"terminal": "dead_letter"}, "clock": {"policy": "clamp", "max_skew_us": 1},
    "graph": [
        {"id": "in", "kind": "source", "name": "events"},
        {"id": "large", "kind": "transform", "name": "filter", "config": {"where": {"path": ["k"], "op": "gt", "value": 20}}, "inputs": [{"from": "in"}]},
        {"id": "errors", "kind": "transform", "name": "mark", "config": {"where": {"path": ["stream"], "op": "equals", "value": "error"}, "class": "permanent_mapping"}, "inputs": [{"from": "large"}]},
        {"id": "out", "kind": "sink", "name": "counted", "inputs": [{"from": "errors"}]},
        {"id": "dlq", "kind": "sink", "name": "counted", "inputs": [{"from": "errors", "select": "failed"}]},
    ],
}


@query(f"""SELECT CASE WHEN stream = 'error' THEN 'dlq' ELSE 'out' END AS sink, lane, count(*) AS records, sum(length(body) + 1)::BIGINT AS bytes FROM {EVENTS}
 WHERE CAST(json_extract_string(body, '$.k') AS DOUBLE) > 20 GROUP BY ALL""")
def pipeline_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = standard()
    registry.add_source("events", lambda s, c: events(s, sf_dir).withColumnRenamed("tm", "at"), SourceCaps())
    registry.add_sink("counted", lambda df, c: df.groupBy("lane").agg(F.count("*").alias("records"), F.sum(F.length("body") + 1).alias("bytes")), SinkCaps())
    out = compile_spec(spark, load(json.dumps(SPEC)), registry, now_us=0)
    return out["out"].withColumn("sink", F.lit("out")).unionByName(out["dlq"].withColumn("sink", F.lit("dlq")))
