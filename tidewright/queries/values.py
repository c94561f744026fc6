"""Predicates, mappings, keys, codecs and value functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, StructField, StructType

from ..functions import text as T
from ..functions.predicate import compile_predicate, resolve
from ..operators import identity
from .base import EVENTS, events, query, table

# a payload with a missing, a null, a text and a number member, by event_id
DOC = """CASE event_id % 6 WHEN 0 THEN '{"k": null, "s": ""}' WHEN 1 THEN '{"s": "0", "z": 0}' WHEN 2 THEN '{"k": "7", "s": "x7"}'
 WHEN 3 THEN '{"k": 7, "other": 7, "t": "2s"}' WHEN 4 THEN '{"k": true, "t": "64MiB", "other": 1}' ELSE props END"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("json", F.expr(DOC))
    return e.select(F.col("event_id").alias("seq"), F.col("event_type").alias("stream"), "json", F.parse_json("json").alias("doc"))


DOCS = f"(SELECT event_id AS seq, event_type AS stream, {DOC} AS json FROM events)"
# members as the payload holds them: type names NULL, VARCHAR, UBIGINT/BIGINT, DOUBLE, BOOLEAN, or absent
K, S, O_, Z, TT = ("json_extract(json, '$.%s')" % n for n in ("k", "s", "other", "z", "t"))
KT = "json_extract_string(json, '$.k')"


def predicate(name: str, spec: dict, where: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = docs(spark, sf_dir)
        return d.where(compile_predicate(spec, F.col("doc"), {"stream": F.col("stream")})).select("seq")

    query(f"SELECT seq FROM {DOCS} WHERE coalesce({where}, false)", name)(run)


EQ7 = f"({K} IS NOT NULL AND json_type({K}) <> 'NULL' AND (try_cast({KT} AS DOUBLE) = 7 OR {KT} = '7'))"
TRUTHY = f"({K} IS NOT NULL AND json_type({K}) <> 'NULL' AND {KT} NOT IN ('false', '') AND NOT (json_type({K}) <> 'VARCHAR' AND coalesce(try_cast({KT} AS DOUBLE) = 0, false)))"
predicate("pred_equals", {"path": ["k"], "op": "equals", "value": 7}, EQ7)
predicate("pred_not_equals", {"path": ["k"], "op": "not_equals", "value": "7"}, f"NOT coalesce({EQ7}, false)")
predicate("pred_in", {"path": ["k"], "op": "in", "values": [7, "69", True]}, f"{EQ7} OR try_cast({KT} AS DOUBLE) = 69 OR {KT} = 'true'")
predicate("pred_present", {"path": ["k"], "op": "present"}, f"{K} IS NOT NULL")
predicate("pred_truthy", {"path": ["k"], "op": "truthy"}, TRUTHY)
predicate("pred_gt", {"path": ["k"], "op": "gt", "value": 40}, f"try_cast({KT} AS DOUBLE) > 40")
predicate("pred_lt", {"path": ["t"], "op": "lt", "value": "1GiB"}, f"{TT} IS NOT NULL AND json_extract_string(json, '$.t') = '64MiB'")
predicate("pred_matches", {"path": ["s"], "op": "matches", "value": "^x[0-9]$"}, "regexp_matches(json_extract_string(json, '$.s'), '^x[0-9]$')")
predicate("pred_all", {"all": [{"path": ["k"], "op": "present"}, {"path": ["stream"], "op": "equals", "value": "click"}]}, f"{K} IS NOT NULL AND stream = 'click'")
predicate("pred_any", {"any": [{"path": ["k"], "op": "equals", "value": 7}, {"path": ["stream"], "op": "equals", "value": "view"}]}, f"coalesce({EQ7}, false) OR stream = 'view'")
predicate("pred_not", {"not": {"path": ["k"], "op": "truthy"}, "path": ["stream"], "op": "not_equals", "value": "error"}, f"NOT coalesce({TRUTHY}, false) AND stream <> 'error'")
predicate("pred_other", {"path": ["k"], "op": "not_equals", "other": ["other"]}, f"{O_} IS NOT NULL AND NOT coalesce({KT} = json_extract_string(json, '$.other'), false)")


@query(f"SELECT seq, {K} IS NOT NULL AS present, coalesce(json_type({K}) = 'NULL', false) AS is_null, CASE WHEN json_type({K}) <> 'NULL' THEN {KT} END AS shown FROM {DOCS}")
def path_resolve(spark, sf_dir):
    v = resolve(["k"], F.col("doc"))
    return docs(spark, sf_dir).select("seq", v.present.alias("present"), v.null.alias("is_null"), v.text.alias("shown"))


DUR = "CASE event_id % 5 WHEN 0 THEN event_id || 'ms' WHEN 1 THEN '1h' || (event_id % 60) || 'm' WHEN 2 THEN '-' || event_id || 's' WHEN 3 THEN 'soon' ELSE '1.5s' END"


@query(f"""SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id * 1000000 WHEN 1 THEN (60 + event_id % 60) * 60000000000 WHEN 2 THEN -event_id * 1000000000
 WHEN 3 THEN NULL ELSE 1500000000 END AS ns FROM (SELECT event_id, {DUR} AS t FROM events)""")
def parse_duration(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.parse_duration(F.expr(DUR)).alias("ns"))


SIZE = "CASE event_id % 5 WHEN 0 THEN event_id || 'KiB' WHEN 1 THEN event_id || ' mb' WHEN 2 THEN '' || event_id WHEN 3 THEN '12 parsecs' ELSE '0.5GiB' END"


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id * 1024 WHEN 1 THEN event_id * 1000000 WHEN 2 THEN event_id WHEN 3 THEN NULL ELSE 536870912 END AS bytes FROM events")
def parse_size(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.parse_size(F.expr(SIZE)).alias("bytes"))


@query(f"SELECT seq, coalesce(CASE WHEN json_type({K}) <> 'NULL' THEN {KT} END, 'none') AS k, stream AS name, 'fixed' AS kind FROM {DOCS}")
def mapping_project(spark, sf_dir):
    from ..operators.shape import project

    mapping = {"k": {"payload_field": ["k"], "default": "none"}, "name": {"envelope": "stream"}, "kind": {"literal": "fixed"}}
    return project(docs(spark, sf_dir), mapping, keep=["seq"])


META = "array(named_struct('ns','source','key','offset','value',cast(event_id as string)), named_struct('ns',case when event_id % 3 = 0 then 'other' else 'user' end,'key','trace_id','value','t'), named_struct('ns','user','key','debug','value','d'))"


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 2 END AS kept, CASE WHEN event_id % 3 = 0 THEN 'offset' ELSE 'offset,trace_id' END AS names FROM events")
def meta_filter(spark, sf_dir):
    from ..operators.shape import filter_meta

    kept = filter_meta(F.expr(META), include=["source.*", "user.*"], exclude=["user.debug"])
    return table(spark, sf_dir, "events").select("event_id", F.size(kept).alias("kept"), F.concat_ws(",", F.transform(kept, lambda m: m["key"])).alias("names"))


@query(f"SELECT seq, json_type({K}) = json_type({O_}) AND {KT} = json_extract_string(json, '$.other') AS same FROM {DOCS} WHERE {K} IS NOT NULL AND {O_} IS NOT NULL")
def value_equal(spark, sf_dir):
    from ..operators.shape import same_value

    d = docs(spark, sf_dir)
    k, o = (F.try_variant_get("doc", f"$.{n}", "variant") for n in ("k", "other"))
    return d.where(k.isNotNull() & o.isNotNull()).select("seq", same_value(k, o).alias("same"))


@query("SELECT event_id, coalesce(replace(replace(event_type, '%', '%25'), '/', '%2F'), '') || '/' || replace('a%b/' || user_id, '%', '%25').replace('/', '%2F') AS lane_id FROM events")
def lane_id(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.joined_path(F.col("event_type"), F.concat(F.lit("a%b/"), F.col("user_id").cast("string"))).alias("lane_id"))


@query("""SELECT event_id, lower(lpad(printf('%X', strlen(event_type)), 8, '0') || hex(encode(event_type)) || lpad(printf('%X', strlen(user_id::VARCHAR)), 8, '0') || hex(encode(user_id::VARCHAR))) AS k FROM events""")
def canonical_key(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.prefixed_key(F.col("event_type"), F.col("user_id").cast("string")).alias("k"))


@query("SELECT event_id, 't/p/' || replace(replace(event_type || '/%', '%', '%25'), '/', '%2F') || '/' || user_id AS k FROM events")
def dedupe_key_text(spark, sf_dir):
    parts = (F.lit("t"), F.lit("p"), F.concat("event_type", F.lit("/%")), F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", T.joined_path(*parts).alias("k"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'id-' || user_id WHEN 1 THEN 'rq-' || event_id ELSE 'sha256:' || sha256(props) END AS key FROM events")
def key_content_hash(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    one, two = F.expr("case when event_id % 3 = 0 then 'id-' || user_id end"), F.expr("case when event_id % 3 = 1 then 'rq-' || event_id end")
    return e.select("event_id", identity.request_key([one, two], F.col("props")).alias("key"))


@query("SELECT o_orderkey, substr(sha256(o_orderstatus || chr(0) || list_aggregate(list_sort(list(f)), 'string_agg', '')), 1, 32) AS txn FROM (SELECT o_orderkey, o_orderstatus, 'f' || l_linenumber || chr(0) AS f FROM orders JOIN lineitem ON l_orderkey = o_orderkey) GROUP BY 1, o_orderstatus".replace("chr(0)", "'|'"))
def txn_id(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    files = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.concat(F.lit("f"), F.col("l_linenumber").cast("string"))).alias("files"))
    return o.join(files, "o_orderkey").select("o_orderkey", identity.commit_id(F.col("o_orderstatus"), F.col("files"), "|").alias("txn"))


@query("""SELECT 'nation' AS name, substr(sha256('s{k:n_nationkey;f{n_nationkey:int32;null}f{n_name:string;null}f{n_regionkey:int32;null}}'), 1, 32) AS fp
 UNION ALL SELECT 'price', substr(sha256('s{open;f{p:decimal;null;l:p20:s4}}'), 1, 32) UNION ALL SELECT 'none', repeat('0', 32)""")
def schema_fp(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int"), "n_name", F.col("n_regionkey").cast("int")).schema
    found = [("nation", identity.schema_fingerprint(nation, ["n_nationkey"])), ("price", identity.schema_fingerprint(StructType([StructField("p", DecimalType(20, 4))]), opened=True)), ("none", identity.schema_fingerprint(None))]
    return spark.createDataFrame(found, "name string, fp string")


@query("""SELECT event_id, '{"bytes":"' || base64(encode(props)) || '","list":[' || event_id || ',null,' || user_id || '],"map":{"a":"' || event_type || '","b":' || CASE WHEN event_id % 2 = 0 THEN '1e+06' ELSE '0.5' END || '}'
 || CASE WHEN event_id % 3 = 0 THEN '' ELSE ',"opt":{"day":"2024-02-03"}' END || ',"price":"' || printf('%d.%02d', event_id // 100, event_id % 100) || '","yes":' || (event_id % 2 = 0)::VARCHAR || '}' AS json FROM events""")
def encode_structure(spark, sf_dir):
    i = F.col("event_id")
    whole = F.struct(
        F.encode("props", "UTF-8").alias("bytes"), F.array(i, F.lit(None), F.col("user_id")).alias("list"), F.struct(F.when(i % 2 == 0, 1e6).otherwise(0.5).alias("b"), F.lit(None).cast("string").alias("gone"), F.col("event_type").alias("a")).alias("map"),
        F.when(i % 3 != 0, F.create_map(F.lit("day"), F.lit("2024-02-03").cast("date"), F.lit("none"), F.lit(None).cast("date"))).alias("opt"), (i.cast("decimal(20,2)") / 100).cast("decimal(20,2)").alias("price"), (i % 2 == 0).alias("yes"),
    )
    e = table(spark, sf_dir, "events").select("event_id", whole.alias("whole"))
    return e.select("event_id", T.json_value(F.col("whole"), e.schema["whole"].dataType).alias("json"))


@query("SELECT event_id, encode(props) AS body FROM events".replace("encode(props)", "hex(encode(props))"))
def encode_raw(spark, sf_dir):
    from ..functions.codec import encode_raw as raw

    return table(spark, sf_dir, "events").select("event_id", F.hex(raw(F.encode("props", "UTF-8"))).alias("body"))


JSON_SQL = """'{"at":"' || regexp_replace(regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') || 'Z","half":'
 || (CASE WHEN event_id >= 2000000 THEN rtrim(rtrim(substr((event_id * 5)::VARCHAR, 1, 1) || '.' || substr((event_id * 5)::VARCHAR, 2), '0'), '.') || 'e+' || lpad((length((event_id * 5)::VARCHAR) - 2)::VARCHAR, 2, '0')
 WHEN event_id % 2 = 0 THEN (event_id // 2)::VARCHAR ELSE (event_id // 2)::VARCHAR || '.5' END) || ',"id":' || event_id
 || (CASE WHEN event_id % 3 = 0 THEN '' ELSE ',"opt":"' || event_type || '"' END) || ',"text":"' || replace(replace('a\\b' || props, '\\', '\\\\'), '"', '\\"') || '\\n"}'"""


@query(f"SELECT event_id, {JSON_SQL} AS json FROM events")
def encode_json(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", _json().alias("json"))


def _json():
    from .base import micros

    return T.json_object(
        {
            "id": F.col("event_id").cast("string"), "half": T.json_float(F.col("event_id") / 2), "at": T.json_time(micros("ts")),
            "opt": F.when(F.col("event_id") % 3 != 0, T.json_string(F.col("event_type"))), "text": T.json_string(F.concat(F.lit("a\\b"), "props", F.lit("\n"))),
        },
        optional={"opt"},
    )


@query("SELECT event_id, printf('%d.%02d', event_id // 100, event_id % 100) AS amount FROM events")
def decimal_text(spark, sf_dir):
    from ..functions.codec import decimal_text as text

    return table(spark, sf_dir, "events").select("event_id", text(F.col("event_id"), 2).alias("amount"))


@query(f"SELECT lane, batch, string_agg(body || chr(10), '' ORDER BY seq) AS frame, count(*) AS records FROM (SELECT *, (row_number() OVER (PARTITION BY lane ORDER BY seq) - 1) // 500 AS batch FROM {EVENTS}) GROUP BY lane, batch")
def frame_ndjson(spark, sf_dir):
    from ..functions.codec import frame_lines
    from ..operators.flow import batch_count

    return frame_lines(batch_count(events(spark, sf_dir), ["lane"], "seq", 500), ["lane", "batch"], "seq", F.col("body"))


@query(f"SELECT lane, seq // 1000 AS batch, string_agg(body || chr(10), '' ORDER BY seq) AS frame, count(*) AS records FROM {EVENTS} GROUP BY ALL")
def request_framed(spark, sf_dir):
    from ..functions.codec import frame_lines

    return frame_lines(events(spark, sf_dir).withColumn("batch", F.floor(F.col("seq") / 1000).cast("bigint")), ["lane", "batch"], "seq", F.col("body"))


@query(f"SELECT lane, seq AS request, body AS frame, 1 AS records FROM {EVENTS}")
def request_unframed(spark, sf_dir):
    from ..functions.codec import requests

    return requests(events(spark, sf_dir), ["lane"], "seq", F.col("body"), framed=False)


@query("SELECT lane, unnest(string_split(frame, chr(10))) AS line FROM (SELECT user_id % 8 AS lane, string_agg(props, chr(10) ORDER BY event_id) AS frame FROM events GROUP BY 1, event_id // 1000)")
def decode_explode(spark, sf_dir):
    from ..functions.codec import decode_lines, frame_lines

    framed = frame_lines(events(spark, sf_dir).withColumn("batch", F.floor(F.col("seq") / 1000)), ["lane", "batch"], "seq", F.col("body"))
    return decode_lines(framed, "frame", ["lane"])
