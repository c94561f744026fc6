"""Toxicity, language identification, and the pipeline."""

import zlib

import corpus_pipeline
from pyspark.sql import functions as F

from tests.conftest import SF
from tidewright.llm import language_id, toxicity
from tidewright.llm.queries import llm_queries, table
from tidewright.llm.storage import materialize

BIG = SF.replace("sf0.001", "sf0.01")


def test_op3(spark, odd_docs, no_docs):
    rows = llm_queries()["op3_language_id"](spark, BIG).collect()
    lang = {r.doc_id: r.lang for r in table(spark, BIG, "documents").select("doc_id", "lang").collect()}
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    model = language_id.fit(language_id.labelled_sample(table(spark, BIG, "documents")))
    got = {r.doc_id: r for r in language_id.identify(odd_docs.where("doc_id is not null"), model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].rejected for i in (3, 4, 5)) and got[1].lang_pred in model.names
    kept = language_id.keep_identified(odd_docs, model)
    assert kept.schema == odd_docs.schema and not {3, 4, 5} & {r.doc_id for r in kept.collect()}
    assert language_id.identify(no_docs, model).count() == 0
    nothing = language_id.fit(language_id.labelled_sample(no_docs))
    assert {r.lang_pred for r in language_id.identify(odd_docs, nothing).collect()} == {"und"}


def test_op2(spark, odd_docs, no_docs):
    rng_words = "the of and tion ing was are".split()
    docs = [(i, " ".join(rng_words[(i * k) % 7] for k in range(1, 60)) + (" you are a stupid idiot moron " if i % 4 == 0 else " fine ")) for i in range(400)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    labels = d.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic")).unionByName(spark.createDataFrame([(None, 1), (5, None)], "doc_id long, toxic int"))
    model = toxicity.fit(*toxicity.labelled_sample(d, labels))
    rows = {r.doc_id: r for r in toxicity.score_toxicity(d, model).collect()}
    held = [i for i in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((rows[i].predicted == 1) == (i % 4 == 0) for i in held) / len(held) > 0.95
    unseen = spark.createDataFrame([(1, "the of and stupidd idiott was"), (2, "the of and ing was are")], "doc_id long, text string")
    a, b = (r.score for r in toxicity.score_toxicity(unseen, model).orderBy("doc_id").collect())
    assert a > b
    odd = toxicity.score_toxicity(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.score_toxicity(no_docs, model).count() == 0
    assert all(0 <= r.score <= 1 for r in toxicity.score_toxicity(d, toxicity.fit(*toxicity.labelled_sample(no_docs, labels))).limit(3).collect())
    found = llm_queries()["op2_toxicity"](spark, SF)
    assert found.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and found.count() == 200


def test_pipeline(spark, odd_docs):
    docs = table(spark, SF, "documents")
    schema, ids = docs.schema, None
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, docs, SF), name, keep=True)
        if name != "packing":
            assert after.schema == schema
            ids = {r.doc_id for r in after.select("doc_id").collect()}
            assert ids <= {r.doc_id for r in docs.select("doc_id").collect()}
        docs = after
    assert {r.doc_id for r in docs.collect()} == ids
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = materialize(stage(spark, docs, SF), name, keep=True)
    assert docs.count() > 0
