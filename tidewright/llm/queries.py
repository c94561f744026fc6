"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, toxicity
from .exact_dedup import EXACT_SQL, exact_groups
from .hamming_search import SEARCH_SQL, nearest_codes, sign_code
from .mixture_packing import mixture_pack
from .near_dedup import near_groups
from .piece_sampling import decode_pieces, sample_pieces
from .storage import ship_package
from .suffix_dedup import remove_repeats
from .token_counts import token_counts
from .token_output import pack_token_ids


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer file; the files stay where they are installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(*toxicity.labelled_sample(docs, table(spark, sf_dir, "labels")))
    found = toxicity.score_toxicity(docs, model, threshold=0.7)
    return found.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(language_id.labelled_sample(docs))
    found = language_id.identify(docs, model)
    return found.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary_path(), limit=512)


def op6_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = mixture_pack(table(spark, sf_dir, "documents"), vocabulary_path(), sequence=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_token_ids(table(spark, sf_dir, "documents"), vocabulary_path(), sequence=2048, id_bytes=2)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents"), words=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = table(spark, sf_dir, "embeddings").withColumn("code", sign_code(F.col("embedding"), 64))
    return nearest_codes(codes, F.col("vec_id") % 50 == 0, k=10, bits=64)


def op9_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled pieces of every text, and whether decoding gives the text back. The id takes the text's digest along."""
    model = vocabulary_path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").withColumn("key", F.struct("doc_id", F.sha2("text", 256).alias("sha")))
    sampled = sample_pieces(docs, model, seed=0, id_col="key")
    told = F.struct("key.*", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"))
    decoded = decode_pieces(sampled.withColumn("key", told), model, id_col="key")
    same = F.sha2("text", 256).eqNullSafe(F.col("key.sha"))
    return decoded.select("key.doc_id", "key.n_pieces", "key.ids_crc32", same.alias("lossless"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"), size=200)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_output, op2_toxicity, op3_language_id, op4_token_counts, op5_near_dedup, op6_mixture_packing, op7_exact_dedup, op8_hamming_search, op9_piece_sampling, op10_suffix_dedup)}


def llm_oracle_sql() -> dict[str, str]:
    return {"op7_exact_dedup": EXACT_SQL, "op8_hamming_search": SEARCH_SQL}
