"""Token counts of whole texts from stored prefix counts; truncation and budget questions need no second encoding."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe
from .storage import portions, tidy

#: Bytes of texts that are counted at a time, if not a single text has more.
SLICE = 1 << 20


def token_counts(
    df: DataFrame,
    vocabulary_path: str,
    limit: int = 512,
    id_col: str = "doc_id",
    text_col: str = "text",
    cut: bool = False,
) -> DataFrame:
    """One row per input row: ``id_col``, n_bytes, n_tokens, over_limit and, with ``cut``, cut_chars.

    Counts are those of the vocabulary's library without added special tokens; a special string inside a text is one token.
    cut_chars is the length in characters of the longest prefix whose own count is at most ``limit``, taken from the prefix
    counts. A null text counts as empty (0 bytes, 0 tokens, cut 0); repeated rows each give a row; a null id stays null;
    an empty table gives no rows; other columns are not read. Narrow: no shuffle.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = bpe.prefix_counts(vocabulary_path)
        for batch in batches:
            for some in portions(batch, 1, SLICE):
                texts = [t or "" for t in some.column(1).to_pylist()]
                tokens = [counts.count(t) for t in texts]
                out = {
                    id_col: some.column(0),
                    "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()),
                    "n_tokens": pa.array(tokens, pa.int64()),
                    "over_limit": pa.array([n > limit for n in tokens], pa.bool_()),
                }
                if cut:
                    cuts = [len(t) if n <= limit else counts.within(t, limit) for t, n in zip(texts, tokens, strict=True)]
                    out["cut_chars"] = pa.array(cuts, pa.int64())
                yield pa.RecordBatch.from_pydict(out)

    schema = f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean" + ", cut_chars long" * cut
    return df.select(id_col, text_col).mapInArrow(tidy(run), schema)


def prefix_tables(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and prefix_tokens, an array whose entry i is the exact token count of the text's first i characters.

    Null text: the array [0]. Any budget or truncation question is then a lookup in SQL.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = bpe.prefix_counts(vocabulary_path)
        for batch in batches:
            for at in range(0, len(batch), 64):  # tables are wide: a few texts at a time
                part = batch.slice(at, 64)
                tables = [counts.table(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_pydict({id_col: part.column(0), "prefix_tokens": pa.array(tables, pa.list_(pa.int32()))})

    return df.select(id_col, text_col).mapInArrow(tidy(run), f"`{id_col}` {kind}, prefix_tokens array<int>")
