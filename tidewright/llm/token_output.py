"""Packed token-id matrices: best-fit-decreasing packing, the bin found by a segment tree over remaining capacities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import bpe
from .storage import tidy

#: Tokens that one packing block holds: the bound on a task's memory, whatever its partition's size.
BLOCK_TOKENS = 4_000_000


class Capacities:
    """Segment tree over capacities 1..size: which have an open bin, and the least of them that holds a given need."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.open = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(self.leaves)]

    def _add(self, capacity: int, n: int) -> None:
        i = capacity + self.leaves
        while i:
            self.open[i] += n
            i //= 2

    def put(self, capacity: int, which: int) -> None:
        self.bins[capacity].append(which)
        self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, bin) of the tightest open bin with at least ``need`` left; it is taken out."""
        i = need + self.leaves
        if not self.open[i]:
            while i > 1 and (i % 2 or not self.open[i + 1]):  # up to the first right sibling with an open bin
                i //= 2
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.open[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        self._add(capacity, -1)
        return capacity, self.bins[capacity].pop()


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Bins as lists of piece numbers; every length is 1..size. Equal lengths keep their order, so the result is fixed."""
    tree, bins = Capacities(size), []
    for piece in sorted(range(len(lengths)), key=lambda p: -lengths[p]):
        found = tree.take(lengths[piece])
        if found is None:
            found = size, len(bins)
            bins.append([])
        left, which = found
        bins[which].append(piece)
        if left > lengths[piece]:
            tree.put(left - lengths[piece], which)
    return bins


def pack_token_ids(
    df: DataFrame,
    vocabulary_path: str,
    sequence: int = 2048,
    end_id: int | None = None,
    pad_id: int = 0,
    id_bytes: int = 4,
    positions: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per packed sequence, a row of the id matrix:

    sequence_id, n_tokens, ids (binary, ``sequence`` little-endian unsigned ids of ``id_bytes`` bytes, padded with ``pad_id``),
    cu_seqlens (cumulative segment lengths from 0), position_resets (where positions start again), first_positions (the
    position each segment starts with: 0, or for a later part of a split document its start there), segment_ids (id_col of
    each segment), and with ``positions`` position_ids (binary, little-endian unsigned 32-bit, one for each id).

    ``id_bytes`` 2 halves the matrix where all ids are below 65,536; a larger id then raises.

    Documents of at most ``sequence`` ids stay whole; longer ones are split losslessly into full rows and a rest. A document's
    ids end in ``end_id`` (default: the vocabulary's own end-of-text). Null text: empty, so just that id. Repeated rows are
    packed each; a null id is kept; an empty table gives no rows. Packing runs in blocks of BLOCK_TOKENS inside a partition: no shuffle.
    sequence_id holds partition and number, so a task that runs again writes the same rows.
    """
    from .mixture_packing import batch_type

    kind, id_type = df.schema[id_col].dataType.simpleString(), batch_type(df, id_col)
    fields = pa.schema([
        ("sequence_id", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())),
        ("first_positions", pa.list_(pa.int64())), ("segment_ids", pa.list_(id_type)), *[("position_ids", pa.binary())] * positions,
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number = bpe.encoder(vocabulary_path), TaskContext.get().partitionId() << 33
        end = encoder.special if end_id is None else end_id.to_bytes(4, "little")
        pieces: list[tuple[object, int, bytes]] = []  # (document, its ids before, ids)
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, held
            rows: list[list] = [[] for _ in fields]
            for members in best_fit_decreasing([len(p[2]) // 4 for p in pieces], sequence):
                chosen = [pieces[m] for m in members]
                lengths = [len(ids) // 4 for _, _, ids in chosen]
                ends = np.cumsum([0, *lengths])
                ids = np.full(sequence, pad_id, "<u4")
                ids[: ends[-1]] = np.frombuffer(b"".join(ids for _, _, ids in chosen), "<u4")
                if ids.max() >> 8 * id_bytes:
                    raise ValueError(f"id {ids.max()} does not fit in {id_bytes} bytes")
                row = [number, int(ends[-1]), ids.astype(f"<u{id_bytes}").tobytes(), ends, ends[:-1], [p[1] for p in chosen], [p[0] for p in chosen]]
                if positions:
                    at = np.zeros(sequence, "<u4")
                    at[: ends[-1]] = np.concatenate([np.arange(first, first + n) for (_, first, _), n in zip(chosen, lengths, strict=True)])
                    row.append(at.tobytes())
                for column, x in zip(rows, row, strict=True):
                    column.append(x)
                number += 1
                if len(rows[0]) == 256:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, fields, strict=True)], schema=fields)
                    rows = [[] for _ in fields]
            pieces.clear()
            held = 0
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, fields, strict=True)], schema=fields)

        for batch in batches:
            for at in range(0, len(batch), 64):
                some = batch.slice(at, 64)
                for doc, ids in zip(some.column(0).to_pylist(), encoder.encode([t or "" for t in some.column(1).to_pylist()]), strict=True):
                    ids += end
                    for cut in range(0, len(ids), 4 * sequence):
                        pieces.append((doc, cut // 4, ids[cut : cut + 4 * sequence]))
                    held += len(ids) // 4
                if held >= BLOCK_TOKENS:
                    yield from flush()
        yield from flush()

    schema = f"sequence_id long, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, first_positions array<long>, segment_ids array<{kind}>" + ", position_ids binary" * positions
    return df.select(id_col, text_col).mapInArrow(tidy(run), schema)
