"""Removal of long repeated byte strings, by suffix arrays that are built apart for each class of places.

A suffix array of the whole corpus would shuffle every byte position many times over. Instead every string of ``size`` bytes
is dealt to one class by its own content: of the GRAM-byte grams inside it, the one of least hash (the last of equal
ones) is its anchor, and the gram's hash is its class. Equal strings have equal grams, hence one class and one place in it. Neighbouring
strings share anchors, so there is about one anchor for 80 bytes, and only anchors are shuffled:

1. anchors of a class that occurs once hold no repeat;
2. anchors whose whole stretch of strings is that of another, by a 64-bit hash within the class, hold nothing but repeats;
3. of the other classes one anchor for each different stretch goes on with its bytes. Classes are dealt to tasks, and a task
   builds suffix arrays of blocks of classes by the difference-cover algorithm (see suffixes) and compares the first
   ``size`` bytes of neighbours;
4. a class of more than MAX_CLASS different stretches is never gathered: its strings are counted by 128-bit hash, first in cells of
   CELL neighbouring strings, and one by one only where cells in one place differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import drop_materialized, materialize, tidy
from .suffixes import repeated_windows

GRAM = 32
#: Bytes that are hashed at a time (longer texts in overlapping parts), and bytes of one suffix array.
PART, BLOCK = 1 << 20, 1 << 19
MAX_CLASS, CELL = 2048, 16

MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)


class Hasher:
    """Polynomial hashes modulo 2**64 of all substrings of a buffer, bytes first replaced by fixed random numbers."""

    def __init__(self, longest: int, seed: int = 0):
        self.letters = np.random.default_rng(20260 + seed).integers(0, 1 << 64, 256, np.uint64)
        self.up = self._powers(MULTIPLIER, longest + 1)
        self.down = self._powers(INVERSE, longest + 1)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.letters[data] * self.up[: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((sums[stop] - sums[start]) * self.down[start])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i:i+width] for each i, by minima from both ends of blocks."""
    n = len(x)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(rows, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def row_key(id_: Column, text: Column) -> Column:
    """128 bits of the SHA-256 of id and text: rows that share it are one another's repeats; it tells rows of one (or a null) id apart."""
    id_ = F.coalesce(id_.cast("string"), F.lit("null"))
    return F.unhex(F.substring(F.sha2(F.concat(F.length(id_), F.lit("|"), id_, text), 256), 1, 32))


def anchors(hasher: Hasher, data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(class, stretch hash, first string's start, number of strings) of each anchor of one text or part of ``size`` bytes or more."""
    sums = hasher.sums(data)
    at = np.arange(len(data) - GRAM + 1)
    grams = hasher.of(sums, at, at + GRAM)
    # order by 40 bits of the hash; among equal ones the last comes first
    key = (grams & np.uint64(0xFFFFFFFFFF000000)) | (np.uint64(0xFFFFFF) - at.astype(np.uint64))
    least = sliding_min(key, size - GRAM + 1)
    chosen = np.uint64(0xFFFFFF) - (least & np.uint64(0xFFFFFF))
    first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    count = np.diff(np.append(first, len(chosen)))
    where = chosen[first].astype(np.int64)
    stretch = hasher.of(sums, first, first + count - 1 + size) ^ mixed((where - first).astype(np.uint64))
    return grams[where], stretch, first, count


def remove_repeats(
    df: DataFrame, size: int = 200, id_col: str = "doc_id", text_col: str = "text", max_class: int = MAX_CLASS, carry: bool = False
) -> DataFrame:
    """One row per input row: id_col, n_bytes, n_removed, n_spans, spans, kept (binary: the bytes left); with ``carry`` also
    ``row``, a struct of all of the row's columns, so that nothing need be joined back by id.

    Removed is each byte that lies in a string of ``size`` bytes (UTF-8) that begins anywhere else too, in the same text or another;
    overlapping occurrences count, matches never cross texts, and strings are judged on the input. ``spans`` are the maximal
    removed runs as (start, stop). Null text: empty, 0 bytes. Texts shorter than ``size`` stay whole. Rows that repeat id and
    text repeat each other, so both lose all of ``size`` or more bytes. Null ids are kept. An empty table gives no rows.
    """
    kind = df.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns] if carry else [])
    carried = df.select(F.col(id_col).alias("id"), row_key(F.col(id_col), text).alias("key"), text.alias("text"), *[row.alias("row")] * carry)
    docs = carried.select("key", "text")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(PART)
        for batch in batches:
            keys = batch.column(0)
            rows, found = [], []
            for i, data in enumerate(batch.column(1).cast(pa.binary())):
                data = np.frombuffer(data.as_buffer(), np.uint8)
                for at in range(0, max(0, len(data) - size + 1), PART - size + 1):
                    part = data[at : at + PART]
                    if len(part) >= size:
                        h, stretch, first, count = anchors(hasher, part, size)
                        found.append((h, stretch, first + at, count))
                        rows.append(np.full(len(h), i))
                if found and (sum(map(len, rows)) > 100_000 or i + 1 == len(batch)):
                    h, stretch, first, count = map(np.concatenate, zip(*found, strict=True))
                    take = pa.array(np.concatenate(rows))
                    yield pa.RecordBatch.from_arrays(
                        [keys.take(take), pa.array(h.view(np.int64)), pa.array(stretch.view(np.int64)), pa.array(first), pa.array(count.astype(np.int32))],
                        names=["key", "h", "stretch", "first", "n"],
                    )
                    rows, found = [], []

    places = materialize(docs.mapInArrow(tidy(find), "key binary, h long, stretch long, first long, n int"), "places")
    classes = places.groupBy("h").agg(F.count(F.lit(1)).alias("times"), F.min("stretch").alias("lo"), F.max("stretch").alias("hi")).where("times > 1")
    # as a table of its own: a class that holds many of the anchors can then be split between tasks where it is joined
    classes = materialize(classes.select("h", (F.col("lo") == F.col("hi")).alias("alike")), "classes")
    shared = materialize(places.join(classes, "h"), "shared")
    drop_materialized(places)
    drop_materialized(classes)
    # one place for each stretch of a class, with how many there are; `times` > 1: each of them repeats as a whole
    stretches = shared.where("not alike").groupBy("h", "stretch").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("key", "first", "n")).alias("p"))
    stretches = materialize(stretches.select("h", "stretch", "times", "p.*"), "stretches")
    repeated = stretches.where("times > 1").select("h", "stretch")
    whole = shared.where("alike").unionByName(shared.where("not alike").join(repeated, ["h", "stretch"], "left_semi"))
    whole = whole.select("key", "first", (F.col("first") + F.col("n") - 1 + size).alias("stop"))

    wide = stretches.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > max_class).select("h")
    wanted = stretches.join(wide.withColumn("wide", F.lit(True)), "h", "left")
    wanted = wanted.groupBy("key").agg(F.collect_list(F.struct("h", "first", "n", "times", F.coalesce("wide", F.lit(False)).alias("wide"))).alias("places"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                some = batch.slice(at, 64)
                out: list[list] = [[] for _ in range(6)]
                for key, data, found in zip(some.column(0).to_pylist(), some.column(1).cast(pa.binary()).to_pylist(), some.column(2).to_pylist(), strict=True):
                    for p in found:
                        row = (key, p["h"], p["first"], p["times"], p["wide"], data[p["first"] : p["first"] + p["n"] - 1 + size])
                        for column, x in zip(out, row, strict=True):
                            column.append(x)
                types = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["key", "h", "first", "times", "wide", "data"])

    held = docs.join(wanted, "key").select("key", "text", "places")
    # rows that repeat id and text hold the same bytes: one is enough, and stands for a stretch that has another place
    bytes_of = held.mapInArrow(tidy(read), "key binary, h long, first long, times long, wide boolean, data binary")
    bytes_of = materialize(bytes_of, "bytes")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        held_bytes, last = 0, None

        def flush() -> pa.RecordBatch:
            firsts, stops, rows = [], [], []
            for row, hit in zip(held, repeated_windows([r[3] for r in held], size), strict=True):
                edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
                for a, b in edges.reshape(-1, 2).tolist():
                    rows.append(row)
                    firsts.append(row[2] + a)
                    stops.append(row[2] + b - 1 + size)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array(firsts, pa.int64()), pa.array(stops, pa.int64())], names=["key", "first", "stop"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[1] != last and held_bytes >= BLOCK:  # a class never lies in two blocks
                    yield flush()
                    held_bytes = 0
                last = row[1]
                held.append(row)
                held_bytes += len(row[3])
        if held:
            yield flush()

    narrow = bytes_of.where("not wide").dropDuplicates(["key", "h", "first"]).select("key", "h", "first", "data")
    partly = narrow.repartition("h").sortWithinPartitions("h").mapInArrow(tidy(compare), "key binary, first long, stop long")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The strings of a place by cells of CELL strings, counted from the anchor, so that equal strings lie in equal cells."""
        grams, one, two = Hasher(2 * size + 2), Hasher(2 * size + 2, 1), Hasher(2 * size + 2, 2)
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for key, h, first, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = np.frombuffer(text, np.uint8)
                at = np.arange(size - GRAM + 1)
                anchor = int(np.flatnonzero(grams.of(grams.sums(data), at, at + GRAM).view(np.int64) == h)[-1])
                a, b = one.sums(data), two.sums(data)
                starts = np.arange(len(data) - size + 1)
                cell = (anchor - starts) // CELL
                for c in np.unique(cell):
                    mine = starts[cell == c]
                    lo, hi = mine[:1], mine[-1:] + size
                    row = (h, int(c), int(one.of(a, lo, hi).view(np.int64)[0]), int(two.of(b, lo, hi).view(np.int64)[0]), key, first + int(lo[0]), len(mine), text[lo[0] : hi[0]])
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["h", "cell", "a", "b", "key", "first", "n", "data"])

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = Hasher(2 * size + 2, 1), Hasher(2 * size + 2, 2)
        for batch in batches:
            take, firsts, a, b = [], [], [], []
            for i, (first, data) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                data = np.frombuffer(data, np.uint8)
                at = np.arange(len(data) - size + 1)
                for hasher, out in ((one, a), (two, b)):
                    out.append(hasher.of(hasher.sums(data), at, at + size).view(np.int64))
                take.append(np.full(len(at), i))
                firsts.append(at + first)
            if take:
                rows = pa.array(np.concatenate(take))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(3).take(rows), pa.array(np.concatenate(firsts)), pa.array(np.concatenate(a)), pa.array(np.concatenate(b))],
                    names=["key", "times", "first", "a", "b"],
                )

    hot = bytes_of.where("wide").dropDuplicates(["key", "h", "first"]).select("key", "h", "first", "data")
    hot = hot.mapInArrow(tidy(cells), "h long, cell int, a long, b long, key binary, first long, n int, data binary")
    hot = materialize(hot, "cells")
    cell = ["h", "cell", "a", "b"]
    kinds = hot.groupBy(*cell).agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("key", "first", "data")).alias("p"))
    kinds = materialize(kinds.select(*cell, "times", "p.*"), "kinds")
    whole_cells = hot.join(kinds.where("times > 1").select(*cell), cell, "left_semi")
    several = kinds.groupBy("h", "cell").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h", "cell")
    single = kinds.join(several, ["h", "cell"], "left_semi").select("key", "first", "data", "times")
    single = single.mapInArrow(tidy(strings), "key binary, times long, first long, a long, b long")
    often = single.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("a", "b")
    hot_spans = single.where("times = 1").join(often, ["a", "b"], "left_semi").select("key", "first", (F.col("first") + size).alias("stop"))
    hot_spans = hot_spans.unionByName(whole_cells.select("key", "first", (F.col("first") + F.col("n") - 1 + size).alias("stop")))
    spans = whole.unionByName(partly).unionByName(hot_spans)
    spans = spans.groupBy("key").agg(F.collect_set(F.struct("first", "stop")).alias("found"))
    out = carried.join(spans, "key", "left").select("id", "text", "found", *["row"] * carry)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.slice(at, 256)
                texts = some.column(1).cast(pa.binary()).to_pylist()
                merged = [merge(found or []) for found in some.column(2).to_pylist()]
                kept = [b"".join(t[a:b] for a, b in zip([0, *(s[1] for s in m)], [*(s[0] for s in m), len(t)], strict=True)) for t, m in zip(texts, merged, strict=True)]
                yield pa.RecordBatch.from_arrays([
                    some.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(t) - len(k) for t, k in zip(texts, kept, strict=True)], pa.int64()),
                    pa.array([len(m) for m in merged], pa.int64()), pa.array([[{"start": a, "stop": b} for a, b in m] for m in merged], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                    pa.array(kept, pa.binary()), *some.columns[3:],
                ], names=[id_col, "n_bytes", "n_removed", "n_spans", "spans", "kept", "row"][: 6 + carry])

    schema = f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,stop:long>>, kept binary"
    return out.mapInArrow(tidy(cut), schema + (f", row {out.schema['row'].dataType.simpleString()}" if carry else ""))


def strip_repeats(df: DataFrame, size: int = 200, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The rows of ``df``, all columns, their texts without repeated strings; a character that is covered in part stays whole.

    ``length_col``, where there is one, becomes the new length in characters. Null texts stay null.
    """
    found = remove_repeats(df, size, id_col, text_col, carry=True)

    @F.pandas_udf("string")
    def left(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or s is None or not len(s) else _whole_characters(t.encode(), s) for t, s in zip(text, spans, strict=True)], dtype=object)

    text = left(F.col(f"row.`{text_col}`"), F.col("spans"))
    found = found.select("row", text.alias("left"))
    of = {c: F.col(f"row.`{c}`") for c in df.columns} | {text_col: F.col("left")}
    if length_col in df.columns:
        of[length_col] = F.length("left").cast(df.schema[length_col].dataType)
    return found.select(*[of[c].alias(c) for c in df.columns])


def _whole_characters(data: bytes, spans) -> str:
    out, at = [], 0
    inside = lambda i: i < len(data) and data[i] & 0xC0 == 0x80  # noqa: E731  within a character
    for span in spans:
        a, b = span["start"], span["stop"]
        while a < b and inside(a):
            a += 1
        while b > a and inside(b):
            b -= 1
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]]).decode()


def merge(found: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((f["first"], f["stop"]) for f in found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
