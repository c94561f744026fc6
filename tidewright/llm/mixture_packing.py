"""Mixture-controlled packing: deficit round-robin over one token queue for each source.

Every document's ids go to the queue of its source. Time runs in windows; in each, queue s earns a quantum of
``window * weight[s] / (weights of queues that still hold tokens)`` and serves its whole credit, keeping the fraction as
its deficit for the next window. Because served tokens are then the floor of a cumulative, piecewise linear entitlement, the
schedule is a closed form: what any window takes from any queue follows from the queues' totals alone. So windows need
no sequential pass, deficits carry across windows and partitions exactly, and each task places its own documents.
Windows are laid out one after another and cut into sequences; only the very last sequence can be short.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .storage import materialize, tidy

#: From so many sources on, totals and places are kept in tables instead of the driver; the pieces are the same.
MAX_QUEUES = 4096
#: Most (queue, task) pairs whose places are sent to every task (some 40 bytes each).
SENT_ROWS = 200_000


class Schedule:
    """What deficit round-robin serves: ``served(s, w)`` tokens of queue s before window w."""

    def __init__(self, totals: list[int], weights: list[int] | None, window: int):
        self.totals, self.window = totals, window
        self.tokens = sum(totals)
        self.windows = -(-self.tokens // window)
        weights = [max(0, w) for w in weights] if weights else totals
        # phases: from token x on, queue s has been granted base[s] and earns rate[s] a token, until one runs dry
        self.from_x: list[Fraction] = []
        self.phases: list[tuple[list[Fraction], list[Fraction]]] = []
        x, base = Fraction(0), [Fraction(0)] * len(totals)
        while x < self.tokens:
            alive = [s for s, n in enumerate(totals) if base[s] < n]
            share = {s: weights[s] for s in alive if weights[s]} or dict.fromkeys(alive, 1)  # weight 0: served last
            whole = sum(share.values())
            rate = [Fraction(share.get(s, 0), whole) for s in range(len(totals))]
            self.from_x.append(x)
            self.phases.append((base, rate))
            step = min((totals[s] - base[s]) / rate[s] for s in share)
            x, base = x + step, [b + r * step for b, r in zip(base, rate, strict=True)]
        self.layouts: dict[int, tuple[list[int], list[int], list[int]]] = {}

    def served(self, s: int, w: int) -> int:
        if w >= self.windows:
            return self.totals[s]
        x = w * self.window
        n = bisect_right(self.from_x, x) - 1
        base, rate = self.phases[n]
        return int(base[s] + rate[s] * (x - self.from_x[n]))

    def layout(self, w: int) -> tuple[list[int], list[int], list[int]]:
        """For each queue: tokens served before and after window w, and the place of its slice in the whole output."""
        found = self.layouts.get(w)
        if found is None:
            if len(self.layouts) > 64:
                self.layouts.clear()
            before = [self.served(s, w) for s in range(len(self.totals))]
            after = [self.served(s, w + 1) for s in range(len(self.totals))]
            place, at = [], sum(before)
            for b, a in zip(before, after, strict=True):
                place.append(at)
                at += a - b
            found = self.layouts[w] = (before, after, place)
        return found

    def places(self, s: int, start: int, length: int) -> Iterator[tuple[int, int, int]]:
        """(position in queue s, output position, length) of the slices of ``length`` tokens from ``start`` on."""
        lo, hi = 0, self.windows  # the last window with served(s, w) <= start
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self.served(s, mid) <= start else (lo, mid)
        end, w = start + length, lo
        while start < end:
            before, after, place = self.layout(w)
            stop = min(end, after[s])
            if stop > start:
                yield start, place[s] + start - before[s], stop - start
                start = stop
            w += 1


class Clock:
    """The same schedule for any number of queues: what each has been served follows from its own total, its weight and the window.

    A queue of weight k has been served the floor of k times the window's level, until it runs dry; levels follow from how many queues
    there are of each weight and total. Queues of weight 0 have a level of their own, once the others are dry.
    """

    def __init__(self, counts: list[tuple[int, int, int]], window: int):
        self.windows = -(-sum(n * k for _, n, k in counts) // window)
        first = sum(n * k for weight, n, k in counts if weight)
        starts = [w * window for w in range(self.windows)]
        self.weighted = self._levels([c for c in counts if c[0]], starts)
        self.last = self._levels([(1, n, k) for weight, n, k in counts if not weight], [max(0, x - first) for x in starts])

    @staticmethod
    def _levels(counts: list[tuple[int, int, int]], starts: list[int]) -> list[tuple[int, int] | None]:
        counts = sorted(counts, key=lambda c: Fraction(c[1], c[0]))
        alive, dry, at, out = sum(weight * k for weight, _, k in counts), 0, 0, []
        for x in starts:
            while at < len(counts) and counts[at][1] * alive <= counts[at][0] * (x - dry):
                weight, n, k = counts[at]
                alive, dry, at = alive - weight * k, dry + n * k, at + 1
            out.append((x - dry, alive) if alive else None)
        return out

    def served(self, total: int, weight: int, w: int) -> int:
        level = None if w >= self.windows else (self.weighted if weight else self.last)[w]
        return total if level is None else min(total, (weight or 1) * level[0] // level[1])

    def slices(self, total: int, weight: int, start: int, length: int) -> Iterator[tuple[int, int, int]]:
        """(window, position in the queue, length) of the slices of ``length`` tokens from ``start`` on."""
        end = start + length
        while start < end:
            w = bisect_right(range(self.windows), start, key=lambda w: self.served(total, weight, w)) - 1
            stop = min(end, self.served(total, weight, w + 1))
            yield w, start, stop - start
            start = stop


def mixture_pack(
    df: DataFrame,
    vocabulary_path: str,
    sequence: int = 2048,
    window_sequences: int = 32,
    end_id: int = 1,
    weights: dict[str, int] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per piece: id_col, start, length, ids, doc_tokens, sequence_id, offset, queue.

    ``ids`` are little-endian unsigned 32-bit; a document's ids are those of its text and then ``end_id``. Each id lies in
    exactly one piece; a sequence's pieces fill it from offset 0 without gaps. ``weights`` are the wanted proportions of
    tokens by source (default: the sources' own totals, so that every window has the corpus's mix to within one token).
    Null text: empty, so one id. Null source: a queue of its own. A null id is kept. Repeated rows are separate documents.
    An empty table gives no rows. Texts of any length are cut at sequence and window ends. Other columns are not read.
    Every source has its own queue, however many there are.
    """
    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).cast("string").alias("queue"))
    many = docs.select("queue").distinct().limit(MAX_QUEUES).count() >= MAX_QUEUES

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, done = bpe.encoder(vocabulary_path), TaskContext.get().partitionId(), {}
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            for at in range(0, len(batch), 64):
                some = batch.slice(at, 64)
                queues = some.column(2).to_pylist()
                ids = [x + end for x in encoder.encode([t or "" for t in some.column(1).to_pylist()])]
                starts = []
                for q, x in zip(queues, ids, strict=True):
                    starts.append(done.get(q, 0))
                    done[q] = starts[-1] + len(x) // 4
                narrow = [_narrow(x) for x in ids]
                yield pa.RecordBatch.from_pydict({
                    "id": some.column(0), "queue": pa.array(queues, pa.string()), "part": pa.array([part] * len(ids), pa.int32()),
                    "start": pa.array(starts, pa.int64()), "n": pa.array([len(x) // 4 for x in ids], pa.int64()),
                    "wide": pa.array([w for w, _ in narrow], pa.bool_()), "ids": pa.array([x for _, x in narrow], pa.binary()),
                })

    schema = f"id {kind}, queue string, part int, start long, n long, wide boolean, ids binary"
    stored = materialize(docs.mapInArrow(tidy(tokenize), schema), "ids")
    totals = stored.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("queue").alias("q"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # as a rule a few rows for each task: counted, then sent to every task, so that the ids need not move; else joined
    bases = materialize(bases, "bases")
    small = bases.count() <= SENT_ROWS
    placed = stored.join(F.broadcast(bases) if small else bases, F.col("queue").eqNullSafe(F.col("q")) & (F.col("part") == F.col("p")))

    fields = pa.schema([
        (id_col, batch_type(df, id_col)), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()), ("offset", pa.int64()), ("queue", pa.string()),
    ])
    out = f"`{id_col}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, queue string"
    if many:
        return _cut_by_table(placed, totals, weights, sequence, sequence * window_sequences, kind, fields, out)
    whole = sorted(((r.queue, r.n) for r in totals.groupBy("queue").agg(F.sum("n").alias("n")).collect()), key=lambda r: (r[0] is not None, r[0]))
    names = {q: s for s, (q, _) in enumerate(whole)}
    plan = ([n for _, n in whole], [weights.get(q, 0) for q, _ in whole] if weights else None, sequence * window_sequences)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schedule = Schedule(*plan)
        for batch in batches:
            for at in range(0, len(batch), 256):
                out: list[list] = [[] for _ in range(8)]
                for row in batch.slice(at, 256).to_pylist():
                    ids = row["ids"] if row["wide"] else np.frombuffer(row["ids"], "<u2").astype("<u4").tobytes()
                    first = row["base"] + row["start"]
                    for start, place, length in schedule.places(names[row["queue"]], first, row["n"]):
                        while length:
                            take = min(length, sequence - place % sequence)
                            a = start - first
                            for column, x in zip(out, (row["id"], a, take, ids[4 * a : 4 * (a + take)], row["n"], place // sequence, place % sequence, row["queue"]), strict=True):
                                column.append(x)
                            start, place, length = start + take, place + take, length - take
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, fields, strict=True)], schema=fields)

    return placed.select("id", "queue", "start", "n", "wide", "ids", "base").mapInArrow(tidy(cut), out)


def _cut_by_table(placed: DataFrame, totals: DataFrame, weights: dict[str, int] | None, sequence: int, window: int, kind: str, fields: pa.Schema, out: str) -> DataFrame:
    """The pieces of ``placed`` documents; totals, weights and places of all sources are joined from tables."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            queues, ns = (c.to_pylist() for c in batch.columns)
            ks = [max(0, weights.get(q, 0)) for q in queues] if weights else ns
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ks, pa.int64())], names=["q", "total", "weight"])

    sums = totals.groupBy("queue").agg(F.sum("n").alias("total"))
    sources = materialize(sums.mapInArrow(tidy(weigh), "q string, total long, weight long"), "sources")
    # at most some square root of all tokens for each weight, as that many different totals need that many tokens
    clock = Clock([(r.weight, r.total, r.k) for r in sources.groupBy("weight", "total").agg(F.count(F.lit(1)).alias("k")).collect()], window)

    def slice_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, total, weight in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ws, starts, lengths = zip(*clock.slices(total, weight, 0, total), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(ws), pa.string()), pa.array(ws, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64())], names=["q", "w", "first", "taken"])

    slices = materialize(sources.mapInArrow(tidy(slice_up), "q string, w long, first long, taken long"), "slices")
    earlier = lambda w: F.coalesce(F.sum("taken").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    windows = slices.groupBy("w").agg(F.sum("taken").alias("taken")).select(F.col("w").alias("_w"), earlier(Window.orderBy("w")).alias("whole"))  # one row a window
    inside = slices.withColumn("inside", earlier(Window.partitionBy("w").orderBy(F.col("q").asc_nulls_first())))
    places = inside.join(windows, F.col("w") == F.col("_w")).select(F.col("q").alias("_q"), F.col("w").alias("_w"), (F.col("whole") + F.col("inside") - F.col("first")).alias("shift"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                rows: list[list] = [[] for _ in range(7)]
                for row in batch.slice(at, 256).to_pylist():
                    ids = row["ids"] if row["wide"] else np.frombuffer(row["ids"], "<u2").astype("<u4").tobytes()
                    first = row["base"] + row["start"]
                    for w, position, length in clock.slices(row["total"], row["weight"], first, row["n"]):
                        a = position - first
                        for column, x in zip(rows, (row["id"], row["queue"], w, position, a, ids[4 * a : 4 * (a + length)], row["n"]), strict=True):
                            column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, parts, strict=True)], names=["id", "queue", "w", "position", "a", "ids", "n"])

    parts = [fields.field(0).type, pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
    known = placed.join(sources.withColumnRenamed("q", "_s"), F.col("queue").eqNullSafe(F.col("_s"))).select("id", "queue", "start", "n", "wide", "ids", "base", "total", "weight")
    found = known.mapInArrow(tidy(split), f"id {kind}, queue string, w long, position long, a long, ids binary, n long")
    found = found.join(places, F.col("queue").eqNullSafe(F.col("_q")) & (F.col("w") == F.col("_w"))).withColumn("place", F.col("shift") + F.col("position"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                rows: list[list] = [[] for _ in range(8)]
                for row in batch.slice(at, 256).to_pylist():
                    done, place, length = 0, row["place"], len(row["ids"]) // 4
                    while done < length:
                        take = min(length - done, sequence - place % sequence)
                        for column, x in zip(rows, (row["id"], row["a"] + done, take, row["ids"][4 * done : 4 * (done + take)], row["n"], place // sequence, place % sequence, row["queue"]), strict=True):
                            column.append(x)
                        done, place = done + take, place + take
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, fields, strict=True)], schema=fields)

    return found.select("id", "queue", "a", "ids", "n", "place").mapInArrow(tidy(cut), out)


def batch_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def _narrow(ids: bytes) -> tuple[bool, bytes]:
    """Two bytes an id where every id fits: half the stored table."""
    x = np.frombuffer(ids, "<u4")
    return (True, ids) if x.max(initial=0) > 0xFFFF else (False, x.astype("<u2").tobytes())
