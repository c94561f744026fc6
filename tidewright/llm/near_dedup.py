"""Near-duplicate links by MinHash bands, filtered by odd sketches and confirmed on full shingle sets.

Texts of equal shingle sets are one node. A node has SAMPLES MinHash values; the first of them make BANDS band keys, and nodes that share
a key meet in a bucket. All samples are folded into a bitmap of SKETCH_BITS bits by flipping one bit for each: an odd sketch. The
population count of the XOR of two sketches is at most twice the number of samples that differ, and near it when similarity
is high, so a pair with a larger count than a pair at the threshold can have (to six standard deviations) needs no look at its sets.

Buckets are not expanded to pairs. Each is first joined as two stars, to leaders that differ from band to band; confirmed links make
components; then only members of one bucket that lie in different components are compared, in blocks: by sketches, and where those pass
by bitmaps of the whole sets, so that of a large group that is close but not linked no pairs leave a task. What is left is
confirmed on the sets. A link inside a component changes no result; every link between components is looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import drop_materialized, materialize, portions, tidy
from .suffix_dedup import Hasher, mixed, row_key

SAMPLES, BANDS, ROWS, SKETCH_BITS = 128, 26, 4, 512
#: Bytes hashed at a time; a longer text has a buffer of its own. Nodes in one block of a bucket that is compared whole.
PART, BLOCK = 1 << 20, 512

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True


class Shingler:
    """Sorted distinct hashes of a text's word shingles."""

    def __init__(self, words: int):
        self.words, self.hasher = words, Hasher(PART, 5)

    def __call__(self, text: bytes | pa.Buffer) -> np.ndarray:
        data = LOWER[np.frombuffer(text, np.uint8)]
        if len(data) >= len(self.hasher.up):
            self.hasher = Hasher(2 * len(data), 5)
        inside = np.concatenate([[False], ~IS_SPACE[data], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        if not len(edges):
            return np.zeros(0, np.uint64)
        word = self.hasher.of(self.hasher.sums(data), edges[::2], edges[1::2])
        n = min(self.words, len(word))
        shingle = np.full(len(word) - n + 1, n, np.uint64)
        for k in range(n):
            shingle = mixed(shingle + word[k : len(word) - n + 1 + k]) * np.uint64(0x94D049BB133111EB)
        return np.unique(shingle)


def sketch(shingles: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, odd sketch) of a set that is not empty."""
    least = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        np.minimum(least, (factors * shingles[None, at : at + 4096]).min(axis=1), out=least)
    bands = least[: BANDS * ROWS].reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = mixed(key + bands[:, k]) * np.uint64(0x94D049BB133111EB)
    bit = (mixed(least + np.arange(SAMPLES, dtype=np.uint64)) % np.uint64(SKETCH_BITS)).astype(np.int64)
    odd = np.bincount(bit, minlength=SKETCH_BITS) & 1
    return key.view(np.int64), np.packbits(odd.astype(np.uint8)).view(np.int64)


def bitmap(values: bytes) -> np.ndarray:
    """65,536 bits as 64-bit words, those of the 16-bit ``values`` set."""
    bits = np.zeros(1 << 16, np.uint8)
    bits[np.frombuffer(values, np.uint16)] = 1
    return np.packbits(bits).view(np.uint64)


def most_flips(threshold: float) -> int:
    """Largest XOR count that a pair of the threshold's similarity has, six standard deviations allowed for."""
    return int(2 * (SAMPLES * (1 - threshold) + 6 * (SAMPLES * threshold * (1 - threshold)) ** 0.5)) + 1


def flips(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def near_groups(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, n_shingles, component_id, kept, and key (row_key, for joining back).

    Letters A-Z are lowered and words are runs of bytes other than white space (0x20, 0x09-0x0D). A text's set holds its distinct
    shingles of ``words`` words; with fewer words, the whole sequence as one. Texts are linked when
    100 * |intersection| >= percent * |union|; components are those of the links, component_id is the least id in it.
    Null, empty and blank texts have no shingles and are linked with nothing (component_id: their own id). Rows of equal id and
    set are in one component and share ``kept``. A null id never is a component's id unless it is alone there.
    An empty table gives no rows. A link is missed only if no band agrees: 1 in a million at similarity 0.8, less above.
    """
    kind = df.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).alias("id"), row_key(F.col(id_col), text).alias("key"), text.alias("text"))
    ratio, limit = percent, most_flips(percent / 100)

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        factors = np.random.default_rng(7).integers(0, 1 << 63, (SAMPLES, 1), np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            for some in portions(batch, 2, PART):
                sets, size, keys, odds = [], [], [], []
                for t in some.column(2).cast(pa.binary()):
                    s = shingler(t.as_buffer())
                    key, odd = sketch(s, factors) if len(s) else (None, None)
                    size.append(len(s))
                    sets.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    keys.append(key)
                    odds.append(odd)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(size, pa.int64()), pa.array(sets, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(odds, pa.list_(pa.int64()))],
                    names=["id", "row", "n", "set", "bands", "odd"],
                )

    found = materialize(docs.mapInArrow(tidy(sketches), f"id {kind}, row binary, n long, set binary, bands array<long>, odd array<long>"), "sketches")
    nodes = found.where("n > 0").groupBy("set").agg(F.min("id").alias("least"), F.min("row").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("odd").alias("odd"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    entries = nodes.select(F.explode("bands").alias("key"), "node")
    pick = F.struct(F.xxhash64("key", "node").alias("h"), "node")
    buckets = entries.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min(pick)["node"].alias("l1"), F.max(pick)["node"].alias("l2")).where("c > 1")
    met = materialize(entries.join(buckets, "key"), "met")
    stars = met.select("node", F.explode(F.array("l1", "l2")).alias("leader")).where("node <> leader")
    stars = stars.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    sketched = nodes.select("node", "n", "odd")
    for side in ("a", "b"):
        stars = stars.join(sketched.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"), F.col("odd").alias(f"odd{side}")), side)
    near = (F.lit(100) * F.least("na", "nb") >= F.lit(ratio) * F.greatest("na", "nb")) & (flips(F.col("odda"), F.col("oddb")) <= limit)
    tried = materialize(stars.where(near).select("a", "b"), "tried")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        seen: set[int] = set()  # rows that repeat id and text have one key, so they come to one task, or to few where it is split
        for batch in batches:
            for some in portions(batch, 1, PART):
                nodes = some.column(0).to_pylist()
                new = [n not in seen and not seen.add(n) for n in nodes]
                sets = [shingler(t.as_buffer()) for t in some.column(1).cast(pa.binary()).filter(pa.array(new, pa.bool_()))]
                # of the 16-bit values of a set, which is all that a first comparison needs
                short = [np.unique((x >> np.uint64(48)).astype(np.uint16)).tobytes() for x in sets]
                yield pa.RecordBatch.from_arrays([some.column(0).filter(pa.array(new, pa.bool_())), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array(short, pa.binary())], names=["node", "shingles", "short"])

    reps = nodes.join(met.select("node").distinct(), "node").select("node", F.col("rep").alias("key"))
    texts = docs.join(reps, "key").select("node", "text")
    sets = materialize(texts.mapInArrow(tidy(sets_of), "node long, shingles binary, short binary"), "sets")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (c.to_pylist() for c in batch.columns[2:])
            linked = []
            for x, y in zip(a, b, strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= ratio * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    def confirmed(pairs: DataFrame) -> DataFrame:
        both = pairs
        for side in ("a", "b"):
            both = both.join(sets.select(F.col("node").alias(side), F.col("shingles").alias(f"s{side}")), side)
        return materialize(both.select("a", "b", "sa", "sb").mapInArrow(tidy(confirm), "a long, b long").distinct(), "links")

    links = confirmed(tried)
    roots = connected_components(links)
    placed = met.join(roots, "node", "left").select("key", "node", "c", F.coalesce("root", "node").alias("root"))
    mixed_buckets = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    parts = F.ceil(F.col("c") / BLOCK).cast("int")
    rest = placed.join(mixed_buckets, "key").withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rest = rest.join(sketched, "node").join(sets.select("node", "short"), "node").select("key", "node", "root", "n", "odd", "short", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    rest = rest.select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "node", "root", "n", "odd", "short")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []

        def flush() -> pa.RecordBatch:
            out: tuple = ([], [])
            p, q = group[0][1], group[0][2]
            left = [g for g in group if g[3] == p]
            right = [g for g in group if g[3] == q]
            node, root, size = (np.array([g[k] for g in right]) for k in (4, 5, 6))
            odd = np.array([g[7] for g in right], np.int64)
            maps = np.stack([bitmap(g[8]) for g in right]) if right else None
            for g in left if right else ():
                fits = (root != g[5]) & (100 * np.minimum(size, g[6]) >= ratio * np.maximum(size, g[6]))
                fits &= (node > g[4]) if p == q else True
                at = np.flatnonzero(fits)
                at = at[np.bitwise_count((odd[at] ^ np.array(g[7], np.int64)).view(np.uint64)).sum(axis=1) <= limit]
                if len(at):
                    mine = bitmap(g[8])
                    lost = g[6] - len(g[8]) // 2  # members that share a value: so many more may be common, at most
                    common = np.minimum(np.concatenate([np.bitwise_count(maps[some] & mine).sum(axis=1, dtype=np.int64) for some in np.array_split(at, len(at) // 64 + 1)]) + lost, np.minimum(size[at], g[6]))
                    at = at[100 * common >= ratio * (size[at] + g[6] - common)]
                out[0].extend(np.minimum(node[at], g[4]).tolist())
                out[1].extend(np.maximum(node[at], g[4]).tolist())
            group.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and row[:3] != group[0][:3]:
                    yield flush()
                group.append(row)
        if group:
            yield flush()

    pairs = rest.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(tidy(compare), "a long, b long").distinct()
    more = materialize(pairs.join(tried, ["a", "b"], "left_anti"), "more")
    links = links.unionByName(confirmed(more))
    roots = connected_components(links).withColumnRenamed("node", "linked")
    for done in (sets, met, tried, more):
        drop_materialized(done)
    classes = nodes.join(roots, F.col("node") == F.col("linked"), "left").select("set", "least", F.coalesce("root", "node").alias("root"))
    heads = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = classes.join(heads, "root").select("set", "component_id")
    out = found.where("n > 0").join(classes, "set").select("id", "n", "component_id", "row")
    out = out.unionByName(found.where("n = 0").select("id", "n", F.col("id").alias("component_id"), "row"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), F.col("row").alias("key"))


def drop_near_copies(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, without those whose component keeps another; repeated rows leave one."""
    groups = near_groups(df, words, percent, id_col, text_col)
    gone = groups.where(~F.col("kept")).select("key").distinct()
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])  # as one column, so that no name can clash
    held = df.select(row.alias("row"), row_key(F.col(id_col), text).alias("key"))
    return held.join(gone, "key", "left_anti").dropDuplicates(["key"]).select("row.*")
