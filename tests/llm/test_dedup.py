"""Exact, near and substring deduplication, components and search: against brute force."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidewright.llm.components import connected_components
from tidewright.llm.exact_dedup import drop_exact_copies, exact_groups
from tidewright.llm.hamming_search import nearest_codes
from tidewright.llm.near_dedup import drop_near_copies, near_groups
from tidewright.llm.queries import llm_oracle_sql, llm_queries, table
from tidewright.llm.suffix_dedup import remove_repeats, strip_repeats
from tidewright.llm.suffixes import repeated_windows, suffix_array


def test_suffix_array_and_windows():
    rng = random.Random(2)
    for _ in range(400):
        s = [rng.randint(0, rng.choice([0, 1, 2, 5])) for _ in range(rng.randint(0, 16))]
        assert suffix_array(np.array(s, np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        size = rng.choice([3, 8, 9, 12])
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 4))]
        c = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
        assert [x.tolist() for x in repeated_windows(texts, size)] == [[c[t[i : i + size]] > 1 for i in range(len(t) - size + 1)] for t in texts]


def brute_repeats(docs, size):
    c = Counter(b[i : i + size] for _, b in docs for i in range(len(b) - size + 1))
    out = []
    for k, b in docs:
        m = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if c[b[i : i + size]] > 1:
                m[i : i + size] = b"\1" * size
        spans = sum(1 for i in range(len(m)) if m[i] and (i == 0 or not m[i - 1]))
        out.append((k, len(b), sum(m), spans, hashlib.sha256(bytes(x for x, y in zip(b, m) if not y)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [2048, 1])
def test_op10_against_brute_force(spark, odd_docs, no_docs, most):
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("s")]
    for docs in (odd_docs, table(spark, SF, "documents").where("doc_id < 60")):
        got = sorted((tuple(r) for r in remove_repeats(docs, max_class=most).select(*columns).collect()), key=repr)
        assert got == brute_repeats([(r.doc_id, (r.text or "").encode()) for r in docs.collect()], 200)
    assert remove_repeats(no_docs, max_class=most).count() == 0


def test_strip_keeps_rows_and_characters(spark):
    shared = "é" * 150
    docs = spark.createDataFrame([(1, "a" + shared + "b", 9, "z"), (2, "x" + shared, 9, "z"), (3, None, None, None)], "doc_id long, text string, n_chars long, left string")
    got = {r.doc_id: (r.text, r.n_chars, r.left) for r in strip_repeats(docs).collect()}
    assert got == {1: ("ab", 2, "z"), 2: ("x", 1, "z"), 3: (None, None, None)}


def test_op7(spark, odd_docs, no_docs):
    got = {(r.doc_id, r.text_sha256): (r.keep_id, r.group_size, r.kept) for r in exact_groups(odd_docs).collect()}
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    cat = sha("the cat sat on the mat and looked at the dog " * 12)
    assert got[1, cat] == (2, 3, False) and got[2, cat] == (2, 3, True)
    assert got[None, sha("one two")] == (6, 2, False) and got[4, sha("")] == (4, 3, True) and got[3, sha("")] == (4, 3, False)
    kept = drop_exact_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 5, 6, 7, 8, 9, 10]
    assert exact_groups(no_docs).count() == 0 and drop_exact_copies(no_docs).count() == 0
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = duck.sql(llm_oracle_sql()["op7_exact_dedup"]).fetchall()
    assert sorted(want) == sorted(tuple(r) for r in llm_queries()["op7_exact_dedup"](spark, SF).collect())


def brute_near(docs, words, percent):
    def shingles(text):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()

    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(docs):
        r = find(i)
        known = [x for x in (least.get(r), k) if x is not None]
        least[r] = min(known) if known else None
    return sorted(((docs[i][0], len(sets[i]), least[find(i)]) for i in range(len(docs))), key=repr)


def test_op5_against_brute_force(spark, odd_docs, no_docs):
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 400)}" for _ in range(120)]
    near = []
    for n in range(60):  # a group whose members are close to each other, but not all linked
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"v{rng.randint(0, 999)}"
        near.append((100 + n, " ".join(w)))
    for rows in (near, [(r.doc_id, r.text) for r in odd_docs.collect()]):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = sorted((tuple(r) for r in near_groups(docs, 3, 85).select("doc_id", "n_shingles", "component_id").collect()), key=repr)
        assert got == brute_near(rows, 3, 85)
    kept = drop_near_copies(odd_docs, 3, 85)
    assert kept.columns == odd_docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "5", "6", "7", "8", "9", "None"]
    assert near_groups(no_docs, 3, 85).count() == 0


def test_op5_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in llm_queries()["op5_near_dedup"](spark, SF).collect())
    assert got == sorted(brute_near(docs, 3, 85))


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (3, 1), *[(100 + i, 101 + i) for i in range(40)]], "a long, b long")
    got = {r.node: r.root for r in connected_components(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8} | {100 + i: 100 for i in range(41)}
    assert connected_components(links.limit(0)).count() == 0


def test_op8(spark):
    rng = random.Random(6)
    codes = [rng.getrandbits(16) for _ in range(60)]
    rows = [(i, rng.choice(codes) ^ (1 << rng.randrange(16))) for i in range(200)] + [(None, 3), (500, None), (7, codes[0])]
    rows = [r for r in rows if r[0] != 7] + [(7, 5), (7, 5)]
    got = sorted((r.query_id, r.rank, r.neighbor_id, r.distance) for r in nearest_codes(spark.createDataFrame(rows, "vec_id long, code long"), F.col("vec_id") % 50 == 0, k=5, bits=16).collect())
    held = sorted({r for r in rows if None not in r})
    want = []
    for q, code in held:
        if q % 50 == 0:
            near = sorted((bin(code ^ c).count("1"), i) for i, c in held if i != q)[:5]
            want += [(q, n + 1, i, d) for n, (d, i) in enumerate(near)]
    assert got == sorted(want)
    few = spark.createDataFrame([(0, 1), (1, 2)], "vec_id long, code long")
    assert [tuple(r) for r in nearest_codes(few, F.col("vec_id") == 0, k=5, bits=16).collect()] == [(0, 1, 1, 2)]
    assert nearest_codes(few.limit(0), F.lit(True), k=5, bits=16).count() == 0
    duck = duckdb.connect()
    duck.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = duck.sql(llm_oracle_sql()["op8_hamming_search"])
    assert sorted(want.fetchall()) == sorted(tuple(r) for r in llm_queries()["op8_hamming_search"](spark, SF).select(*want.columns).collect())
