"""Token counts, packing, pieces: against the libraries."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import SF
from tidewright.llm import bpe
from tidewright.llm.mixture_packing import Schedule, mixture_pack
from tidewright.llm.piece_sampling import decode_pieces, pieces, sample_pieces
from tidewright.llm.queries import llm_queries, table, vocabulary_path
from tidewright.llm.token_counts import prefix_tables, token_counts
from tidewright.llm.token_output import best_fit_decreasing, pack_token_ids

PATH = vocabulary_path()
PARTS = st.lists(st.sampled_from(["a", "the", "ing", " ", "  ", "\n", "'", "'s", "'re", "1", "é", "ß", "!", "<|endoftext|>", "<|endo", " ", "日本", "\x1c", "😀", " word"]), max_size=12).map("".join)


@pytest.fixture(scope="module")
def library():
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@settings(max_examples=150, deadline=None)
@given(PARTS)
def test_prefix_counts_are_the_librarys(library, text):
    want = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
    counts = bpe.prefix_counts(PATH)
    assert counts.table(text) == want and counts.count(text) == want[-1]
    assert counts.within(text, 3) == max(i for i, n in enumerate(want) if n <= 3)


@settings(max_examples=150, deadline=None)
@given(st.one_of(PARTS, st.text(max_size=30)))
def test_ids_are_the_librarys(library, text):
    text = text.encode("utf-8", "ignore").decode()
    assert np.frombuffer(bpe.encoder(PATH).encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_op4_on_odd_rows(odd_docs, no_docs, library):
    rows = token_counts(odd_docs, PATH, limit=20, cut=True).collect()
    texts = odd_docs.select("doc_id", "text").collect()
    assert len(rows) == len(texts)
    for r, t in zip(rows, texts, strict=True):
        want = len(library.encode(t.text or "", add_special_tokens=False).ids)
        assert (r.doc_id, r.n_tokens, r.n_bytes, r.over_limit) == (t.doc_id, want, len((t.text or "").encode()), want > 20)
    assert token_counts(no_docs, PATH).count() == 0
    assert [r.prefix_tokens for r in prefix_tables(odd_docs.where("doc_id = 3"), PATH).collect()] == [[0]]


def test_op4_whole_table(spark, library):
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    for r in llm_queries()["op4_token_counts"](spark, SF).collect():
        assert r.n_tokens == len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)


def check_pieces(rows, ids):
    seen, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        seen[r.doc_id].append((r.start, r.length, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc, all_ids in ids.items():
        at = 0
        for start, length, tokens in sorted(seen[doc]):
            assert start == at and tokens == len(all_ids)
            at += length
        assert at == len(all_ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
    return sequences


def test_op6_whole_table(spark, library):
    docs = table(spark, SF, "documents").collect()
    ids = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids + [1] for r in docs}
    rows = llm_queries()["op6_mixture_packing"](spark, SF).collect()
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    sequences = check_pieces(rows, ids)
    assert len(sequences) == -(-sum(map(len, ids.values())) // 2048)


def test_op6_on_odd_rows(odd_docs, no_docs):
    rows = mixture_pack(odd_docs.where("doc_id is not null and doc_id <> 2"), PATH, sequence=64, window_sequences=2).collect()
    ids = {r.doc_id: np.frombuffer(bpe.encoder(PATH).encode([r.text or ""])[0], "<u4").tolist() + [1] for r in odd_docs.where("doc_id is not null and doc_id <> 2").collect()}
    check_pieces(rows, ids)
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == ids[r.doc_id][r.start : r.start + r.length]
    assert sum(r.length for r in mixture_pack(odd_docs, PATH).collect()) == sum(r.n_tokens + 1 for r in token_counts(odd_docs, PATH).collect())
    assert mixture_pack(no_docs, PATH).count() == 0


@pytest.mark.parametrize(("totals", "weights", "window"), [([1000, 10, 3], None, 64), ([500, 500], [3, 1], 50), ([0, 7, 90], [1, 1, 0], 8), ([5], None, 100)])
def test_schedule_is_deficit_round_robin(totals, weights, window):
    s = Schedule(totals, weights, window)
    w = weights or totals
    assert all(s.served(q, 0) == 0 and s.served(q, s.windows) == n for q, n in enumerate(totals))
    credit, left = [0.0] * len(totals), list(totals)
    for n in range(s.windows):
        for q in range(len(totals)):
            assert s.served(q, n + 1) >= s.served(q, n)
        if weights is None:  # plain simulation: quantum, serve the whole credit, keep the fraction
            for q in range(len(totals)):
                credit[q] += window * w[q] / sum(w)
                take = min(left[q], int(credit[q] + 1e-9))
                credit[q] -= take
                left[q] -= take
                if n + 1 < s.windows:
                    assert totals[q] - left[q] == s.served(q, n + 1)
    places = sorted(p for q, n in enumerate(totals) for a, b, k in s.places(q, 0, n) for p in range(b, b + k))
    assert places == list(range(sum(totals)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=40))
def test_best_fit_decreasing(lengths):
    bins: list[list[int]] = []
    for piece in sorted(range(len(lengths)), key=lambda p: -lengths[p]):
        fits = [b for b in bins if sum(lengths[p] for p in b) + lengths[piece] <= 32]
        if fits:
            max(fits, key=lambda b: sum(lengths[p] for p in b)).append(piece)
        else:
            bins.append([piece])
    got = best_fit_decreasing(lengths, 32)
    assert sorted(sum(lengths[p] for p in b) for b in got) == sorted(sum(lengths[p] for p in b) for b in bins)


def test_op1_is_lossless(spark, odd_docs, no_docs):
    docs = odd_docs.where("doc_id is not null and doc_id <> 2")
    got = defaultdict(dict)
    for r in pack_token_ids(docs, PATH, sequence=64, positions=True).collect():
        ids, positions = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.position_ids, "<u4")
        assert len(ids) == 64 and r.cu_seqlens[-1] == r.n_tokens <= 64 and r.position_resets == r.cu_seqlens[:-1]
        for a, b, first, doc in zip(r.cu_seqlens, r.cu_seqlens[1:], r.first_positions, r.segment_ids):
            got[doc][first] = ids[a:b].tolist()
            assert positions[a:b].tolist() == list(range(first, first + b - a))
    for r in docs.collect():
        want = np.frombuffer(bpe.encoder(PATH).encode([r.text or ""])[0], "<u4").tolist() + [50256]
        assert sum((v for _, v in sorted(got[r.doc_id].items())), []) == want
    assert pack_token_ids(no_docs, PATH).count() == 0
    rows = llm_queries()["op1_token_output"](spark, SF).collect()
    assert sum(r.n_tokens for r in rows) == sum(r.n_tokens + 1 for r in llm_queries()["op4_token_counts"](spark, SF).collect())


def test_op9_samples_by_weight_and_decodes(spark, odd_docs, no_docs):
    model = vocabulary_path("piece_bpe_32k.model")
    p = pieces(model, 2e-4)

    def ways(word):
        if not word:
            yield (), 1.0
        for j in range(1, len(word) + 1):
            if word[:j] in p.weights:
                i, w = p.weights[word[:j]]
                for rest, x in ways(word[j:]):
                    yield (i, *rest), w * x

    want = dict(ways("▁other"))
    n = 40_000
    counts = defaultdict(int)
    for x in p.sample(["other"] * n, np.arange(n, dtype=np.uint64) * np.uint64(7919)):
        counts[tuple(x.tolist())] += 1
    total = sum(want.values())
    assert set(counts) <= set(want)
    assert all(abs(counts[k] - n * v / total) < 6 * (n * v / total) ** 0.5 + 3 for k, v in want.items())
    one = {(r.doc_id, bytes(r.ids)) for r in sample_pieces(odd_docs, model).where("ids is not null").collect()}
    assert one == {(r.doc_id, bytes(r.ids)) for r in sample_pieces(odd_docs.repartition(5, "text"), model).where("ids is not null").collect()}
    decoded = decode_pieces(sample_pieces(odd_docs, model), model).collect()
    assert [(r.doc_id, r.text) for r in decoded] == [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert sample_pieces(no_docs, model).count() == 0
    assert llm_queries()["op9_piece_sampling"](spark, SF).where("not lossless").count() == 0
