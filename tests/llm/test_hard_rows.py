"""Null ids, colliding hashes, many copies, very long texts; classifiers against a plain reading; the pipeline against brute force."""

import zlib
from collections import Counter
from pathlib import Path
from urllib.parse import urlparse

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.llm.test_dedup import brute_near, brute_repeats
from tidewright.llm import language_id, storage, subword, toxicity
from tidewright.llm.exact_dedup import exact_groups
from tidewright.llm.mixture_packing import mixture_pack
from tidewright.llm.near_dedup import drop_near_copies, near_groups
from tidewright.llm.piece_sampling import Spelling, pieces
from tidewright.llm.queries import table, vocabulary_path
from tidewright.llm.storage import materialize
from tidewright.llm.suffix_dedup import remove_repeats
from tidewright.llm.token_counts import token_counts
from tidewright.llm.token_output import pack_token_ids

DIGEST = ["doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256) as s"]


def colliding(spark):
    """Two texts of one 32-bit hash."""
    words = spark.range(400_000).select(F.concat(F.repeat(F.lit("some words of a text "), 12), F.hex("id")).alias("t"))
    pairs = words.groupBy(F.hash("t").alias("h")).agg(F.collect_list("t").alias("ts")).where(F.size("ts") > 1)
    return pairs.orderBy("h").first().ts[:2]


def test_rows_of_one_id_and_one_hash(spark):
    a, b = colliding(spark)
    rows = [(None, a), (None, b), (None, "x" * 300), (7, "y" * 150 + "z" * 150), (8, "q" + "y" * 150 + "z" * 150), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in remove_repeats(docs).selectExpr(*DIGEST).collect()), key=repr)
    assert got == brute_repeats([(i, (t or "").encode()) for i, t in rows], 200)
    got = sorted((tuple(r) for r in near_groups(docs, 3, 85).select("doc_id", "n_shingles", "component_id").collect()), key=repr)
    assert got == brute_near(rows, 3, 85)


def test_a_thousand_copies_of_a_row(spark):
    text = " ".join(f"w{n}" for n in range(60))
    rows = [(5, text)] * 1000 + [(None, text)] * 50 + [(6, text + " more"), (9, text.replace("w30", "v30"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = near_groups(docs, 3, 85).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_near(rows, 3, 85)
    assert [r.doc_id for r in drop_near_copies(docs, 3, 85).collect()] == [5]
    assert remove_repeats(docs).where("doc_id = 5 and n_removed <> n_bytes").count() == 0
    assert {r.group_size for r in exact_groups(docs).where("doc_id = 5").collect()} == {1050}


def test_texts_over_a_mebibyte(spark):
    rng = np.random.default_rng(8)
    words = np.array([f"w{n}" for n in range(50_000)])
    long = " ".join(rng.choice(words, 200_000))
    passage = " ".join(rng.choice(words, 80))
    assert len(long) > 1 << 20
    rows = [(1, long[:600_000] + " " + passage + " " + long[600_000:]), (2, passage), (3, long), (5, "short one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in remove_repeats(docs).selectExpr(*DIGEST).collect()), key=repr)
    assert got == brute_repeats([(i, t.encode()) for i, t in rows], 200)
    near = {r.doc_id: r.component_id for r in near_groups(docs, 3, 85).collect()}
    assert near == {1: 1, 3: 1, 2: 2, 5: 5}


def test_identifiers_that_collide_cost_no_result(spark):
    rows = [(1, "a" * 10), (2, "b" * 10), (3, "a" * 10), (4, None), (5, ""), (6, "c" * 5000), (7, "d" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(tuple(r) for r in exact_groups(docs).drop("n_chunks").collect())
    assert sorted(tuple(r) for r in exact_groups(docs, identifier=lambda c: F.lit(1).cast("bigint")).drop("n_chunks").collect()) == want
    assert {r[0]: r[1] for r in want} == {1: 3, 2: 2, 3: 3, 4: 5, 5: 5, 6: 6, 7: 7}


def test_packing_of_null_ids_and_repeats(odd_docs):
    ids = Counter(r.doc_id for r in odd_docs.collect())
    tokens = {k: sum(r.n_tokens + 1 for r in token_counts(odd_docs, vocabulary_path()).collect() if r.doc_id == k) for k in ids}
    packed = Counter()
    for r in mixture_pack(odd_docs, vocabulary_path(), sequence=64, window_sequences=2).collect():
        packed[r.doc_id] += r.length
    assert packed == tokens
    packed.clear()
    for r in pack_token_ids(odd_docs, vocabulary_path(), sequence=64).collect():
        for i, a, b in zip(r.segment_ids, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            packed[i] += b - a
    assert packed == tokens


def plain_means(table, words):
    """Mean over words of the mean over a word's n-grams, one n-gram at a time."""
    rows = []
    for w in words:
        grams, _ = subword.ngrams([w])
        rows.append(np.mean([table[g] for g in grams.tolist()], axis=0))
    return np.mean(rows, axis=0)


def test_op3_scores_by_a_plain_reading(spark):
    docs = table(spark, SF, "documents")
    model = language_id.fit(language_id.labelled_sample(docs))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in language_id.identify(docs, model).limit(40).collect():
        words = subword.find_letter_words((texts[r.doc_id] or "").lower())
        if words:
            z = (plain_means(model.table, words) @ model.weights + model.bias) / model.temperature
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            assert r.lang_pred == model.names[int(p.argmax())] and abs(r.score - p.max()) < 1e-3
        else:
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)


def test_op3_learns_long_texts_and_many_languages(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = [f"l{n:03d}" for n in range(230)]
    rng = np.random.default_rng(1)
    words = {n: ["".join(rng.choice(list(letters), 6)) for _ in range(6)] for n in names}
    rows = [(i, " ".join(rng.choice(words[names[i % 230]], 10)) * (400 if i % 230 == 7 else 1), names[i % 230]) for i in range(230 * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = language_id.labelled_sample(docs)
    assert {lang for _, lang in sample} == set(names) and max(len(t) for t, _ in sample) > 20_000
    model = language_id.fit(sample)
    assert model.table.nbytes <= (1 << subword.BUCKET_BITS) * subword.DIM * 4
    held = {r[0]: r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1}
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs, model).collect()}
    assert sum(got[i] == lang for i, lang in held.items()) / len(held) > 0.9


def test_sample_bounds_hold_and_take_whole_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(n, "word " * (10 + n), "a" if n % 2 else "b") for n in range(300)], "doc_id long, text string, lang string")
    monkeypatch.setattr(language_id, "SAMPLE_TEXTS", 20)
    texts = {"word " * (10 + n) for n in range(300)}
    sample = language_id.labelled_sample(docs)
    assert Counter(lang for _, lang in sample) == {"a": 20, "b": 20} and {t for t, _ in sample} <= texts
    monkeypatch.setattr(language_id, "SAMPLE_BYTES", 10_000)
    small = language_id.labelled_sample(docs)
    assert 0 < sum(len(t) for t, _ in small) <= 10_000 and small == sample[: len(small)]


def test_op2_scores_by_a_plain_reading(spark):
    rng = np.random.default_rng(5)
    clean = "the of and tion ing was are fine".split()
    texts = [(" ".join(rng.choice(clean, 30)) + (" you stupid idiot moron" if n % 4 == 0 else ""), int(n % 4 == 0)) for n in range(300)]
    model = toxicity.fit(texts)
    rows = [(n, t) for n, (t, _) in enumerate(texts[:20])] + [(100, "fine"), (101, ""), (102, None), (103, "fine " * 3 + "idiot idiot idiot stupid"), (104, "fine was " * 60_000 + "stupid idiot " + "and the " * 50_000)]
    for r, (_, t) in zip(toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), model).collect(), rows, strict=True):
        words = toxicity.words_of(t)
        known = {w: plain_means(model.table, [w])[0] for w in set(words)}
        s = [known[w] for w in words]
        worst = max((sum(s[i : i + 5]) / 5 for i in range(len(s) - 4)), default=sum(s) / max(len(s), 2))
        want = float(model.probability(np.array([worst]))[0])
        assert abs(r.score - want) < 1e-3 and r.predicted == int(r.score >= 0.7) and r.n_words == len(words)


def test_op9_long_words_follow_their_weights(spark):
    model = vocabulary_path("piece_bpe_32k.model")
    p, spelled = pieces(model, 2e-4), Spelling(model)
    word = "▁" + "othera" * 5  # long: its lattice is not kept
    logs = np.full(len(word) + 1, -np.inf)
    logs[0] = 0.0
    for j in range(1, len(word) + 1):
        ways = [logs[i] + np.log(p.weights[word[i:j]][1]) for i in range(j) if word[i:j] in p.weights]
        logs[j] = np.logaddexp.reduce(ways)
    last = {word[i:]: np.exp(logs[i] + np.log(p.weights[word[i:]][1]) - logs[-1]) for i in range(len(word)) if word[i:] in p.weights}
    n = 4000
    found = Counter()
    for x in p.sample([word[1:]] * n, np.arange(n, dtype=np.uint64) * np.uint64(7919)):
        assert spelled.decode(x) == word[1:]
        found[bytes(spelled.decoded[int(x[-1])]).decode().replace(" ", "▁")] += 1
    assert set(found) <= set(last) and all(abs(found[k] - n * q) < 6 * (n * q) ** 0.5 + 3 for k, q in last.items())
    assert word not in p.words


@pytest.mark.parametrize("text", ["a" * 40_000, "日本語" * 9000, "= " * 5000 + "\n\n" + "=" * 3000, " " * 2000 + "x1,2.3 7, 8", "▁a ▁▁ é²².5‍", "\U0001f600" * 50])
def test_op9_decodes_what_it_draws(text):
    model = vocabulary_path("piece_bpe_32k.model")
    (ids,) = pieces(model, 2e-4).sample([text], np.array([3], np.uint64))
    assert Spelling(model).decode(ids) == text


def test_op9_caches_start_afresh_with_the_same_draws(monkeypatch):
    from tidewright.llm import piece_sampling

    model = vocabulary_path("piece_bpe_32k.model")
    texts = [f"some words number {n} and more of them x{n * n}" for n in range(300)]
    seeds = np.arange(300, dtype=np.uint64)
    want = [x.tolist() for x in piece_sampling.Pieces(model, 2e-4).sample(texts, seeds)]
    monkeypatch.setattr(piece_sampling, "CACHE_WORDS", 50)
    monkeypatch.setattr(piece_sampling, "PORTION", 97)
    p = piece_sampling.Pieces(model, 2e-4)
    assert [x.tolist() for n in range(300) for x in p.sample(texts[n : n + 1], seeds[n : n + 1])] == want


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Conf:
        get = staticmethod(lambda key, default=None: None)

    class Nothing:
        isDefined = staticmethod(lambda: False)

    class Session:
        conf = Conf
        sparkContext = type("C", (), {"master": "spark://host:7077", "_jsc": type("J", (), {"sc": staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: Nothing)}))})})

    with pytest.raises(ValueError, match="checkpoint.dir"):
        storage.shared_dir(Session)


def test_stage_tables_outlive_errors(spark):
    with pytest.raises(RuntimeError), storage.stage_tables():
        materialize(spark.range(3), "a")
        raise RuntimeError
    alone = materialize(spark.range(3), "b")
    storage.drop_stage_tables()
    assert alone.count() == 3


def test_pipeline_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    model = language_id.fit(language_id.labelled_sample(docs))
    stages = dict(corpus_pipeline.STAGES)
    after = materialize(stages["language_id"](spark, docs, SF), "one", keep=True)
    rejected = {r.doc_id for r in language_id.identify(docs, model).where("rejected").collect()}
    everything = {r.doc_id: r for r in docs.collect()}
    rows = {r.doc_id: r for r in after.collect()}
    assert set(rows) == set(everything) - rejected and all(rows[i] == everything[i] for i in rows)
    after = materialize(stages["exact_dedup"](spark, after, SF), "two", keep=True)
    largest = {}
    for i, r in rows.items():
        largest[r.text or ""] = max(i, largest.get(r.text or "", i))
    rows = {i: rows[i] for i in largest.values()}
    assert {r.doc_id: r for r in after.collect()} == rows
    after = materialize(stages["near_dedup"](spark, after, SF), "three", keep=True)
    kept = {i for i, _, least in brute_near([(i, r.text) for i, r in rows.items()], 5, 80) if i == least}
    rows = {i: rows[i] for i in kept}
    assert {r.doc_id: r for r in after.collect()} == rows
    after = materialize(stages["suffix_dedup"](spark, after, SF), "four", keep=True)
    told = {r[0]: r[2] for r in brute_repeats([(i, (r.text or "").encode()) for i, r in rows.items()], 200)}
    for r in after.collect():
        before = rows[r.doc_id]
        cut = len((before.text or "").encode()) - len((r.text or "").encode())
        assert told[r.doc_id] - 8 * 3 <= cut <= told[r.doc_id] and (r.lang, r.source) == (before.lang, before.source)
        assert r.text == before.text if not told[r.doc_id] else r.n_chars == len(r.text)
    counts = {r.doc_id: r.n_tokens + 1 for r in token_counts(after, vocabulary_path()).collect()}
    packed = Counter()
    for r in stages["packing"](spark, after, SF).collect():
        packed[r.doc_id] += r.length
    assert packed == counts


def test_tables_need_no_checksum_files(spark):
    """Each checksum file costs a command that shares the executor's memory; a page's own checksum is read instead."""
    out = materialize(spark.range(0, 30_000, 1, 3).withColumn("h", F.xxhash64("id")), "numbers")
    made = sorted(Path(urlparse(out.inputFiles()[0]).path).parent.iterdir())
    assert out.count() == 30_000 and out.agg(F.sum("id")).first()[0] == 449_985_000
    assert [p.name[:5] for p in made] == ["_SUCC", *["part-"] * 3]
    data = bytearray(made[1].read_bytes())
    data[len(data) // 2] ^= 1
    made[1].write_bytes(data)
    with pytest.raises(Exception, match="(?i)checksum|crc"):
        out.agg(F.bit_xor("h")).collect()
    storage.drop_materialized(out)
