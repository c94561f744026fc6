"""Words of any length count whole."""

import numpy as np
import pytest

from tidewright.llm import language_id, subword, toxicity
from tidewright.llm.subword import WordScores, ngrams


@pytest.mark.parametrize("length", [199, 300, 40_000, 700_000])
def test_every_ngram_of_a_word_counts(length):
    rng = np.random.default_rng(length)
    word = "".join(chr(c) for c in rng.integers(0x4E00, 0x9000, length // 3)) + "tail"
    table = rng.normal(size=(1 << subword.BUCKET_BITS, 2)).astype(np.float32)
    size = len(word.encode()) + 2
    grams, counts = ngrams([word])
    assert counts.tolist() == [sum(size - n + 1 for n in subword.SIZES)]
    (got,) = WordScores(table).rows([["short", word, "other"]])
    assert np.allclose(got[1], table[grams].astype(np.float64).mean(axis=0), atol=1e-5)
    alone = WordScores(table).rows([["short"], ["other"]])
    assert np.allclose(got[0], alone[0][0]) and np.allclose(got[2], alone[1][0])


def test_language_after_byte_200(spark):
    english, german = "the cat sat on this mat with another thing that they think", "der hund und die katze sitzen nicht auf dem schrank sondern zwischen"
    rng = np.random.default_rng(1)
    texts = [(" ".join(rng.permutation(w.split())), lang) for _ in range(200) for w, lang in ((english, "en"), (german, "de"))]
    model = language_id.fit(texts)
    start = "xq" * 110
    rows = [(1, start + english.replace(" ", "") * 30), (2, start + german.replace(" ", "") * 30)]
    got = {r.doc_id: r.lang_pred for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got == {1: "en", 2: "de"}


def test_toxic_after_byte_200(spark):
    clean = "the of and tion ing was are fine".split()
    rng = np.random.default_rng(2)
    texts = [(" ".join(rng.choice(clean, 30)) + (" you stupid idiot moron" if n % 4 == 0 else ""), int(n % 4 == 0)) for n in range(400)]
    model = toxicity.fit(texts)
    start = "theofandtioningwasare" * 12
    rows = [(1, start + "stupididiotmoron" * 40), (2, start + "fineingandwasare" * 40)]
    a, b = (r.score for r in toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), model).orderBy("doc_id").collect())
    assert a > b
