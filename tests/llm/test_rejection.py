"""The language stage keeps clean documents, whatever a few labels say."""

import numpy as np
import pytest

from tidewright.llm import language_id

WORDS = {"en": "the cat sat on this mat with another thing that they think", "de": "der hund und die katze sitzen nicht auf dem schrank zwischen", "fr": "le chien et la souris sont dans une maison avec leurs enfants"}


def texts(n, seed):
    rng = np.random.default_rng(seed)
    langs = sorted(WORDS)
    return [(" ".join(rng.choice(WORDS[langs[i % 3]].split(), 25)), langs[i % 3]) for i in range(n)]


@pytest.mark.parametrize(("size", "every"), [(130, 20), (600, 25), (600, 12)])
def test_noisy_labels_do_not_reject_clean_documents(spark, size, every):
    noisy = [(t, "fr" if lang == "en" else "en") if n % every == 3 else (t, lang) for n, (t, lang) in enumerate(texts(size, 1))]
    model = language_id.fit(noisy)
    clean = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts(300, 2))], "doc_id long, text string")
    assert language_id.keep_identified(clean, model).count() > 0.85 * 300
