"""Language identification: averaged hashed subword vectors under a linear softmax, with calibrated rejection.

Softmax probabilities are calibrated by one temperature, fitted on texts kept apart; the rejection threshold is the least score at
which accepted texts of that part reach the wanted accuracy, but never below one half, nor so high (above one half) that it
rejects more than a share REJECTED of that part's correct texts: a few wrong labels don't empty a corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import chosen_rows, portions, sampled_texts, tidy
from .subword import Bags, SubwordModel, WordScores, find_letter_words, letter_words
from .toxicity import held_out

#: Bounds on the sample a model is fitted on: texts of each language, texts and bytes of all; and words in a training bag.
SAMPLE_TEXTS, SAMPLE_ROWS, SAMPLE_BYTES, BAG = 400, 20_000, 1 << 24, 24
#: Steps of gradient descent (of 128 bags) at least, however small the sample.
LEAST_STEPS = 600
#: Bytes of texts that a task works on at a time, if not a single text has more.
SLICE = 1 << 18
UNKNOWN = "und"
#: Most of the correct texts kept apart that the threshold may reject.
REJECTED = 0.05


@dataclass
class LanguageModel:
    """``table`` has at most DIM entries for each n-gram bucket, so a model's size is bounded (8 MB) whatever the number of languages."""

    names: list[str]
    table: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, means: np.ndarray) -> np.ndarray:
        return means @ self.weights + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        p = np.exp(z - z.max(axis=-1, keepdims=True))
        return p / p.sum(axis=-1, keepdims=True)

    def judge(self, words: WordScores, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, its calibrated probability, whether rejected) of whole texts."""
        lower = [(t or "").lower() for t in texts]
        means, counts = words.means([(m[0] for m in letter_words(t)) if len(t) > SLICE else iter(find_letter_words(t)) for t in lower])
        # numerals such as Roman ones are no letters
        known = np.array([n > 0 and any(any(map(str.isalpha, m[0])) for m in letter_words(t)) for n, t in zip(counts.tolist(), lower, strict=True)], bool)
        if not self.names:
            known[:] = False
        p = self.probabilities(self.logits(means)) if self.names else np.zeros((len(texts), 1))
        best = p.argmax(axis=1)
        score = np.where(known, p[np.arange(len(texts)), best], 0.0)
        lang = [self.names[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]
        return lang, score, ~known | (score < self.threshold)


def labelled_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """(text, language) rows that are not held out: of each language at most SAMPLE_TEXTS, chosen by hash of the id; of all at most
    SAMPLE_ROWS rows and SAMPLE_BYTES bytes. Whole texts of any length."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    chosen = chosen_rows(known.select(F.col(id_col).alias("i"), F.col(lang_col).alias("y")), "languages", 13, SAMPLE_TEXTS, SAMPLE_ROWS)
    return sampled_texts(docs, chosen, id_col, text_col, SAMPLE_ROWS, SAMPLE_BYTES, also=F.col(lang_col))


def fit(sample: list[tuple[str, str]], accuracy: float = 0.99, seed: int = 5) -> LanguageModel:
    names = sorted({lang for _, lang in sample})
    texts = [find_letter_words(t.lower()) for t, _ in sample]
    y = np.array([names.index(lang) for _, lang in sample], np.int64)
    apart = np.random.default_rng(seed).random(len(texts)) < 0.25
    bags, labels = [], []
    for n, words in enumerate(texts):
        if not apart[n]:
            for at in range(0, len(words), BAG):
                bags.append(words[at : at + BAG])
                labels.append(y[n])
    model = SubwordModel(max(1, len(names)), seed)
    if bags:
        model.fit(Bags(bags), np.array(labels), np.arange(len(labels)), epochs=max(3, -(-LEAST_STEPS * 128 // len(bags))), batch=128, seed=seed)
    table, weights = model.narrow()
    result = LanguageModel(names, table.astype(np.float32), weights, model.bias.astype(np.float64), 1.0, 0.5)
    scores = WordScores(result.table)
    use = [n for n in np.flatnonzero(apart) if texts[n]]
    if use and len(names) > 1:
        logits = result.logits(scores.means([iter(texts[n]) for n in use])[0])
        truth = y[use]

        def loss(temperature: float) -> float:
            result.temperature = temperature
            return float(-np.log(result.probabilities(logits)[np.arange(len(use)), truth] + 1e-12).mean())

        result.temperature = min(np.geomspace(0.05, 20, 60), key=loss)
        p = result.probabilities(logits)
        order = np.argsort(-p.max(axis=1))
        correct = p.argmax(axis=1) == truth
        right = np.cumsum(correct[order]) / np.arange(1, len(use) + 1)
        good = np.flatnonzero(right >= accuracy)
        lowest = float(p.max(axis=1)[order][good[-1]]) if len(good) else 1.0
        if correct.any():
            sure = np.sort(p.max(axis=1)[correct])
            lowest = min(lowest, float(sure[int(REJECTED * len(sure))]))
        result.threshold = 0.5 if len(good) and good[-1] + 1 == len(use) else max(0.5, lowest)
    return result


def identify(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, lang_pred, score (calibrated, 0 to 1), rejected.

    ``und`` with score 0 where the text is null or holds no letter, or where no language was learned; such rows are rejected, as are
    those that score below the model's threshold. Whole texts count. Repeated rows score alike; an empty table gives no rows.
    Other columns are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordScores(model.table)
        for batch in batches:
            for some in portions(batch, 1, SLICE):
                lang, score, rejected = model.judge(words, some.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                    names=[id_col, "lang_pred", "score", "rejected"],
                )

    return df.select(id_col, text_col).mapInArrow(tidy(run), f"`{id_col}` {kind}, lang_pred string, score double, rejected boolean")


def keep_identified(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, whose text is not rejected; narrow, so nothing is shuffled or joined by id."""
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, column = WordScores(model.table), schema.names.index(text_col)
        for batch in batches:
            rejected = [model.judge(words, some.column(column).to_pylist())[2] for some in portions(batch, column, SLICE)]
            yield batch.filter(pa.array(~np.concatenate([np.zeros(0, bool), *rejected])))

    return df.mapInArrow(tidy(run), schema)
