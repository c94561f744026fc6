"""Toxicity: a subword-bag classifier over short windows of words; a text is as toxic as its worst window.

Labels are of whole texts while a few words make a text toxic, so training alternates: windows of texts labelled toxic count as
toxic at first, then only those that the model so far scores highest in their text. A last logistic fit on texts kept apart
turns the worst window's score into a probability.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import chosen_rows, portions, sampled_texts, tidy
from .subword import BUCKET_BITS, PORTION, Bags, SubwordModel, WordScores, find_words, iter_words, sigmoid

WINDOW = 5
#: Bounds on the labelled sample a model is fitted on: texts of either label, and bytes of all.
SAMPLE_TEXTS, SAMPLE_BYTES = 3000, 1 << 24
#: Windows of either kind that a turn of training draws at random, and (expected) those of one toxic text among them.
TURN, OF_TEXT = 20_000, 12
#: Bytes of texts that a task works on at a time, if not a single text has more.
SLICE = 1 << 18


@dataclass
class ToxicityModel:
    table: np.ndarray
    bias: float
    slope: float
    offset: float
    empty: float

    def worst(self, scores: np.ndarray) -> float:
        """Highest window score of a text's word scores (shape: words, 1)."""
        s = scores[:, 0].astype(np.float64)
        if len(s) <= WINDOW:
            return float(s.sum()) / max(len(s), WINDOW // 2)
        sums = np.concatenate([[0], np.cumsum(s)])
        return float((sums[WINDOW:] - sums[:-WINDOW]).max()) / WINDOW

    def worst_of_long(self, words: WordScores, text: str) -> tuple[float, int]:
        """(the same of a long text, number of its words), some words at a time."""
        tail, best, n = np.zeros(0), -np.inf, 0
        for some in word_chunks(text):
            at = words.indices(some)
            s = np.concatenate([tail, words.scores[at, 0]])
            n += len(some)
            best = max(best, self.worst(s[:, None])) if len(s) >= WINDOW else best
            tail = s[1 - WINDOW :]
        return (best if n >= WINDOW else self.worst(tail[:, None])), n

    def probability(self, worst: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * worst + self.offset)


def words_of(text: str | None) -> list[str]:
    """Lower-case words in order; of a word that is said again and again at once, one is left."""
    words = find_words((text or "").lower())
    return [w for w, before in zip(words, [None, *words], strict=False) if w != before]


def word_chunks(text: str) -> Iterator[list[str]]:
    """The same words, some thousands at a time."""
    found, last = (m[0] for m in iter_words(text.lower())), None
    while some := list(islice(found, PORTION)):
        yield [w for w, before in zip(some, [last, *some], strict=False) if w != before]
        last = some[-1]


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3; a null id is never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[list[tuple[str, int]], float]:
    """(text, label) rows that are not held out: of either label at most SAMPLE_TEXTS, chosen by hash of the id, and SAMPLE_BYTES bytes
    of all, whole texts of any length; and the share of toxic ones among all labelled rows that are not held out."""
    known = labels.where(F.col(label_col).isin(0, 1) & ~held_out(id_col)).select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y"))
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = chosen_rows(known, "labelled", 11, SAMPLE_TEXTS, 2 * SAMPLE_TEXTS)
    return sampled_texts(docs, chosen, id_col, text_col, 2 * SAMPLE_TEXTS, SAMPLE_BYTES), counts.get(1, 0) / max(1, sum(counts.values()))


def fit(sample: list[tuple[str, int]], toxic_share: float | None = None, seed: int = 3) -> ToxicityModel:
    """A model from (text, label) rows. ``toxic_share``: of all labelled texts, where the sample has another one."""
    once: dict[str, str] = {}
    texts = [[once.setdefault(w, w) for w in words_of(t)] for t, _ in sample]
    y = np.array([label for _, label in sample], np.int64)
    if len(set(y.tolist())) < 2:  # nothing to tell apart
        base = float(y.mean()) if len(y) else 0.0
        return ToxicityModel(np.zeros((1 << BUCKET_BITS, 1), np.float32), 0.0, 0.0, -40.0 if base == 0 else 40.0, base)
    part = np.random.default_rng(seed).random(len(texts)) < 0.25  # kept apart for the last fit
    owner = array("i")

    def windows() -> Iterator[list[str]]:
        for n, words in enumerate(texts):
            for at in range(0, max(1, len(words) - WINDOW // 2), WINDOW // 2) if words and not part[n] else ():
                owner.append(n)
                yield words[at : at + WINDOW]

    data = Bags(windows())
    owner = np.array(owner, np.int64)
    labels = y[owner]
    model = SubwordModel(2, seed)
    rng = np.random.default_rng(seed + 1)
    clean, toxic = np.flatnonzero(labels == 0), np.flatnonzero(labels == 1)
    chosen = toxic
    for turn in range(4):
        model.fit(data, labels, np.concatenate([rng.permutation(chosen)[:TURN], rng.permutation(clean)[:TURN]]), epochs=2 if turn else 1, seed=seed + turn)
        table = model.table()[:, 1:] - model.table()[:, :1]
        words = np.add.reduceat(table[data.grams, 0], data.starts) / data.counts
        score = np.add.reduceat(words[data.flat], data.ends[:-1]) / WINDOW
        # of each toxic text the windows near its best one
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, owner, score)
        chosen = toxic[score[toxic] >= best[owner[toxic]] - 0.25 * np.abs(best[owner[toxic]])]
        spread = np.bincount(owner[chosen], minlength=len(texts))
        chosen = chosen[rng.random(len(chosen)) * spread[owner[chosen]] < OF_TEXT]
    result = ToxicityModel(table.astype(np.float32), float(model.bias[1] - model.bias[0]), 1.0, 0.0, 0.0)
    scores = WordScores(result.table)
    worst = np.array([result.worst(r) for r in scores.rows(texts)])
    use = part if 0 < y[part].sum() < part.sum() else np.ones(len(texts), bool)  # too few texts: all of them
    rows = np.where(y == 1, (toxic_share or y.mean()) / y.mean(), (1 - (toxic_share or y.mean())) / (1 - y.mean()))
    result.slope, result.offset = platt(worst[use], y[use], rows[use])
    return result


def platt(x: np.ndarray, y: np.ndarray, rows: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit with row weights, by Newton's method with a small ridge."""
    scale = x.std() or 1.0
    z, w = np.stack([x / scale, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(50):
        p = sigmoid(z @ w)
        h = (z * (rows * p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        w -= np.linalg.solve(h, z.T @ (rows * (p - y)) + 1e-3 * w)
    return float(w[0] / scale), float(w[1])


def score_toxicity(df: DataFrame, model: ToxicityModel, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, score (0 to 1), predicted (1 if score >= threshold), n_words.

    Only the text decides. Null and wordless texts are scored as the empty bag. Repeated rows score alike; an empty table gives
    no rows; other columns are not read. Whole texts count: every window of WINDOW words in steps of one.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordScores(model.table)
        for batch in batches:
            for some in portions(batch, 1, SLICE):
                texts = some.column(1).to_pylist()
                if len(texts) == 1 and len(texts[0] or "") > SLICE:
                    found = [model.worst_of_long(words, texts[0])]
                else:
                    texts = [words_of(t) for t in texts]
                    found = [(model.worst(r), len(r)) for r in words.rows(texts)]
                score = model.probability(np.array([worst for worst, _ in found]))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array([n for _, n in found], pa.int64())],
                    names=[id_col, "score", "predicted", "n_words"],
                )

    return df.select(id_col, text_col).mapInArrow(tidy(run), f"`{id_col}` {kind}, score double, predicted int, n_words long")
