"""Subword-bag classifiers in numpy: hashed character n-gram vectors, averaged, under a linear softmax, trained together.

A word's vector is the mean of the vectors of its byte n-grams (with the word's ends marked), so an unseen spelling shares most of
them with the words it resembles. A bag's vector is the mean of its words' vectors. Because all of that is linear, a trained model is
applied as one table of class scores by n-gram bucket.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np

from .suffix_dedup import Hasher

BUCKET_BITS, DIM, SIZES = 18, 8, (3, 4, 5, 6)
#: Most words whose scores a worker keeps, and characters of them; then it starts afresh.
CACHE_WORDS, CACHE_CHARS = 300_000, 8_000_000
#: Characters of words whose n-grams are held at a time, and bytes of one part of a longer word.
BATCH_CHARS, PART = 1 << 19, 1 << 14
#: Words of a text that are looked up at a time.
PORTION = 50_000

find_words = re.compile(r"[^\W_]+").findall
iter_words = re.compile(r"[^\W_]+").finditer
find_letter_words = re.compile(r"[^\W\d_]+").findall
letter_words = re.compile(r"[^\W\d_]+").finditer


def ngrams(words: list[str], hasher: Hasher | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all n-grams of all words in order, number for each word); a word's ends are part of it."""
    parts = [b"\x01" + w.encode("utf-8", "replace") + b"\x02" for w in words]
    data = np.frombuffer(b"".join(parts), np.uint8)
    lengths = np.array([len(p) for p in parts])
    hasher = hasher or Hasher(len(data), 9)
    sums = hasher.sums(data)
    ends = np.cumsum(lengths)
    left = np.repeat(ends, lengths) - np.arange(len(data))  # bytes from here to the word's end
    owner = np.repeat(np.arange(len(parts)), lengths)
    found, owners = [], []
    for n in SIZES:
        at = np.flatnonzero(left >= n)
        found.append((hasher.of(sums, at, at + n) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
        owners.append(owner[at])
    owners, found = np.concatenate(owners), np.concatenate(found)
    order = np.argsort(owners, kind="stable")
    return found[order], np.bincount(owners, minlength=len(parts))


def batches(words: list[str], most: int) -> Iterator[list[str]]:
    """Words in order, at most ``most`` and some BATCH_CHARS characters at a time; a longer word comes alone."""
    start, chars = 0, 0
    for n, w in enumerate(words):
        if n > start and (n - start >= most or chars + len(w) > BATCH_CHARS):
            yield words[start:n]
            start, chars = n, 0
        chars += len(w)
    if words:
        yield words[start:]


def means(words: list[str], table: np.ndarray) -> np.ndarray:
    """Mean row of ``table`` over the n-grams of each word."""
    if len(words) == 1 and len(words[0]) > PART:
        return long_mean(words[0], table)[None]
    grams, counts = ngrams(words)
    return np.add.reduceat(table[grams], np.cumsum(counts) - counts, axis=0) / counts[:, None]


def long_mean(word: str, table: np.ndarray) -> np.ndarray:
    """The same of one long word, summed over parts: an n-gram counts in the part where it begins, so parts overlap."""
    data = np.frombuffer(b"\x01" + word.encode("utf-8", "replace") + b"\x02", np.uint8)
    hasher = Hasher(PART + max(SIZES), 9)
    total, count = np.zeros(table.shape[1]), 0
    for start in range(0, len(data), PART):
        part = data[start : start + PART + max(SIZES) - 1]
        sums = hasher.sums(part)
        for n in SIZES:
            at = np.arange(max(0, min(PART, len(part) - n + 1)))
            total += table[(hasher.of(sums, at, at + n) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)].sum(axis=0, dtype=np.float64)
            count += len(at)
    return total / count


class Bags:
    """Training bags over one vocabulary of words, as flat arrays: a driver holds hundreds of thousands of them."""

    def __init__(self, bags: Iterable[list[str]]):
        index: dict[str, int] = {}
        flat, ends = array("i"), array("q", [0])
        for bag in bags:
            flat.extend([index.setdefault(w, len(index)) for w in bag])
            ends.append(len(flat))
        self.flat, self.ends = np.array(flat, np.int32), np.array(ends, np.int64)
        words = list(index)
        parts = [ngrams(some) for some in batches(words, 20_000)]
        self.grams = np.concatenate([np.zeros(0, np.int32), *(g.astype(np.int32) for g, _ in parts)])
        self.counts = np.concatenate([np.zeros(0, np.int64), *(c for _, c in parts)])
        self.starts = np.cumsum(self.counts) - self.counts

    def __len__(self) -> int:
        return len(self.ends) - 1

    def words(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words of the bags in order, length of each)."""
        lengths = self.ends[which + 1] - self.ends[which]
        at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(self.ends[which], lengths)
        return self.flat[at], lengths


class SubwordModel:
    def __init__(self, classes: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.vectors = rng.uniform(-0.5, 0.5, (1 << BUCKET_BITS, DIM)).astype(np.float32) / DIM
        self.weights = rng.normal(0, 0.3, (DIM, classes)).astype(np.float32)
        self.bias = np.zeros(classes, np.float32)
        self._g = (np.full(1 << BUCKET_BITS, 1e-6, np.float32), np.full_like(self.weights, 1e-6), np.full_like(self.bias, 1e-6))

    def fit(self, data: Bags, labels: np.ndarray, which: np.ndarray, epochs: int = 3, rate: float = 0.5, batch: int = 128, seed: int = 2) -> None:
        """Stochastic gradient descent with one adaptive rate a row, over the bags numbered ``which``."""
        rng = np.random.default_rng(seed)
        gv, gw, gb = self._g
        for _ in range(epochs):
            order = rng.permutation(which)
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                words, lengths = data.words(some)
                words, inverse = np.unique(words, return_inverse=True)
                owner = np.repeat(np.arange(len(some)), lengths)
                share = np.zeros((len(some), len(words)), np.float32)  # of each word in each bag
                np.add.at(share, (owner, inverse), 1 / lengths[owner].astype(np.float32))
                counts = data.counts[words]
                spread = np.repeat(np.arange(len(words)), counts)
                flat = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(data.starts[words], counts)
                grams = data.grams[flat]
                vectors = np.add.reduceat(self.vectors[grams], np.cumsum(counts) - counts, axis=0) / counts[:, None]
                hidden = share @ vectors
                logits = hidden @ self.weights + self.bias
                p = np.exp(logits - logits.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(some)), labels[some]] -= 1
                p /= len(some)
                to_words = (share.T @ (p @ self.weights.T)) / counts[:, None]
                rows, back = np.unique(grams, return_inverse=True)
                to_rows = np.stack([np.bincount(back, weights=to_words[spread, d], minlength=len(rows)) for d in range(DIM)], axis=1).astype(np.float32)
                gv[rows] += (to_rows**2).mean(axis=1)
                self.vectors[rows] -= rate * to_rows / np.sqrt(gv[rows])[:, None]
                step = hidden.T @ p
                gw += step**2
                self.weights -= rate * 0.2 * step / np.sqrt(gw)
                gb += p.sum(axis=0) ** 2
                self.bias -= rate * 0.2 * p.sum(axis=0) / np.sqrt(gb)

    def narrow(self) -> tuple[np.ndarray, np.ndarray]:
        """(table, weights): their product is the class scores; a row of the table has at most DIM entries, however many classes."""
        if self.weights.shape[1] <= DIM:
            return self.table(), np.eye(self.weights.shape[1], dtype=np.float32)
        return self.vectors, self.weights

    def table(self) -> np.ndarray:
        """Class scores of each bucket: all that applying the model needs, besides the bias."""
        return self.vectors @ self.weights


class WordScores(dict):
    """word -> row of ``scores``; rows are means over the word's n-grams of a table of bucket scores."""

    def __init__(self, table: np.ndarray):
        super().__init__()
        self.table, self.chars, self.used = table, 0, 0
        self.scores = np.empty((1 << 12, table.shape[1]), np.float32)

    def indices(self, words: list[str]) -> np.ndarray:
        """Rows of ``scores`` of the words, in order; they hold until the next call."""
        if len(self) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self.clear()
            self.chars = self.used = 0
        for some in batches(list(set(words).difference(self)), 50_000):
            found = means(some, self.table)
            if self.used + len(some) > len(self.scores):
                wider = np.empty((max(2 * len(self.scores), self.used + len(some)), self.scores.shape[1]), np.float32)
                wider[: self.used] = self.scores[: self.used]
                self.scores = wider
            self.scores[self.used : self.used + len(some)] = found
            self.update(zip(some, range(self.used, self.used + len(some)), strict=True))
            self.used += len(some)
            self.chars += sum(map(len, some))
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def rows(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Scores of the words of each text, in order."""
        at = self.indices([w for words in texts for w in words])
        found = self.scores[at]  # indices() may have moved the scores
        return np.split(found, np.cumsum([len(words) for words in texts])[:-1]) if texts else []

    def means(self, texts: list[Iterator[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(mean row of the words of each text, number of its words); a text is read PORTION words at a time."""
        sums, counts = np.zeros((len(texts), self.scores.shape[1])), np.zeros(len(texts), np.int64)
        held: list[str] = []
        owner: list[int] = []

        def add() -> None:
            at = self.indices(held)
            found = self.scores[at]
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            at = np.array(owner)[first]
            sums[at] += np.add.reduceat(found, first, axis=0, dtype=np.float64)
            counts[at] += np.diff(np.append(first, len(owner)))
            held.clear()
            owner.clear()

        for n, words in enumerate(texts):
            while some := list(islice(words, PORTION)):
                held += some
                owner += [n] * len(some)
                if len(held) >= PORTION:
                    add()
        if held:
            add()
        return sums / np.maximum(counts, 1)[:, None], counts


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
