"""Suffix arrays by the difference cover of 3: sort sampled triples, recurse on their names, merge the other suffixes."""

from __future__ import annotations

import numpy as np


def _names(*columns: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense ranks of rows, and how many differ. Columns hold non-negative integers."""
    key, span = columns[0].astype(np.uint64), int(columns[0].max(initial=0)) + 1
    for column in columns[1:]:
        size = int(column.max(initial=0)) + 1
        if span * size >= 1 << 63:  # too wide to join: rank what there is first
            found, key = np.unique(key, return_inverse=True)
            key, span = key.astype(np.uint64), len(found)
        key = key * np.uint64(size) + column.astype(np.uint64)
        span *= size
    found, inverse = np.unique(key, return_inverse=True)
    return inverse.astype(np.int64), len(found)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes of ``s`` (non-negative integers) in sorted order."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.zeros(n + 4, np.int64)
    t[:n] = s + 1  # zeros end it
    # sampled: all positions that are 1 or 2 modulo 3; a position n that is 1 modulo 3 parts the two halves
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    names, distinct = _names(t[sample], t[sample + 1], t[sample + 2])
    order = np.argsort(names, kind="stable") if distinct == len(sample) else suffix_array(names)
    rank = np.zeros(n + 4, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sampled = sample[order]
    sampled = sampled[sampled < n]
    zeros = np.arange(0, n, 3)
    width = np.int64(len(sample) + 2)
    after_one = lambda at: t[at] * width + rank[at + 1]
    zeros = zeros[np.argsort(after_one(zeros), kind="stable")]
    # a 0-suffix meets a 1-suffix by (letter, rank after), a 2-suffix by (letter, letter, rank after two)
    one, two = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    both = np.concatenate([zeros, two])
    pair, _ = _names(t[both], t[both + 1], rank[both + 2])
    place = np.arange(len(zeros)) + np.searchsorted(after_one(one), after_one(zeros)) + np.searchsorted(pair[len(zeros) :], pair[: len(zeros)])
    out = np.empty(n, np.int64)
    free = np.ones(n, bool)
    out[place], free[place] = zeros, False
    out[free] = sampled
    return out


def repeated_windows(texts: list[bytes], size: int) -> list[np.ndarray]:
    """For each text, which starts 0..len-size begin a string of ``size`` bytes that begins at another start in any of the texts.

    Texts are joined, each with an end of its own, so that no match crosses from one into the next.
    """
    counts = [max(0, len(x) - size + 1) for x in texts]
    if not sum(counts):
        return [np.zeros(c, bool) for c in counts]
    lengths = np.array([len(x) + 1 for x in texts])
    ends = np.cumsum(lengths)
    s = np.zeros(int(ends[-1]), np.int64)
    body = np.ones(len(s), bool)
    body[ends - 1] = False
    data = np.frombuffer(b"".join(texts), np.uint8)
    s[body] = data.astype(np.int64) + len(texts)
    s[ends - 1] = np.arange(len(texts))
    full = np.zeros(len(s), bool)
    starts = ends - lengths
    for at, c in zip(starts.tolist(), counts, strict=True):
        full[at : at + c] = True
    order = suffix_array(s)
    order = order[full[order]]  # adjacent among the suffixes that are long enough
    flat = np.zeros(len(s) + 8, np.uint8)
    flat[: len(s)][body] = data
    words = np.ndarray((len(s) + 1,), "<u8", flat, strides=(1,))
    same = np.arange(len(order) - 1)  # pairs of neighbours whose prefixes agree so far
    for at in [*range(0, size - 7, 8), *([size - 8] if size % 8 else [])] if size >= 8 else []:
        same = same[words[order[same] + at] == words[order[same + 1] + at]]
    if size < 8:
        for at in range(size):
            same = same[flat[order[same] + at] == flat[order[same + 1] + at]]
    hit = np.zeros(len(s), bool)
    hit[order[same]] = True
    hit[order[same + 1]] = True
    return [hit[at : at + c] for at, c in zip(starts.tolist(), counts, strict=True)]
