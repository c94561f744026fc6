"""Byte-level BPE over a public vocabulary file: exact ids, and exact token counts at every prefix.

A text is cut into pre-tokens by the vocabulary's pattern; each pre-token is encoded once per Python worker and kept.
``PrefixCounts`` stores, for each pre-token, the exact token count of each of its prefixes. It rests on two facts about
BPE: dropping the last token of an encoding leaves the encoding of the shorter text, and a token sequence is an encoding
when every adjacent pair is (is left alone by the merges). So the last token at each prefix end follows from the last
tokens at earlier ends, and counts follow by adding one.
"""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import accumulate

import regex

#: Fixed values of the byte-level vocabulary: its pre-token pattern and its one special string.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = "<|endoftext|>"
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")

#: Most pre-tokens kept by one worker; at this many the cache starts afresh (results do not depend on it).
CACHE_ENTRIES = 600_000

NO_RANK = 1 << 60

find_pretokens = regex.compile(PATTERN).findall


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes: printable Latin-1 stands for itself, the rest are dealt from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + n): b for n, b in enumerate(rest)}


class Vocabulary:
    """Token bytes, merge ranks and ids of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        letters = byte_alphabet()
        as_bytes = lambda token: bytes(map(letters.__getitem__, token))
        self.special_id = next(t["id"] for t in model["added_tokens"] if t["content"] == SPECIAL)
        self.ids = {as_bytes(token): n for token, n in model["model"]["vocab"].items() if token != SPECIAL}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"])
        self.ranks = {(as_bytes(a), as_bytes(b)): n for n, (a, b) in enumerate(pairs)}
        self.starts = {token[:k] for token in self.ids for k in range(1, len(token) + 1)}

    def merge(self, word: bytes) -> list[bytes]:
        """Plain BPE of one short byte string, by repeated merging of the best pair."""
        parts, ranks = [word[i : i + 1] for i in range(len(word))], self.ranks
        while len(parts) > 1:
            found = [ranks.get(pair, NO_RANK) for pair in zip(parts, parts[1:])]
            lowest = min(found)
            if lowest == NO_RANK:
                break
            i = found.index(lowest)  # equal pairs further right follow one by one, in the same order
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class PrefixCounts(dict):
    """pre-token -> exact token count at the end of each of its character prefixes (the first entry is 0)."""

    def __init__(self, path: str):
        super().__init__()
        self.vocab = vocabulary(path)
        self.pairs: dict[tuple[bytes | None, bytes], bool] = {}

    def __missing__(self, pretoken: str):
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        if len(self.pairs) >= 2 * CACHE_ENTRIES:
            self.pairs.clear()
        counts = self._run(pretoken)
        if len(pretoken) == 3 and pretoken in CONTRACTIONS:  # shorter, its apostrophe and letter are two pre-tokens
            counts = (0, 1, 2, counts[3])
        self[pretoken] = counts
        return counts

    def _fits(self, left: bytes | None, right: bytes) -> bool:
        if left is None:
            return True
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            known = self.pairs[key] = self.vocab.merge(left + right) == [left, right]
        return known

    def _run(self, pretoken: str):
        data = pretoken.encode("utf-8", "replace")
        ids, starts, size = self.vocab.ids, self.vocab.starts, len(data)
        last: list[bytes | None] = [None] * (size + 1)
        count = [0] * (size + 1)
        for i in range(size):
            before, after = last[i], count[i] + 1
            for j in range(i + 1, size + 1):
                piece = data[i:j]
                if piece not in starts:
                    break
                if last[j] is None and piece in ids and self._fits(before, piece):
                    last[j], count[j] = piece, after
        ends = accumulate((len(c.encode("utf-8", "replace")) for c in pretoken), initial=0)
        kept = [count[e] for e in ends]
        return bytes(kept) if kept[-1] < 200 and max(kept) < 256 else tuple(kept)

    def count(self, text: str) -> int:
        """Tokens of the whole text, as the library counts them."""
        parts = text.split(SPECIAL) if SPECIAL in text else (text,)
        return sum(self[p][-1] for part in parts for p in find_pretokens(part)) + len(parts) - 1

    def table(self, text: str) -> list[int]:
        """Exact token count of ``text[:i]`` for every i from 0 to ``len(text)``."""
        done, out = 0, [0]
        parts = text.split(SPECIAL)
        for n, part in enumerate(parts):
            if n + 1 == len(parts):
                out += self._segment(part, done)
            else:
                # inside the special string its beginning is ordinary text; with its last character it is one token
                out += self._segment(part + SPECIAL[:-1], done)
                done += sum(self[p][-1] for p in find_pretokens(part)) + 1
                out.append(done)
        return out

    def _segment(self, text: str, done: int) -> list[int]:
        out: list[int] = []
        at, blank_from, blank_done = 0, 0, done  # the white-space run that ends at `at`, and the count before it
        for p in find_pretokens(text):
            counts = self[p]
            for k in range(1, len(p) + 1):
                if p[k - 1].isspace() and p[k - 1] not in "\x1c\x1d\x1e\x1f":  # white space at a prefix's end is one pre-token
                    if at + k - 1 == blank_from:
                        blank_done = done
                    out.append(blank_done + self[text[blank_from : at + k]][-1])
                else:
                    out.append(done + counts[k])
                    blank_from = at + k
            done += counts[-1]
            at += len(p)
            if blank_from == at:
                blank_done = done
        return out

    def within(self, text: str, limit: int) -> int:
        """Characters of the longest prefix of ``text`` with at most ``limit`` tokens."""
        return max(i for i, n in enumerate(self.table(text)) if n <= limit)


@lru_cache(maxsize=2)
def prefix_counts(path: str) -> PrefixCounts:
    """One store per Python worker and vocabulary; it lives on from task to task."""
    return PrefixCounts(path)


class Encoder:
    """Ids of whole texts, as the library for the vocabulary file gives them, without begin, end or added special tokens.

    The merges are run by tiktoken's engine, loaded with this file's own tokens: it gives the same ids several times faster.
    That holds where ids follow the merges' order, which is checked; the tests compare with the tokenizers library.
    """

    def __init__(self, path: str):
        import tiktoken

        vocab = Vocabulary(path)  # not kept: the engine has what it needs
        order = [vocab.ids[a + b] for a, b in vocab.ranks]
        if any(x >= y for x, y in zip(order, order[1:], strict=False)):
            raise ValueError("ids of this vocabulary do not follow its merges")
        self.engine = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=vocab.ids, special_tokens={SPECIAL: vocab.special_id})
        self.special = vocab.special_id.to_bytes(4, "little")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; a special string inside is its own id."""
        return [self.engine.encode_to_numpy(t, allowed_special="all", disallowed_special=()).astype("<u4", copy=False).tobytes() for t in texts]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
