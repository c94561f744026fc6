"""SentencePiece encoding by sampling, and lossless decoding.

A text is a lattice of pieces. Forward filtering sums, for each position, the weights of all ways to get there, a piece of score s
weighing exp(sharpness * s); backward sampling then walks from the end, taking each piece in proportion to what it
contributes, which draws a segmentation exactly in proportion to the product of its pieces' weights. No piece holds a space after
another character, so the lattice falls apart into words, whose forward sums are kept and whose occurrences are
sampled side by side. Draws are a hash of row key, seed, word number and step: a row gives the same pieces wherever it runs.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from math import exp, log

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from .mixture_packing import batch_type
from .storage import portions, tidy
from .suffix_dedup import mixed

SPACE = "▁"
#: A U+2581 of the text itself, which must not become a space: no valid text holds a lone surrogate.
LITERAL = "\ud800"
#: Words and lattice edges (12 bytes each) from which on a worker starts afresh, and words that are added and drawn at a time.
CACHE_WORDS, CACHE_EDGES, PORTION = 200_000, 4_000_000, 50_000
#: Bytes of the texts that are worked on at a time, if not a single text has more.
SLICE = 1 << 19

#: Words up to so many characters are worked on side by side, and their lattices are kept.
SIDE_BY_SIDE, HASH_FACTOR = 24, np.uint64(0x9E3779B97F4A7C15)

#: Words as no piece crosses their borders where pieces join only the classes below; else what lies between spaces.
find_units = regex.compile(rf"{SPACE}*(?:[\p{{L}}\p{{M}}]+|\p{{N}}?[^{SPACE}\p{{L}}\p{{M}}\p{{N}}]+)|\p{{N}}|{SPACE}+").findall
find_words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
#: Classes of neighbouring characters that a unit never parts: spaces before anything but a number, letters, other characters, a number before the latter.
JOINED = regex.compile(rf"{SPACE}*(?:[\p{{L}}\p{{M}}]*|\p{{N}}?[^{SPACE}\p{{L}}\p{{M}}\p{{N}}]*)")


def _hash(text: str) -> int:
    h = 0
    for c in text:
        h = (h + ord(c) + 1) * int(HASH_FACTOR) % (1 << 64)
    return h


def _uniform(seed: np.ndarray, step: int | np.ndarray) -> np.ndarray:
    """24-bit draws from 0 to below 1."""
    turn = np.atleast_1d(step).astype(np.uint64) + np.uint64(1)  # as an array: overflow is meant
    return (mixed(seed + turn * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24)


def _within_unit(piece: str) -> bool:
    """Whether no border between units can lie inside the piece, whatever stands around it."""
    return bool(JOINED.fullmatch(piece)) and not regex.match(rf"{SPACE}+\p{{N}}", piece)


class Pieces:
    def __init__(self, path: str, sharpness: float):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = library.get_piece_size()
        self.byte_ids = {int(library.id_to_piece(i)[1:-1], 16): i for i in range(n) if library.is_byte(i)}
        plain = [i for i in range(n) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i))]
        self.weights = {}
        lowest = min((x for i in plain if (x := library.get_score(i)) > -1e8), default=0.0)  # a piece scored as never counts as the least likely
        for i in plain:
            piece = library.id_to_piece(i)
            if SPACE not in piece.lstrip(SPACE):  # a space after another character would join two words
                self.weights[piece] = (i, exp(sharpness * max(lowest, library.get_score(i))))
        self.longest = max(map(len, self.weights), default=1)
        self.find = find_units if all(map(_within_unit, self.weights)) else find_words
        starts = {piece[:k] for piece in self.weights for k in range(1, len(piece) + 1)}
        hashed = {_hash(start): self.weights.get(start, (-1, 0.0)) for start in starts}
        self.start_keys = np.array(sorted(hashed), np.uint64)
        self.start_piece = np.array([hashed[k][0] for k in self.start_keys.tolist()], np.int64)
        self.start_weight = np.array([hashed[k][1] for k in self.start_keys.tolist()])
        self.edge_from, self.edge_id = np.empty(1 << 20, np.int32), np.empty(1 << 20, np.int32)
        self.edge_share, self.node_first = np.empty(1 << 20, np.float32), np.empty(1 << 19, np.int32)
        self.start()

    def start(self) -> None:
        """Begin with no word; the buffers stay."""
        self.words: dict[str, int] = {}
        self.nodes = self.edges = 0

    def _hold(self, name: str, used: int, values: np.ndarray) -> None:
        """``values`` behind the first ``used`` entries of a buffer, which doubles where it is full."""
        buffer = getattr(self, name)
        if used + len(values) > len(buffer):
            wider = np.empty(max(2 * len(buffer), used + len(values)), buffer.dtype)
            wider[:used] = buffer[:used]
            setattr(self, name, wider)
            buffer = wider
        buffer[used : used + len(values)] = values

    def add(self, words: list[str]) -> None:
        """Lattices of new words of at most SIDE_BY_SIDE characters, side by side. A node is a position after a word's start; its
        edges lie together, shares cumulated."""
        width = SIDE_BY_SIDE
        letters = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, width).astype(np.uint64)
        lengths = np.array([len(w) for w in words])
        found: list[tuple[np.ndarray, ...]] = []  # (word, from, to, piece, weight) of edges
        ends = np.zeros((len(words), width + 1), bool)
        for i in range(int(lengths.max())):
            alive = np.flatnonzero(lengths > i)
            h = np.zeros(len(alive), np.uint64)
            for j in range(i + 1, min(width, i + self.longest) + 1):
                inside = lengths[alive] >= j
                alive, h = alive[inside], h[inside]
                h = (h + letters[alive, j - 1] + np.uint64(1)) * HASH_FACTOR
                at = np.minimum(np.searchsorted(self.start_keys, h), len(self.start_keys) - 1)
                known = self.start_keys[at] == h
                alive, h, at = alive[known], h[known], at[known]
                if not len(alive):
                    break
                whole = self.start_piece[at] >= 0
                rows = alive[whole]
                ends[rows, j] = True
                found.append((rows, np.full(len(rows), i), np.full(len(rows), j), self.start_piece[at[whole]], self.start_weight[at[whole]]))
        # where no piece ends, the character's bytes lead there, as one edge (id -1-code)
        rows, to = np.nonzero(~ends[:, 1:] & (np.arange(width) < lengths[:, None]))
        found.append((rows, to, to + 1, -1 - letters[rows, to].astype(np.int64), np.ones(len(rows))))
        word, start, end, piece, weight = (np.concatenate(c) for c in zip(*found, strict=True))
        forward = np.zeros((len(words), width + 1))
        forward[:, 0] = 1
        order = np.argsort(end, kind="stable")
        flow = np.zeros(len(end))
        for e in np.split(order, np.searchsorted(end[order], np.arange(2, width + 1))):
            flow[e] = forward[word[e], start[e]] * weight[e]
            if len(e):
                forward[:, end[e[0]]] = np.bincount(word[e], weights=flow[e], minlength=len(words))
        order = np.lexsort((start, end, word))
        word, start, end, piece, flow = word[order], start[order], end[order], piece[order], flow[order]
        first = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (end[1:] != end[:-1])]))
        share = flow / forward[word, end]
        share = np.cumsum(share)
        share -= np.repeat(np.concatenate([[0.0], share[first[1:] - 1]]), np.diff(np.append(first, len(word))))
        share[np.append(first[1:], len(word)) - 1] = 2.0
        base = self.nodes + np.cumsum(lengths) - lengths
        self._hold("edge_from", self.edges, np.where(start > 0, base[word] + start - 1, -1))
        self._hold("edge_id", self.edges, piece)
        self._hold("edge_share", self.edges, share)
        self._hold("node_first", self.nodes, self.edges + first)
        self.words.update(zip(words, (base + lengths - 1).tolist(), strict=True))
        self.nodes += int(lengths.sum())
        self.edges += len(word)

    def sample(self, texts: list[str], seeds: np.ndarray) -> list[np.ndarray]:
        """Ids of one sampled segmentation of each text."""
        parts = [self.find(SPACE + t.replace(SPACE, LITERAL).replace(" ", SPACE)) for t in texts]
        counts = np.array([len(p) for p in parts])
        words = list(chain.from_iterable(parts))
        within = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
        seed = mixed(np.repeat(seeds, counts) + within.astype(np.uint64) * HASH_FACTOR)
        drawn = [self._draw(words[at : at + PORTION], seed[at : at + PORTION]) for at in range(0, len(words), PORTION)]
        ids, sizes = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*drawn, strict=True)) if drawn else (np.zeros(0, np.int64),) * 2
        cut = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        return [ids[a:b] for a, b in zip(cut, cut[1:], strict=False)]

    def _draw(self, words: list[str], seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of a sampled segmentation of each word in order, how many of each)."""
        if len(self.words) >= CACHE_WORDS or self.edges >= CACHE_EDGES:
            self.start()
        long = [n for n, w in enumerate(words) if len(w) > SIDE_BY_SIDE]
        short = np.delete(np.arange(len(words)), long)
        chosen = [words[n] for n in short.tolist()] if long else words
        new = list(set(chosen).difference(self.words))
        if new:
            self.add(new)
        node = np.fromiter(map(self.words.__getitem__, chosen), np.int64, len(chosen))
        edge_from, edge_id, edge_share, node_first = self.edge_from, self.edge_id, self.edge_share, self.node_first
        active, step, taken, owners = np.arange(len(node)), 0, [], []
        while len(active):
            u = _uniform(seed[short[active]], step)
            edge = node_first[node[active]]
            late = np.flatnonzero(edge_share[edge] <= u)
            while len(late):
                edge[late] += 1
                late = late[edge_share[edge[late]] <= u[late]]
            taken.append(edge_id[edge])
            owners.append(short[active])
            node[active] = edge_from[edge]
            active = active[node[active] >= 0]
            step += 1
        for n in long:
            ids = self._long(words[n], seed[n : n + 1])
            taken.append(ids)
            owners.append(np.full(len(ids), n))
        owner = np.concatenate([np.zeros(0, np.int64), *owners])
        ids = np.concatenate([np.zeros(0, np.int64), *taken])
        # drawn from each word's end, so the other way round; stable, as of one word the later draws come first
        order = np.argsort(owner[::-1], kind="stable")
        return self._bytes(owner[::-1][order], ids[::-1][order], len(words))

    def _long(self, word: str, seed: np.ndarray) -> np.ndarray:
        """Ids, last one first, of a long word, whose lattice is not kept: one logarithm of the forward sum for each position, and
        the pieces that end at a position are looked up again on the way back."""
        weights, longest = self.weights, self.longest
        forward = np.zeros(len(word) + 1)

        def into(j: int) -> list[tuple[int, int, float]]:
            """(from, piece, share before scaling) of the pieces that end at j; where there is none, the character's bytes."""
            level = float(forward[j - 1])
            found = ((i, weights.get(word[i:j])) for i in range(max(0, j - longest), j))
            return [(i, f[0], exp(min(700.0, float(forward[i]) - level)) * f[1]) for i, f in found if f] or [(j - 1, -1 - ord(word[j - 1]), 1.0)]

        for j in range(1, len(word) + 1):
            forward[j] = forward[j - 1] + log(sum(x for _, _, x in into(j)))
        out, at, step = array("q"), len(word), 0
        while at:
            if step % 1024 == 0:
                draws = _uniform(np.repeat(seed, 1024), np.arange(step, step + 1024)).tolist()
            ways = into(at)
            left = draws[step % 1024] * sum(x for _, _, x in ways)
            for i, piece, x in ways:
                left -= x
                if left < 0:
                    break
            out.append(piece)
            at, step = i, step + 1
        return np.array(out, np.int64)

    def _bytes(self, owner: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each of ``n`` owners), characters without a piece as the ids of their bytes."""
        low = np.flatnonzero(ids < 0)
        if not len(low):
            return ids, np.bincount(owner, minlength=n)
        codes, which = np.unique(-1 - ids[low], return_inverse=True)
        spelled = [[self.byte_ids[b] for b in (SPACE if c == ord(LITERAL) else chr(c)).encode("utf-8", "replace")] for c in codes.tolist()]
        size = np.array([len(x) for x in spelled])
        first, flat = np.cumsum(size) - size, np.array(list(chain.from_iterable(spelled)), np.int64)
        sizes = np.ones(len(ids), np.int64)
        sizes[low] = size[which]
        start = np.cumsum(sizes) - sizes
        out = np.repeat(ids, sizes)
        spread = np.repeat(np.arange(len(low)), sizes[low])
        inside = np.arange(len(spread)) - np.repeat(np.cumsum(sizes[low]) - sizes[low], sizes[low])
        out[start[low][spread] + inside] = flat[first[which][spread] + inside]
        return out, np.bincount(owner, weights=sizes, minlength=n).astype(np.int64)


class Spelling:
    """What decoding needs: the bytes of each piece."""

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = range(library.get_piece_size())
        # a byte's piece is no whole U+2581
        plain = lambda i: b"" if library.is_control(i) else library.id_to_piece(i).replace(SPACE, " ").encode()
        self.decoded = [bytes([int(library.id_to_piece(i)[1:-1], 16)]) if library.is_byte(i) else plain(i) for i in pieces]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the space that encoding put in front is taken away."""
        return b"".join(map(self.decoded.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]


@lru_cache(maxsize=2)
def pieces(path: str, sharpness: float) -> Pieces:
    return Pieces(path, sharpness)


@lru_cache(maxsize=2)
def spelling(path: str) -> Spelling:
    return Spelling(path)


def sample_pieces(df: DataFrame, model_path: str, seed: int = 0, sharpness: float = 2e-4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, ids (binary, little-endian unsigned 32-bit piece ids) of one sampled segmentation.

    The row key is the id's value and the text, so a row's pieces do not depend on partitioning, order or retries; rows that repeat id
    and text get the same pieces. Null text: null ids. Empty text: the piece of the leading space. Characters without a piece become
    byte pieces, as does a literal U+2581, so decoding is lossless. A null id is a key of its own. An empty table gives no rows.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = pieces(model_path, sharpness)
        for batch in batches:
            for some in portions(batch, 1, SLICE):
                texts = some.column(1).to_pylist()
                keys = [xxhash.xxh3_64_intdigest(f"{seed}|{i!r}|{t}".encode("utf-8", "replace")) for i, t in zip(some.column(0).to_pylist(), texts, strict=True)]
                ids = lattice.sample([t or "" for t in texts], np.array(keys, np.uint64))
                ids = [None if t is None else x.astype("<u4").tobytes() for t, x in zip(texts, ids, strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(ids, pa.binary())], names=[id_col, "ids"])

    return df.select(id_col, text_col).mapInArrow(tidy(run), f"`{id_col}` {kind}, ids binary")


def decode_pieces(df: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and the text of ``ids_col``; null ids give a null text."""
    kind, id_type = df.schema[id_col].dataType.simpleString(), batch_type(df, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = spelling(model_path)
        for batch in batches:
            for some in portions(batch, 1, 4 * SLICE):
                texts = [None if x is None else table.decode(np.frombuffer(x, "<u4")) for x in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0).cast(id_type), pa.array(texts, pa.string())], names=[id_col, "text"])

    return df.select(id_col, ids_col).mapInArrow(tidy(run), f"`{id_col}` {kind}, text string")
