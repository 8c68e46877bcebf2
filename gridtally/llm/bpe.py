"""Byte-level BPE encoding and decoding with padded numpy matrices.

A batch of texts is cut into pieces by the vocabulary's pattern; its new distinct pieces are sorted
into matrices by length, one piece a row. In each round every row merges its leftmost pair of
minimum rank; rows without a pair to merge leave the matrix. Pairs are looked up in an open hash
table. Merged pieces are kept for later batches, up to KEEP of them.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .words import pieces, row_schema

NONE = np.int64(1 << 40)
#: Longest piece, in bytes, that becomes a matrix row. A longer one takes the same merges in the
#: same order from a heap, as a matrix would cost the square of its length.
ROW_BYTES = 256
KEEP = 300_000
#: Bytes of one matrix at most, as ids.
MATRIX_IDS = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairTable:
    """Open addressing: (left id, right id) to the id of the joined token."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int64)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[slot[todo]] < 0
            at, first = np.unique(slot[todo[free]], return_index=True)
            placed = todo[free][first]
            self.keys[at], self.values[at] = keys[placed], values[placed]
            todo = np.setdiff1d(todo, placed, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the joined tokens; NONE where there is no such token or a side is padding (-1)."""
        keys = (left << 32) | right
        out = np.full(keys.shape, NONE)
        flat, found = keys.ravel(), out.ravel()
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slot = self._slot(flat[todo])
        while len(todo):
            there = self.keys[slot]
            same = there == flat[todo]
            found[todo[same]] = self.values[slot[same]]
            on = ~same & (there >= 0)
            todo, slot = todo[on], (slot[on] + 1) & (len(self.keys) - 1)
        return found.reshape(keys.shape)


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} of the 256 bytes")
        self.ranks, self.pattern = ranks, pattern
        found = regex.compile(pattern)
        if found.groups:
            raise ValueError("the pattern may have no groups")
        self.split = found.findall
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        keys, values = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append((a << 32) | b)
                    values.append(rank)
        self.pairs = PairTable(np.array(keys, np.int64), np.array(values, np.int64))
        size = max(ranks.values()) + 1
        lengths = np.zeros(size + 1, np.int64)
        for token, rank in ranks.items():
            lengths[rank + 1] = len(token)
        self.token_at = np.cumsum(lengths)
        self.token_bytes = np.zeros(self.token_at[-1], np.uint8)
        for token, rank in ranks.items():
            self.token_bytes[self.token_at[rank] : self.token_at[rank + 1]] = np.frombuffer(token, np.uint8)
        self.seen = _Index()
        self.ids: list[np.ndarray] = []

    def encode_pieces(self, found: Sequence[bytes]) -> list[np.ndarray]:
        """The ids of each piece. A piece that is a token stays whole."""
        out: list[np.ndarray | None] = [None] * len(found)
        buckets: dict[int, list[int]] = {}
        for k, piece in enumerate(found):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[k] = np.array([rank])
            elif len(piece) > ROW_BYTES:
                out[k] = self._long(piece)
            else:
                buckets.setdefault((len(piece) - 1).bit_length(), []).append(k)
        for bits, rows in buckets.items():
            step = max(1, MATRIX_IDS >> bits)
            for lo in range(0, len(rows), step):
                part = rows[lo : lo + step]
                for k, ids in zip(part, self._rounds([found[k] for k in part])):
                    out[k] = ids
        return out

    def _rounds(self, found: list[bytes]) -> list[np.ndarray]:
        length = np.array([len(x) for x in found])
        width = int(length.max())
        ids = np.full((len(found), width), -1, np.int64)
        ids[np.arange(width) < length[:, None]] = self.byte_ids[np.frombuffer(b"".join(found), np.uint8)]
        rank = np.full((len(found), width), NONE)
        rank[:, :-1] = self.pairs.get(ids[:, :-1], ids[:, 1:])
        rows, out = np.arange(len(found)), [None] * len(found)
        while len(rows):
            at = rank.argmin(axis=1)  # the leftmost of equal minima
            here = np.arange(len(rows))
            best = rank[here, at]
            done = best == NONE
            if done.any():
                for r, row in zip(rows[done].tolist(), ids[done]):
                    out[r] = row[row >= 0]
                keep = ~done
                rows, ids, rank, at, best = rows[keep], ids[keep], rank[keep], at[keep], best[keep]
                if not len(rows):
                    break
                here = np.arange(len(rows))
            # Merge at ``at``: what stands right of it moves one place left.
            width = ids.shape[1] - 1
            source = np.arange(width) + (np.arange(width) > at[:, None])
            ids, rank = np.take_along_axis(ids, source, 1), np.take_along_axis(rank, source, 1)
            ids[here, at] = best
            right = np.where(at + 1 < width, ids[here, np.minimum(at + 1, width - 1)], -1)
            rank[here, at] = self.pairs.get(best, right)
            some = at > 0
            rank[here[some], at[some] - 1] = self.pairs.get(ids[here[some], at[some] - 1], best[some])
        return out

    def _long(self, piece: bytes) -> np.ndarray:
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        first = self.pairs.get(ids[:-1], ids[1:])
        ids, n = ids.tolist(), len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(first.tolist()) if r != NONE]
        heapq.heapify(heap)
        tokens: dict[tuple[int, int], int] = {}

        def pair(a: int, b: int) -> int:
            if (a, b) not in tokens:
                tokens[a, b] = int(self.pairs.get(np.array([a]), np.array([b]))[0])
            return tokens[a, b]

        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := pair(ids[x], ids[y])) != NONE:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return np.array([x for x in ids if x >= 0], np.int64)

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row and the texts' offsets in them."""
        if len(self.seen) > KEEP:
            self.seen, self.ids = _Index(), []
        used = []
        for text in texts:
            part = list(map(self.seen.__getitem__, self.split(text or "")))
            used.append(np.array(part, np.int64))
        self.ids += self.encode_pieces([x.encode() for x in islice(self.seen, len(self.ids), None)])
        sizes = np.fromiter(map(len, self.ids), np.int64, len(self.ids))
        begin = np.cumsum(sizes) - sizes
        flat = np.concatenate(self.ids) if self.ids else np.zeros(0, np.int64)
        piece = np.concatenate(used) if used else np.zeros(0, np.int64)
        n = sizes[piece]
        ends = np.cumsum(n)
        ids = flat[np.repeat(begin[piece] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        count = np.cumsum([0, *map(len, used)])
        return ids, np.concatenate([[0], ends])[count]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids in a row and the ids' offsets in them."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.token_at) - 1):
            raise ValueError("an id is outside the vocabulary")
        n = self.token_at[ids + 1] - self.token_at[ids]
        ends = np.cumsum(n)
        at = np.repeat(self.token_at[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        return self.token_bytes[at], np.concatenate([[0], ends])


class _Index(dict):
    """Numbers new keys in order of arrival."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


_built: dict[int, Bpe] = {}


def _model(sent, pattern: str) -> Bpe:
    """The vocabulary's tables, built once in each worker process."""
    if sent.id not in _built:
        _built[sent.id] = Bpe(sent.ranks, pattern)
    return _built[sent.id]


class _Sent:
    def __init__(self, ranks: dict[bytes, int]):
        self.id, self.ranks = hash(frozenset(ranks.items())), ranks


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the token ids of every whole text (``array<int>``).

    ``path`` names a rank file on the driver; the vocabulary (a megabyte or so) is broadcast. Every
    match of ``pattern`` is encoded on its own, without special tokens. A null text is empty and
    has no ids; equal texts are encoded one by one to equal ids; a text may have any length. A given
    column named ``ids`` is replaced.
    """
    docs = docs.drop(ids)
    sent = docs.sparkSession.sparkContext.broadcast(_Sent(read_ranks(path)))
    columns = docs.columns

    def run(batches):
        for part in pieces(batches, text):
            model = _model(sent.value, pattern)
            flat, at = model.encode(part.column(text).to_pylist())
            got = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], got], names=[*columns, ids])

    return docs.mapInArrow(run, row_schema(docs, f"`{ids}` array<int>"))


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes of an ``array<int>`` of token ids (null ids: no bytes). An id outside the
    vocabulary is an error. A given column named ``out`` is replaced."""
    docs = docs.drop(out)
    sent = docs.sparkSession.sparkContext.broadcast(_Sent(read_ranks(path)))
    columns = docs.columns

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                part = whole.slice(lo, 512)
                model = _model(sent.value, pattern)
                lists = part.column(ids)
                n = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()], np.int64)
                raw, at = model.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
                at = at[np.concatenate([[0], np.cumsum(n)])]
                got = pa.Array.from_buffers(
                    pa.binary(), len(n), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw)]
                )
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], got], names=[*columns, out])

    return docs.mapInArrow(run, row_schema(docs, f"`{out}` binary"))
