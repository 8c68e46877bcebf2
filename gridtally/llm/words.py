"""Words of whole Arrow text columns as numpy arrays.

A text is read as its UTF-8 bytes with A-Z lowered. Words are maximal runs of the bytes of a
``kind``; every word gets a 64-bit hash from prefix sums, so that no word becomes a Python object.
Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = (U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53), U64(33))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words: everything but white space, or ASCII letters and digits with all non-ASCII bytes.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

#: Bytes of text whose words are hashed at a time; a longer word is hashed whole.
HASH_BYTES = 1 << 17

#: Bytes of an Arrow batch between Spark and its Python workers, where the session does not say.
BATCH_BYTES = 4 << 20

_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(U64, copy=False)
    x = (x ^ (x >> _MIX[2])) * _MIX[0]
    x = (x ^ (x >> _MIX[2])) * _MIX[1]
    return x ^ (x >> _MIX[2])


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, U64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U64)
    return _powers[0], _powers[1]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and the offsets of the texts in them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


@dataclass
class Words:
    """Words of a column: where each text's words begin, and per word its bytes' place and hash."""

    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.hash)


def words(column: pa.Array, kind: np.ndarray = SPACED) -> Words:
    raw, at = text_bytes(column)
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(len(at), np.int64), none, none, np.zeros(0, U64))
    low = LOWER[raw]
    inside = kind[low]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    before[at[:-1][at[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    after[at[1:][at[1:] > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    h = np.empty(len(start), U64)
    for lo, hi in zip(*_runs(start // HASH_BYTES) if len(start) else ([], [])):
        h[lo:hi] = _hashes(low, start[lo:hi], end[lo:hi])
    return Words(np.searchsorted(start, at), start, end, h)


def _hashes(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of words that stand close together, from the prefix sums of their stretch."""
    first = start[0]
    n = int(end[-1] - first)
    power, inverse = _grow(n + 1)
    sums = np.empty(n + 1, U64)
    sums[0] = 0
    np.cumsum((low[first : end[-1]].astype(U64) + U64(1)) * power[:n], out=sums[1:])
    return mix((sums[end - first] - sums[start - first]) * inverse[start - first])


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``k`` words of every text, with the texts' numbers, in text order. A
    text of fewer words, but not none, has its whole sequence as the only run."""
    count = np.diff(w.first)
    runs = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    doc = np.repeat(np.arange(len(count)), runs)
    at = w.first[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(runs) - runs, runs)
    h = np.zeros(len(doc), U64)
    length = np.minimum(count, k)[doc]
    for i in range(k):
        has = length > i
        h[has] = mix(h[has] * U64(_BASE) + w.hash[at[has] + i] + U64(i))
    return h, doc


def distinct(h: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes in rising order, and the offsets of the texts in them."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(docs + 1))


def pieces(
    batches: Iterable[pa.RecordBatch], column: str, limit: int = 1 << 21, rows: int = 4096
) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about ``limit`` bytes of text and at most ``rows`` rows each, for
    bounded memory. A longer text is a part of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.diff(text_bytes(batch.column(column))[1])
        part = (np.cumsum(size) - size) // limit
        for lo, hi in zip(*_runs(part)):
            for at in range(lo, hi, rows):
                yield batch.slice(at, min(rows, hi - at))


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = np.flatnonzero(x[1:] != x[:-1]) + 1
    return np.concatenate([[0], cut]), np.concatenate([cut, [len(x)]])


def groups(batches: Iterable[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """The rows of each key, one table a key, from batches that are sorted by whole-number keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cut = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for lo, hi in zip(cut[:-1], cut[1:]):
            key = tuple(c[lo] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def set_aside(docs):
    """The same rows under names that clash with nothing, and the given names by the new ones."""
    names = {f"column_{i}": c for i, c in enumerate(docs.columns)}
    return docs.toDF(*names), names


def put_back(rows, names: dict[str, str]):
    """The columns of ``set_aside`` under the names that were given."""
    return rows.select(*names).toDF(*names.values())


def bounded_batches(spark) -> None:
    """Bound the session's Arrow batches by BATCH_BYTES, unless it has a bound of its own. Texts make
    batches of ten thousand rows large, in the executor and again in each of its Python workers."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, str(BATCH_BYTES))


def row_schema(df, *extra: str) -> str:
    """The columns of a frame and further ones, as text for ``mapInArrow``."""
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *extra])
