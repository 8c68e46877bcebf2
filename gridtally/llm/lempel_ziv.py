"""Fingerprints of documents from their Lempel-Ziv phrases.

1.  A text is parsed from left to right into the shortest phrases that were not met before (LZ78, over
    UTF-8 bytes). The phrases are the nodes of a trie, each one byte longer than its parent.
2.  Every phrase gets a 64-bit hash; hashes of a trie's nodes come from those of their parents by
    pointer jumping, for all tries of a batch at once.
3.  The hashes are dealt into BINS by their upper bits, and of each bin the least one is kept in 16
    bits: a minimum-hash signature of one permutation.
4.  The likeness of two fingerprints is the share of bins with equal minima among those that are not
    empty in both. It estimates the Jaccard similarity of the phrase sets: texts that would help to
    compress each other share phrases.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import settle
from .words import U64, mix, pieces, put_back, row_schema, set_aside

BINS = 128
EMPTY = 0xFFFF
#: Bytes of text that one task compares, and the least for a task of its own.
TASK_BYTES = 16 << 20
LEAST_TASK_BYTES = 1 << 20
#: Keys sampled for each task, to cut the order of all documents into even stretches.
SAMPLED = 20

_STEP = U64(0x9E3779B97F4A7C15)


def parse(data: bytes, trie: dict[int, int], node: int = 0) -> int:
    """Go on parsing at a node of the trie; new phrases are numbered from 1 and stand in it as (parent
    << 8 | byte) -> number. Returns the node of the phrase that is not finished."""
    size, get = len(trie), trie.get
    for byte in data:
        key = node << 8 | byte
        node = get(key, 0)
        if not node:
            size += 1
            trie[key] = size
    return node


def phrase_hashes(tries: list[np.ndarray]) -> np.ndarray:
    """Hashes of all phrases of tries, given as their keys in the order of numbers, one after another."""
    size = np.array([len(t) for t in tries], np.int64)
    keys = np.concatenate([np.zeros(1, np.int64), *tries])
    parent = keys >> 8
    base = np.concatenate([[0], np.repeat(np.cumsum(size) - size, size)])
    parent = np.where(parent > 0, parent + base, 0)
    value = (keys & 255).astype(U64) + U64(1)
    times = np.full(len(keys), _STEP)
    value[0], times[0] = U64(0), U64(1)
    while parent.any():
        value = value + times * value[parent]
        times = times * times[parent]
        parent = parent[parent]
    return mix(value[1:])


def signatures(tries: list[np.ndarray]) -> np.ndarray:
    """One row of BINS 16-bit minima for every trie; EMPTY marks bins without a phrase."""
    h = phrase_hashes(tries)
    which = np.repeat(np.arange(len(tries)), [len(t) for t in tries])
    out = np.full(len(tries) * BINS, ~U64(0))
    shift = U64(64 - BINS.bit_length() + 1)
    np.minimum.at(out, which * BINS + (h >> shift).astype(np.int64), h << U64(64) - shift)
    # The least hashes of a bin lie close to 0: they are spread again before they are cut.
    small = (mix(out) % U64(EMPTY)).astype(np.uint16)
    return np.where(out == ~U64(0), np.uint16(EMPTY), small).reshape(-1, BINS)


def likeness_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row. Two signatures without phrases are alike, one without and one with are not."""
    there = (a != EMPTY) | (b != EMPTY)
    n = there.sum(axis=1)
    return np.where(n > 0, ((a == b) & there).sum(axis=1) / np.maximum(n, 1), 1.0)


def _written(rows: np.ndarray) -> pa.Array:
    return pa.array([base64.b64encode(r.astype("<u2").tobytes()).decode() for r in rows], pa.string())


def _trie(data: bytes) -> dict[int, int]:
    trie: dict[int, int] = {}
    parse(data, trie)
    return trie


def _keys(trie: dict[int, int]) -> np.ndarray:
    return np.fromiter(trie, np.int64, len(trie))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``lz_phrases``, the number of phrases, and ``lz_fingerprint``, the signature as text.

    Equal texts have equal fingerprints, whatever their rows; a null or empty text has no phrases and
    the fingerprint without any. Texts are parsed whole. Given columns of these names are replaced.
    """
    rows, names = set_aside(docs.drop("lz_phrases", "lz_fingerprint"))
    own = next(n for n, c in names.items() if c == text)
    columns = rows.columns

    def run(batches):
        for part in pieces(batches, own):
            tries = [_keys(_trie((t or "").encode())) for t in part.column(own).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in columns], pa.array([len(t) for t in tries], pa.int64()), _written(signatures(tries))],
                names=[*columns, "lz_phrases", "lz_fingerprint"],
            )

    names = names | {"lz_phrases": "lz_phrases", "lz_fingerprint": "lz_fingerprint"}
    return put_back(rows.mapInArrow(run, row_schema(rows, "lz_phrases bigint", "lz_fingerprint string")), names)


def _likeness():
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        both = a.is_valid().to_numpy(zero_copy_only=False) & b.is_valid().to_numpy(zero_copy_only=False)
        read = lambda x: np.frombuffer(
            b"".join(base64.b64decode(v) for v, ok in zip(x.to_pylist(), both) if ok), "<u2"
        ).reshape(-1, BINS)
        out = np.zeros(len(both))
        if both.any():
            out[both] = likeness_of(read(a), read(b))
        return pa.array(out, mask=~both)

    return run


def likeness(a: Column | str, b: Column | str) -> Column:
    """Likeness from 0 to 1 of two columns of fingerprints; null if either is."""
    return F.arrow_udf(_likeness(), "double")(a, b)


# ---------------------------------------------------------------------------------------------------
# Every document next to the one after it.


def _place(cut_o: np.ndarray, cut_h: np.ndarray, o: np.ndarray, h: np.ndarray) -> np.ndarray:
    """How many of the sorted cut points are at or before each key (o, h)."""
    low, high = np.searchsorted(cut_o, o, "left"), np.searchsorted(cut_o, o, "right")
    out = low.copy()
    for i in np.flatnonzero(high > low).tolist():
        out[i] += int(np.searchsorted(cut_h[low[i] : high[i]], h[i], "right"))
    return out


def _stretches(keys: DataFrame, tasks: int):
    """A function (o, h) -> stretch, and the first key of every stretch that is not empty."""
    count = keys.count()
    stride = max(1, count // max(1, SAMPLED * tasks))
    got = keys.where(F.pmod(F.xxhash64("o", "h"), F.lit(stride)) == 0).select("o", "h").toArrow()
    o, h = (got.column(c).to_numpy() for c in ("o", "h"))
    by = np.lexsort((h, o))
    cut = by[np.unique(np.arange(1, tasks) * len(by) // tasks)] if len(by) else by
    cut_o, cut_h = o[cut], h[cut]
    shared = keys.sparkSession.sparkContext.broadcast((cut_o, cut_h))

    def place(o: pa.Array, h: pa.Array) -> pa.Array:
        return pa.array(_place(*shared.value, o.to_numpy(), h.to_numpy()), pa.int32())

    heads = keys.withColumn("stretch", F.arrow_udf(place, "int")("o", "h")).groupBy("stretch").agg(F.min(F.struct("o", "h")).alias("k"))
    first = sorted((r["stretch"], r["k"]["o"], r["k"]["h"]) for r in heads.collect())
    return (cut_o, cut_h), first


def beside_next(docs: DataFrame, key: str, text: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(o, h, edge, id, text), partitioned so that every document stands before the one after it in
    falling order of keys; null keys are last, ties stand by the text's hash, and after the last
    comes the first.

    A partition ends with a row of ``edge`` true, the first document of the next one. Only keys are
    sampled and brought to the driver, some for each partition; each text is shuffled once. Rows that
    repeat both key and text meet in one partition.
    """
    spark = docs.sparkSession
    last = F.lit((1 << 63) - 1)
    keyed = docs.select(
        F.coalesce(F.bitwise_not(F.col(f"`{key}`").cast("bigint")), last).alias("o"),
        F.xxhash64(f"`{text}`").alias("h"),
        F.col(f"`{key}`").cast("bigint").alias("id"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    keys = settle(keyed.select("o", "h", F.octet_length("text").cast("bigint").alias("bytes")))
    size = keys.agg(F.sum("bytes")).first()[0] or 0
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, -(-size // task_bytes), min(width, size // LEAST_TASK_BYTES))
    cuts, first = _stretches(keys, tasks)
    before = {(o, h): (s, first[i - 1][0]) for i, (s, o, h) in enumerate(first)}
    shared = spark.sparkContext.broadcast((cuts, before))

    def to(o: pa.Array, h: pa.Array) -> pa.Array:
        (cut_o, cut_h), heads = shared.value
        x, y = o.to_numpy(), h.to_numpy()
        own = _place(cut_o, cut_h, x, y).tolist()
        # The first document of a stretch also goes to the end of the one before.
        return pa.array([[s, heads[k][1]] if (k := (a, b)) in heads else [s] for s, a, b in zip(own, x.tolist(), y.tolist())], pa.list_(pa.int32()))

    rows = keyed.withColumn("to", F.arrow_udf(to, "array<int>")("o", "h"))
    rows = rows.select("o", "h", "id", "text", F.posexplode("to").alias("copy", "stretch"))
    rows = rows.repartitionById(tasks, "stretch").select("o", "h", (F.col("copy") > 0).alias("edge"), "id", "text")
    return rows.sortWithinPartitions("edge", "o", "h")


COMPARED = (
    "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def _pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare each row with its text edited and with the next row. A text's beginning, which its edited
    text shares, is parsed once."""
    held: tuple | None = None  # (id, text, signature)
    for part in pieces(batches, "text"):
        ids, texts, edges = (part.column(c).to_pylist() for c in ("id", "text", "edge"))
        if held is not None:
            ids, texts, edges = [held[0], *ids], [held[1], *texts], [False, *edges]
        own, edited, digests = [], [], []
        end = next((i for i, e in enumerate(edges) if e), len(ids) - 1)
        for i in range(end):
            t = texts[i]
            m = len(t) // 2
            head, donor = t[: len(t) - m], texts[i + 1][:m]
            trie: dict[int, int] = {}
            node = parse(head.encode(), trie)
            if i or held is None:
                whole = trie.copy()
                parse(t[len(t) - m :].encode(), whole, node)
                own.append(_keys(whole))
            donor_bytes = donor.encode()
            parse(donor_bytes, trie, node)
            edited.append(_keys(trie))
            digests.append(hashlib.sha256(head.encode() + donor_bytes).hexdigest())
        if end or held is None:
            own.append(_keys(_trie(texts[end].encode())))
        mine = signatures(own) if own else np.zeros((0, BINS), np.uint16)
        if held is not None:
            mine = np.concatenate([held[2][None], mine])
        if end:
            theirs = signatures(edited)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[:end], pa.int64()),
                    pa.array([len(t) for t in texts[:end]], pa.int64()),
                    pa.array(digests, pa.string()),
                    _written(mine[:end]),
                    _written(theirs),
                    pa.array(likeness_of(mine[:end], theirs)),
                    pa.array(likeness_of(mine[:end], mine[1 : end + 1])),
                ],
                names=[c.split()[0] for c in COMPARED.split(", ")],
            )
        if edges[end]:
            return
        held = (ids[end], texts[end], mine[end])


def compare_edited(docs: DataFrame, key: str = "doc_id", text: str = "text", task_bytes: int = TASK_BYTES) -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every
    document, for judging the fingerprints.

    A text of n code points is edited by replacing its last floor(n / 2) by the first as many (or all)
    of the next document's text, in falling order of keys; the first follows on the last, so that a
    single document follows on itself. ``near_edited`` and ``near_next`` are the likeness of the
    text's fingerprint with those of its edited text and of the next document.

    Null texts count as empty. Null keys are last; rows of one key stand by the hash of their text, so
    that repeated rows follow each other. An empty table gives none.
    """
    return beside_next(docs, key, text, task_bytes).mapInArrow(_pairs, COMPARED).withColumnRenamed("id", key)
