"""Phrases that occur together more often than by chance, from truncated suffix trees in groups.

The corpus' suffix tree over words, cut off below ``max_words`` words and below nodes that are met
fewer than ``min_count`` times, is never held in one place:

1.  Words are counted: the tree's first level.
2.  Vertical partitioning: the suffixes of a level fall into groups by the hash of their prefix. A
    prefix is a single word, or, while it alone would take an eighth of a group's memory budget, one
    word more. No prefix is large then, and groups of about half a budget stay within it.
3.  Each level is one pass over the texts. Tasks add up the windows of their part and send a group's
    share as one block of sorted paths and counts, so that a phrase of a third of the corpus is one
    entry a task. A window is sent if both of its parts that are one word shorter may be nodes of the
    level before: a bitmap of fixed size tells, and errs on the side of sending.
4.  A group's subtree is built from its blocks in one task, independent of all others; its leaf totals
    are the level's counts.

Scores, containment and ranks are joins and windows over the nodes that are left.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settle
from .words import LOWER, U64, mix, pieces, signed, text_bytes, words

SEPARATORS = b".,;:!?\n\x0b\x0c\r"
IN_WORD = np.ones(256, bool)
IN_WORD[list(b"\t " + SEPARATORS)] = False
_SEPARATES = np.zeros(256, bool)
_SEPARATES[list(SEPARATORS)] = True
NO_LANGUAGE = "und"
#: Windows that a group may have.
BUDGET = 1_000_000
#: Bits of a node's hash that have a place in a bitmap: 2^26 places are 8 MB.
PLACE_BITS = 26
#: Windows and different words that a task holds before it adds them up or passes them on.
HELD = 1 << 19
HELD_WORDS = 200_000
PART_BYTES = 2 << 20

_FOLD = U64(0x9E3779B97F4A7C15)


def _fold(node: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a node's child."""
    return mix(node * _FOLD + word)


def _language_codes(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A 64-bit code of every row's language, and the languages."""
    coded = column.cast(pa.string()).fill_null(NO_LANGUAGE).dictionary_encode()
    codes = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in coded.dictionary.to_pylist()]
    at = coded.indices.to_numpy(zero_copy_only=False)
    return np.array(codes, U64)[at] if len(codes) else np.zeros(len(at), U64), coded.dictionary.take(coded.indices)


class Tokens:
    """The words of a part: their keys, which hold the language, and whether each is followed by the
    next one within a piece."""

    def __init__(self, part: pa.RecordBatch):
        self.found = words(part.column("text"), IN_WORD)
        raw, _ = text_bytes(part.column("text"))
        codes, self.language = _language_codes(part.column("lang"))
        w = self.found
        self.doc = w.doc
        self.key = mix(w.hash ^ codes[self.doc])
        self.joined = np.zeros(len(w), bool)
        if len(w) > 1:
            cuts = np.concatenate([[0], np.cumsum(_SEPARATES[raw], dtype=np.int32)])
            self.joined[:-1] = (self.doc[1:] == self.doc[:-1]) & (cuts[w.start[1:]] == cuts[w.end[:-1]])
        self.raw = raw

    def spelled(self, at: np.ndarray) -> pa.Array:
        """The words at the given numbers, lowered."""
        start, size = self.found.start[at], self.found.end[at] - self.found.start[at]
        offsets = np.concatenate([[0], np.cumsum(size)])
        data = LOWER[self.raw[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])]]
        return pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def _vocabulary(batches):
    """(key, lang, word, n) of a task's words, each once while they fit into HELD_WORDS."""

    def passed():
        return pa.RecordBatch.from_arrays(
            [
                pa.array(signed(np.concatenate(keys)), pa.int64()),
                pa.concat_arrays(langs),
                pa.concat_arrays(spelled),
                pa.array(counts, pa.int64()),
            ],
            names=["key", "lang", "word", "n"],
        )

    seen, place, counts = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, langs, spelled = [], [], []
    for part in pieces(batches, "text", PART_BYTES):
        tokens = Tokens(part)
        key, first, n = np.unique(tokens.key, return_index=True, return_counts=True)
        at = np.searchsorted(seen, key)
        known = np.zeros(len(key), bool)
        if len(seen):
            near = np.minimum(at, len(seen) - 1)
            known = seen[near] == key
            counts[place[near[known]]] += n[known]
        new = first[~known]
        if len(new):
            keys.append(key[~known])
            langs.append(tokens.language.take(pa.array(tokens.doc[new])))
            spelled.append(tokens.spelled(new))
            place = np.insert(place, at[~known], len(counts) + np.arange(len(new)))
            seen = np.insert(seen, at[~known], key[~known])
            counts = np.concatenate([counts, n[~known]])
        if len(counts) > HELD_WORDS:
            yield passed()
            seen, place, counts = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            keys, langs, spelled = [], [], []
    if len(counts):
        yield passed()


def _marks(nodes: DataFrame) -> np.ndarray:
    """A bitmap of the hashes ``node``: at most 2^PLACE_BITS bits reach the driver."""
    place = F.shiftrightunsigned("node", 64 - PLACE_BITS)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(63)).cast("int"))
    rows = nodes.select(F.shiftright(place, 6).alias("slot"), bit.alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits"))
    got = rows.toArrow()
    out = np.zeros(1 << PLACE_BITS - 6, U64)
    out[got.column("slot").to_numpy()] = got.column("bits").to_numpy().view(U64)
    return out


def _marked(marks: np.ndarray, node: np.ndarray) -> np.ndarray:
    place = node >> U64(64 - PLACE_BITS)
    return (marks[place >> U64(6)] >> (place & U64(63))) & U64(1) == 1


def _windows(tokens: Tokens, size: int, active: np.ndarray) -> np.ndarray:
    """Paths of ``size`` words whose two parts of one word less may be nodes."""
    n = len(tokens.key) - size + 1
    if n <= 0:
        return np.zeros((0, size), U64)
    inside = np.ones(n, bool)
    for i in range(size - 1):
        inside &= tokens.joined[i : i + n]
    part = tokens.key
    for i in range(1, size - 1):
        part = _fold(part[:-1], tokens.key[i:])
    may = _marked(active, part)
    at = np.flatnonzero(inside & may[:n] & may[1 : n + 1])
    return np.stack([tokens.key[at + i] for i in range(size)], axis=1)


def _groups(paths: np.ndarray, heavy: np.ndarray, count: int) -> np.ndarray:
    """Each path's group, by the hash of its shortest prefix that is not heavy."""
    prefix, node = paths[:, 0].copy(), paths[:, 0]
    is_heavy = _marked(heavy, prefix)
    for i in range(1, paths.shape[1]):
        node = _fold(node, paths[:, i])
        prefix = np.where(is_heavy, node, prefix)
        is_heavy &= _marked(heavy, node)
    return ((mix(prefix) >> U64(32)) * U64(count) >> U64(32)).astype(np.int64)


def _added(paths: np.ndarray, n: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same with equal paths added up, by group. (Paths whose sort keys collide may stay apart.)"""
    node = paths[:, 0]
    for i in range(1, paths.shape[1]):
        node = _fold(node, paths[:, i])
    order = np.argsort(group.astype(U64) << U64(40) | node >> U64(24))
    paths, n, group = paths[order], n[order], group[order]
    new = np.ones(len(paths), bool)
    new[1:] = (paths[1:] != paths[:-1]).any(axis=1) | (group[1:] != group[:-1])
    first = np.flatnonzero(new)
    return paths[first], np.add.reduceat(n, first) if len(first) else n, group[first]


def _entry(size: int) -> np.dtype:
    return np.dtype([("path", "<u8", (size,)), ("n", "<u4")])


def _blocks(paths: np.ndarray, n: np.ndarray, group: np.ndarray) -> pa.RecordBatch:
    """One row for each group: its entries as bytes. Groups rise."""
    entry = _entry(paths.shape[1])
    data = np.empty(len(paths), entry)
    data["path"], data["n"] = paths, n
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    offsets = np.append(first, len(paths)) * entry.itemsize
    block = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(group[first], pa.int32()), block], names=["grp", "block"])


def _shares(batches, size: int, active: np.ndarray, heavy: np.ndarray, count: int):
    """A task's windows added up, as blocks by group."""
    held: list[np.ndarray] = []
    rows = 0
    sums = None
    for part in pieces(batches, "text", PART_BYTES):
        paths = _windows(Tokens(part), size, active)
        held.append(paths)
        rows += len(paths)
        if rows > HELD:
            sums = _with(sums, held, heavy, count)
            held, rows = [], 0
            if len(sums[0]) > HELD:
                yield _blocks(*sums)
                sums = None
    sums = _with(sums, held, heavy, count) if rows else sums
    if sums is not None:
        yield _blocks(*sums)


def _with(sums, held: list[np.ndarray], heavy: np.ndarray, count: int):
    paths = np.concatenate(held)
    new = _added(paths, np.ones(len(paths), np.int64), _groups(paths, heavy, count))
    return new if sums is None else _added(*(np.concatenate([a, b]) for a, b in zip(sums, new)))


class Subtree:
    """The part of the tree below a group's prefixes: sorted paths of one length with leaf totals."""

    def __init__(self, size: int):
        self.size, self.paths, self.n = size, np.zeros((0, size), U64), np.zeros(0, np.int64)

    def add(self, paths: np.ndarray, n: np.ndarray) -> None:
        paths, n = np.concatenate([self.paths, paths]), np.concatenate([self.n, n])
        order = np.lexsort(paths.T[::-1])
        paths, n = paths[order], n[order]
        new = np.ones(len(paths), bool)
        new[1:] = (paths[1:] != paths[:-1]).any(axis=1)
        first = np.flatnonzero(new)
        self.paths, self.n = paths[first], np.add.reduceat(n, first) if len(first) else n


def _subtree(batches, size: int, min_count: int):
    """(path, node, n) of the leaves of a task's subtree that are met often enough."""
    tree, held, rows = Subtree(size), [], 0
    for batch in batches:
        for block in batch.column("block"):
            held.append(np.frombuffer(block.as_buffer(), _entry(size)))
            rows += len(held[-1])
            if rows > HELD:
                tree.add(np.concatenate([x["path"] for x in held]), np.concatenate([x["n"] for x in held]).astype(np.int64))
                held, rows = [], 0
    if rows:
        tree.add(np.concatenate([x["path"] for x in held]), np.concatenate([x["n"] for x in held]).astype(np.int64))
    at = np.flatnonzero(tree.n >= min_count)
    for lo in range(0, len(at), 100_000):
        some = at[lo : lo + 100_000]
        paths = tree.paths[some]
        node = paths[:, 0]
        for i in range(1, size):
            node = _fold(node, paths[:, i])
        ends = pa.array(np.arange(len(some) + 1) * size, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [
                pa.ListArray.from_arrays(ends, pa.array(signed(paths.ravel()), pa.int64())),
                pa.array(signed(node), pa.int64()),
                pa.array(tree.n[some]),
            ],
            names=["path", "node", "n"],
        )


def count_phrases(docs: DataFrame, max_words: int, min_count: int, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """The vocabulary (key, lang, word, n), and (path, node, n) of all phrases of one to ``max_words``
    words, as their words' keys, that are met ``min_count`` times or more. Both are stored."""
    spark = docs.sparkSession
    vocabulary = settle(docs.mapInArrow(_vocabulary, "key bigint, lang string, word string, n bigint").groupBy("key", "lang", "word").agg(F.sum("n").alias("n")))
    level = vocabulary.where(F.col("n") >= min_count).select(F.array("key").alias("path"), F.col("key").alias("node"), "n")
    if level.groupBy("node").count().where("count > 1").limit(1).count():
        raise RuntimeError("two frequent words have one 64-bit hash")
    levels, heavy = [level], np.zeros(1 << PLACE_BITS - 6, U64)
    for size in range(2, max_words + 1):
        # The windows of a level are at most the occurrences of the nodes that they go on from.
        most = level.agg(F.sum("n")).first()[0] or 0
        count = max(1, -(-2 * most // budget))
        heavy = heavy | _marks(level.where(F.col("n") > budget // 8).select("node"))
        sent = spark.sparkContext.broadcast((_marks(level.select("node")), heavy))
        shares = docs.mapInArrow(
            lambda it, size=size, sent=sent, count=count: _shares(it, size, *sent.value, count), "grp int, block binary"
        )
        met = shares.repartitionById(count, "grp")
        level = settle(met.mapInArrow(lambda it, size=size: _subtree(it, size, min_count), "path array<bigint>, node bigint, n bigint"))
        levels.append(level)
    nodes = levels[0]
    for x in levels[1:]:
        nodes = nodes.unionByName(x)
    return vocabulary, nodes


def _score(a: str, l: str, r: str) -> Column:  # noqa: E741
    """floor(1000000 a a / (l r)), exactly: 15 digits for each count, 38 for products."""
    big = lambda c: f"cast({c} as decimal(15,0))"
    return F.expr(f"(cast(1000000 as decimal(7,0)) * ({big(a)} * {big(a)})) div ({big(l)} * {big(r)})").cast("bigint")


def phrases(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    max_words: int = 3,
    min_count: int = 10,
    percent: int = 50,
    top: int = 2000,
    budget: int = BUDGET,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two to ``max_words``
    words by score, then by count, then in byte order.

    A-Z are lowered, texts are cut into pieces at ``.,;:!?`` and line ends, pieces into words at spaces
    and tabs. ``n`` is the number of words of the language, ``a`` that of the phrase's occurrences
    within pieces, overlaps included. A cut after the first k words gives l and r, the counts of both
    parts, and the score floor(1000000 a a / (l r)); the cut of the lowest score counts, of equals the
    first. Phrases of fewer than ``min_count`` occurrences are left out, and those inside a longer one
    that has ``percent`` of their occurrences or more, whether that is left out itself or not.

    A null language is ``und``. Null and empty texts have no words; repeated rows count each; an empty
    table gives no rows. Other columns are not read. Words are told apart by 64-bit hashes: two
    frequent words of one hash raise an error.
    """
    docs = docs.select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    vocabulary, nodes = count_phrases(docs, max_words, min_count, budget)
    candidates = nodes.where(F.size("path") > 1).select("path", F.col("n").alias("a"))
    # Every cut with the counts of its parts.
    cuts = candidates.select("path", "a", F.explode(F.sequence(F.lit(1), F.size("path") - 1)).alias("k"))
    cuts = cuts.withColumns({"head": F.slice("path", F.lit(1), F.col("k")), "tail": F.slice("path", F.col("k") + 1, F.size("path") - F.col("k"))})
    part = lambda name, count: nodes.select(F.col("path").alias(name), F.col("n").alias(count))
    cuts = cuts.join(part("head", "l"), "head").join(part("tail", "r"), "tail")
    cuts = cuts.select("path", "a", F.struct(_score("a", "l", "r").alias("score"), "k", "l", "r").alias("cut"))
    scored = cuts.groupBy("path", "a").agg(F.min("cut").alias("cut"))
    # What longer phrases hold.
    if max_words > 2:
        longer = candidates.where(F.size("path") > 2)
        spans = F.flatten(
            F.transform(
                F.sequence(F.lit(2), F.size("path") - 1),
                lambda m: F.transform(F.sequence(F.lit(1), F.size("path") - m + 1), lambda i: F.slice("path", i, m)),
            )
        )
        inside = longer.select(F.explode(spans).alias("path"), F.col("a").alias("longer")).groupBy("path").agg(F.max("longer").alias("longer"))
        scored = scored.join(inside, "path", "left")
        scored = scored.where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * percent)).drop("longer")
    spelled = scored.select("path", "a", "cut", F.posexplode("path").alias("at", "key"))
    spelled = spelled.join(vocabulary.where(F.col("n") >= min_count).select("key", "lang", "word"), "key")
    named = spelled.groupBy("path", "a", "cut").agg(
        F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("at", "word"))).alias("words")
    )
    named = named.select("lang", F.array_join(F.col("words.word"), " ").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    # The best of each share of a language come before the best of all.
    shares = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    named = named.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(shares)))
    best = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = vocabulary.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
