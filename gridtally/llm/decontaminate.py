"""Benchmark decontamination with suffix arrays of the training text.

Each shard of documents (a bounded slice of a partition) becomes a suffix array over its words.
Every suffix of every benchmark item is looked up in it by binary search, which gives the longest
verbatim match and, for matches of at least one window, all places. Documents are never shuffled.

Only words that the benchmark has can take part in a match, so all others are one sentinel that
equals nothing, and no suffix of the array starts with it. The array is sorted as deep as the
longest benchmark item, which is as deep as any comparison goes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import ALNUM, pieces, put_back, row_schema, set_aside, words

WINDOW = 10
#: Bytes of benchmark text in one block. Blocks are searched one after the other.
BLOCK_BYTES = 8 << 20
#: Bytes of text in one shard. A longer document is a shard of its own.
SHARD_BYTES = 4 << 20


@dataclass
class Probe:
    """A block of benchmark items: word ids 1.. of all items in a row, each item closed by -1."""

    vocabulary: np.ndarray
    ids: np.ndarray
    item: np.ndarray
    left: np.ndarray
    need: np.ndarray
    names: list[str]
    window: int

    @classmethod
    def build(cls, names: list, texts: list, window: int) -> Probe:
        w = words(pa.array(texts, pa.large_string()), ALNUM)
        vocabulary, ids = np.unique(w.hash, return_inverse=True)
        count = np.diff(w.first)
        item = np.repeat(np.arange(len(count)), count)
        left = w.first[1:][item] - np.arange(len(ids))
        return cls(vocabulary, ids + 1, item, left, np.minimum(count, window)[item], [str(x) for x in names], window)

    @property
    def deepest(self) -> int:
        return int(self.left.max(initial=0))


def suffix_array(ids: np.ndarray, deepest: int) -> np.ndarray:
    """Places whose id is above 0, sorted by the ids from there up to the first 0 or ``deepest`` ids.

    Prefix doubling: a place's rank by h ids and that of the place h further on give its rank by 2h.
    """
    n = len(ids)
    rank = np.zeros(2 * n + 1, np.int64)
    at = np.flatnonzero(ids)
    rank[at] = ids[at]
    bits = max(int(n).bit_length(), int(ids.max(initial=0)).bit_length())
    at = at[np.argsort(rank[at], kind="stable")]
    h = 1
    while h < deepest and len(at):
        key = (rank[at] << bits) | rank[np.minimum(at + h, 2 * n)]
        order = np.argsort(key)
        at, key = at[order], key[order]
        new = np.ones(len(at), np.int64)
        new[1:] = key[1:] != key[:-1]
        rank[at] = np.cumsum(new)
        if new.all():
            break
        h *= 2
    return at


def _compare(ids: np.ndarray, at: np.ndarray, probe: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Sign of (shard suffix - probe suffix) over ``length`` ids."""
    sign = np.zeros(len(at), np.int64)
    open_ = np.arange(len(at))
    for k in range(int(length.max(initial=0))):
        open_ = open_[length[open_] > k]
        if not len(open_):
            break
        d = ids[np.minimum(at[open_] + k, len(ids) - 1)] - probe[start[open_] + k]
        differs = d != 0
        sign[open_[differs]] = d[differs]
        open_ = open_[~differs]
    return sign


def _bound(ids, array, probe, start, length, upper: bool) -> np.ndarray:
    lo, hi = np.zeros(len(start), np.int64), np.full(len(start), len(array), np.int64)
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_]) // 2
        s = _compare(ids, array[mid], probe, start[open_], length[open_])
        right = s <= 0 if upper else s < 0
        lo[open_[right]] = mid[right] + 1
        hi[open_[~right]] = mid[~right]
    return lo


def common(ids: np.ndarray, at: np.ndarray, probe: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """How many ids agree from ``at`` and ``start`` on, at most ``length``."""
    out = np.zeros(len(at), np.int64)
    open_ = np.arange(len(at))
    for k in range(int(length.max(initial=0))):
        open_ = open_[length[open_] > k]
        if not len(open_):
            break
        open_ = open_[ids[np.minimum(at[open_] + k, len(ids) - 1)] == probe[start[open_] + k]]
        out[open_] = k + 1
    return out


def longest_matches(ids: np.ndarray, array: np.ndarray, p: Probe) -> tuple[np.ndarray, np.ndarray]:
    """For each probe suffix the length of its longest match in the shard and a place of it."""
    start = np.arange(len(p.ids))
    if not len(array):
        return np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    here = _bound(ids, array, p.ids, start, p.left, upper=False)
    best, place = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    for near in (here - 1, here):
        ok = (near >= 0) & (near < len(array))
        at = array[np.clip(near, 0, len(array) - 1)]
        got = np.where(ok, common(ids, at, p.ids, start, p.left), 0)
        place = np.where(got > best, at, place)
        best = np.maximum(best, got)
    return best, place


def _search(p: Probe, part: pa.RecordBatch, text: str):
    """Per document of a part: words, hit words as packed bits, numbers of items found, and the
    longest match (words, item, first word in the document)."""
    w = words(part.column(text), ALNUM)
    count = np.diff(w.first)
    closed = w.first[:-1] + np.arange(len(count))  # a 0 stands between two documents
    ids = np.zeros(len(w) + len(count) + 1, np.int64)
    if len(p.vocabulary) and len(w):
        found = np.minimum(np.searchsorted(p.vocabulary, w.hash), len(p.vocabulary) - 1)
        ids[np.arange(len(w)) + w.doc] = np.where(p.vocabulary[found] == w.hash, found + 1, 0)
    array = suffix_array(ids, p.deepest)
    best = longest_matches(ids, array, p)[0]
    doc_of = lambda at: np.searchsorted(closed, at, side="right") - 1
    edge = np.zeros(len(ids) + 1, np.int64)
    long_ = np.flatnonzero((best >= p.need) & (p.left >= p.need))
    pair_doc, pair_item = np.zeros(0, np.int64), np.zeros(0, np.int64)
    top = [(0, None, None)] * len(count)
    if len(long_):
        lo = _bound(ids, array, p.ids, long_, p.need[long_], upper=False)
        hi = _bound(ids, array, p.ids, long_, p.need[long_], upper=True)
        docs, items, places, suffixes = [], [], [], []
        # Equal windows share one range of the array: its places are visited once for all of them.
        ranges, same = np.unique(np.stack([lo, hi, p.need[long_]]), axis=1, return_inverse=True)
        same = same.reshape(-1)
        by = np.argsort(same, kind="stable")
        cut = np.searchsorted(same[by], np.arange(ranges.shape[1] + 1))
        for r in range(ranges.shape[1]):
            at = array[ranges[0, r] : ranges[1, r]]
            edge[at] += 1
            edge[at + ranges[2, r]] -= 1
            equal = long_[by[cut[r] : cut[r + 1]]]
            own = np.unique(p.item[equal])
            places.append(np.repeat(at, len(equal)))
            suffixes.append(np.tile(equal, len(at)))
            inside = np.unique(doc_of(at))
            docs.append(np.repeat(inside, len(own)))
            items.append(np.tile(own, len(inside)))
        pairs = np.unique(np.stack([np.concatenate(docs), np.concatenate(items)]), axis=1)
        pair_doc, pair_item = pairs
        at, suffix = np.concatenate(places), np.concatenate(suffixes)
        length, where = common(ids, at, p.ids, suffix, p.left[suffix]), doc_of(at)
        order = np.lexsort((at, p.item[suffix], -length, where))
        for x in order[np.unique(where[order], return_index=True)[1]].tolist():
            d = int(where[x])
            top[d] = (int(length[x]), p.names[p.item[suffix[x]]], int(at[x] - closed[d]))
    covered = np.cumsum(edge[:-1]) > 0
    hit = [np.packbits(covered[closed[d] : closed[d] + count[d]]).tobytes() for d in range(len(count))]
    cut = np.searchsorted(pair_doc, np.arange(len(count) + 1))
    names = [[p.names[i] for i in pair_item[cut[d] : cut[d + 1]].tolist()] for d in range(len(count))]
    return count, hit, names, top


def _blocks(benchmark: DataFrame, item: str, text: str, window: int) -> Iterator[Probe]:
    """Blocks of whole items, each of about BLOCK_BYTES, which is the bound of what is broadcast."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.where(F.col("item").isNotNull())
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // BLOCK_BYTES) or 1
    for b in range(n):
        got = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b).collect() if n > 1 else rows.collect()
        got = sorted(set(map(tuple, got)))
        yield Probe.build([r[0] for r in got], [r[1] for r in got], window)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW
) -> DataFrame:
    """Add to every document what it shares with benchmark items.

    ``leak_words`` (words of the document), ``leak_hits`` (words inside an occurrence of a window),
    ``leak_items`` (ids of the items found, as sorted strings) and ``leak_longest`` (words of the
    longest match, its item, and the word at which it begins; of equals the least item and place).

    A window is ``window`` consecutive words of an item, or the whole item if it has fewer. A null
    or empty text has no words and no hits; items without words or id are no items; a repeated item
    counts once, and equal windows of several items count for each. Repeated documents are searched
    one by one. Documents may be of any length: one longer than a shard is a shard of its own. A
    given column of the name of an added one is replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("leak_words", "leak_bits", "leak_hits", "leak_items", "leak_longest")
    state = ["leak_words bigint", "leak_bits binary", "leak_items array<string>", "leak_longest struct<words:int,item:string,at:int>"]
    schema, columns = row_schema(docs, *state), docs.columns
    out = docs
    for b, probe in enumerate(_blocks(benchmark, item, item_text, window)):
        sent = spark.sparkContext.broadcast(probe)

        def search(batches, sent=sent, first=b == 0):
            for part in pieces(batches, text, SHARD_BYTES):
                count, hit, names, top = _search(sent.value, part, text)
                if not first:
                    was = part.to_pydict()
                    hit = [bytes(x | y for x, y in zip(a, c)) for a, c in zip(was["leak_bits"], hit)]
                    names = [a + c for a, c in zip(was["leak_items"], names)]
                    top = [
                        t if t[1] is not None and (-t[0], t[1], t[2]) < (-a["words"], a["item"] or "", a["at"] or 0) else (a["words"], a["item"], a["at"])
                        for a, t in zip(was["leak_longest"], top)
                    ]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(c) for c in columns],
                        pa.array(count, pa.int64()),
                        pa.array(hit, pa.binary()),
                        pa.array([sorted(set(x)) for x in names], pa.list_(pa.string())),
                        pa.array(
                            [{"words": a, "item": i, "at": s} for a, i, s in top],
                            pa.struct([("words", pa.int32()), ("item", pa.string()), ("at", pa.int32())]),
                        ),
                    ],
                    names=[*columns, "leak_words", "leak_bits", "leak_items", "leak_longest"],
                )

        out = out.mapInArrow(search, schema)

    return out.withColumn("leak_hits", _bits("leak_bits")).drop("leak_bits")


def _bits(name: str) -> Column:
    """Ones of a binary column: the sum over its hex digits."""
    ones = {d: bin(int(d, 16)).count("1") for d in "0123456789ABCDEF"}
    digits = F.translate(F.hex(name), "0123456789ABCDEF", "".join(str(ones[d]) for d in "0123456789ABCDEF"))
    count = F.lit(0)
    for k in range(1, 5):
        count = count + F.lit(k) * (F.length(digits) - F.length(F.replace(digits, F.lit(str(k)), F.lit(""))))
    return count.cast("bigint")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents in which no window of an item occurs, with their columns."""
    rows, names = set_aside(docs)
    own = next(n for n, c in names.items() if c == text)
    return put_back(find_leaks(rows, benchmark, own, **options).where(F.col("leak_hits") == 0), names)

