"""Near copies by MinHash bands, odd sketches and exact confirmation.

1.  Every text becomes its set of word shingles, a MinHash sample, the sample's band keys, and an
    odd sketch: a bitmap in which each sample value flips one bit, so that the ones of the XOR of
    two sketches tell how many samples differ. Texts with equal sets are one class.
2.  Classes that share a band meet in blocks of that band's bucket. A pair passes when its XOR has
    no more ones than a linked pair has but for one in a thousand million. Of the passing pairs a
    block returns only a forest, so links never outnumber rows.
3.  Components of these links are candidate groups; a true link never crosses two of them.
4.  The texts of each group meet in blocks, and pairs are confirmed on their full sets. Only pairs
    that share one of their rarest shingles can be similar enough, which an index of these
    prefixes finds; pairs already connected in the block are left out. Again a forest is returned.
5.  Components of the confirmed links are the answer.

Buckets and groups larger than a block are cut into blocks by hash, and each pair of blocks is a
unit of its own: no task holds a whole group, no pair of texts is left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import settle
from .bits import bitmap, marked
from .linked import components
from .words import SPACED, U64, distinct, groups, mix, pieces, put_back, set_aside, shingles, signed, words

#: Samples to a band. More make band keys rarer among dissimilar texts; fewer need fewer bands.
BAND_ROWS = 5
#: Chance that a pair at the threshold shares no band.
MISS = 1e-7
SKETCH_WORDS = 8
#: Rows of one bucket block, and shingles of one group block.
BUCKET_BLOCK = 1024
GROUP_BLOCK = 1 << 17


def bands_for(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** BAND_ROWS)))


def flips_allowed(percent: int, samples: int) -> int:
    """Ones in the XOR of two sketches that a pair at the threshold stays within: twice the number
    of differing samples that is passed with a probability under 1e-9 (binomial tail)."""
    p, tail, k = 1 - percent / 100, 0.0, samples
    while k > 0:
        term = math.comb(samples, k) * p**k * (1 - p) ** (samples - k)
        if tail + term > 1e-9:
            break
        tail, k = tail + term, k - 1
    return 2 * k


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
    return seeds[:n], seeds[n:] | U64(1)


def sample(sets: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """``n`` MinHash values of every set (rows); a set without shingles has all ones."""
    some = np.flatnonzero(np.diff(at))
    out = np.full((len(at) - 1, n), ~U64(0))
    if len(some):
        for i, (x, a) in enumerate(zip(*_constants(n))):
            out[some, i] = np.minimum.reduceat((sets ^ x) * a, at[:-1][some])
    return out


def odd_sketch(values: np.ndarray) -> np.ndarray:
    """Parity bitmaps of SKETCH_WORDS 64-bit words: sample i with value v flips bit hash(i, v)."""
    bits = 64 * SKETCH_WORDS
    place = mix(values + np.arange(values.shape[1], dtype=U64) * U64(0x9E3779B97F4A7C15)) % U64(bits)
    flat = (place + np.arange(len(values), dtype=U64)[:, None] * U64(bits)).astype(np.int64).ravel()
    odd = (np.bincount(flat, minlength=len(values) * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(-1, bits), axis=1).view(U64)


def band_keys(values: np.ndarray) -> np.ndarray:
    n = values.shape[1] // BAND_ROWS
    out = np.empty((len(values), n), U64)
    for b in range(n):
        h = np.full(len(values), b, U64)
        for r in range(BAND_ROWS):
            h = mix(h * U64(0x9E3779B97F4A7C15) + values[:, b * BAND_ROWS + r])
        out[:, b] = h
    return out


def signatures(docs: DataFrame, key: str, text: str, shingle: int, percent: int) -> DataFrame:
    """(key, th, n, h1, h2, bands, sketch) of every document; th is the text's hash, n, h1 and h2
    name the set."""
    n_bands = bands_for(percent)

    def run(batches):
        for part in pieces(batches, "text"):
            h, doc = shingles(words(part.column("text"), SPACED), shingle)
            sets, at = distinct(h, doc, part.num_rows)
            sums = [np.concatenate([[U64(0)], np.cumsum(mix(sets + U64(i)), dtype=U64)]) for i in (1, 2)]
            values = sample(sets, at, n_bands * BAND_ROWS)
            n = np.diff(at)
            keys = band_keys(values)[n > 0].ravel()
            ends = np.concatenate([[0], np.cumsum((n > 0) * n_bands)])
            sketch = odd_sketch(values)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("key"),
                    part.column("th"),
                    pa.array(n, pa.int64()),
                    *[pa.array(signed(s[at[1:]] - s[at[:-1]]), pa.int64()) for s in sums],
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(signed(keys), pa.int64())),
                    pa.array([row.tobytes() for row in sketch], pa.binary()),
                ],
                names=["key", "th", "n", "h1", "h2", "bands", "sketch"],
            )

    rows = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "key bigint, th bigint, n bigint, h1 bigint, h2 bigint, bands array<bigint>, sketch binary")


class Forest:
    """Union-find over row numbers."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return int(x)

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


def _in_blocks(rows: DataFrame, group: str, size: str, limit: int, id_: str, count: str) -> DataFrame:
    """Repeat each row for every pair of blocks that it takes part in; ``i`` < ``j`` are the blocks,
    ``mine`` the row's own. A group has a block for each ``limit`` of its size, but no more than rows;
    one within the limit is block 0 alone. Rows of one block meet in the pairs of neighbours."""
    blocks = F.least(F.ceil(F.col(size) / F.lit(limit)), F.col(count)).cast("int")
    own = F.pmod(F.xxhash64(F.col(id_), F.lit(7)), blocks).cast("int")
    others = F.filter(F.sequence(F.lit(0), blocks - 1), lambda b: (b != F.col("mine")) | (blocks == 1))
    rows = rows.withColumn("mine", own).withColumn("other", F.explode(others))
    rows = rows.withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")}).drop("other", *{size, count})
    return rows.repartition(F.col(group), F.col("i"), F.col("j")).sortWithinPartitions(group, "i", "j")


def _forest_of_sketches(batches, allowed: int):
    a, b = [], []
    for rows in groups(batches, "band", "i", "j"):
        n = rows.num_rows
        ids = rows.column("key").to_numpy()
        sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), U64).reshape(n, SKETCH_WORDS)
        left = np.ones(n, bool)
        # Breadth first: what a row passes with joins its tree, and is compared with the rest only.
        while left.any():
            ahead = [int(np.argmax(left))]
            left[ahead[0]] = False
            while ahead:
                x = ahead.pop()
                rest = np.flatnonzero(left)
                if not len(rest):
                    break
                near = rest[np.bitwise_count(sketch[rest] ^ sketch[x]).sum(axis=1) <= allowed]
                left[near] = False
                a += [ids[x]] * len(near)
                b += ids[near].tolist()
                ahead += near.tolist()
        if len(a) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            a, b = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def candidate_links(classes: DataFrame, percent: int) -> DataFrame:
    """(a, b): a forest, per bucket block, of classes that share a band and pass the sketch test."""
    bands = classes.select("key", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    rows = bands.join(shared, "band").join(classes.select("key", "sketch"), "key")
    allowed = flips_allowed(percent, bands_for(percent) * BAND_ROWS)
    met = _in_blocks(rows, "band", "size", BUCKET_BLOCK, "key", "size")
    return met.select("band", "i", "j", "key", "sketch").mapInArrow(lambda it: _forest_of_sketches(it, allowed), "a bigint, b bigint")


def similar(sets: np.ndarray, at: np.ndarray, percent: int, side: np.ndarray | None = None):
    """Pairs of sets with 100 * intersection >= percent * union, as a forest: pairs that earlier
    ones connect are left out. ``side``: only pairs of a 0 and a 1, if there are both.

    A set is looked up by the shingles of its prefix, rarest first, long enough that two similar
    sets share one of it."""
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n)), n)
    _, token, df = np.unique(sets, return_inverse=True, return_counts=True)
    order = np.lexsort((token, df[token], doc))
    token = token[order]
    prefix = n - -(-percent * n // 100) + 1
    inside = np.arange(len(doc)) - at[:-1][doc] < prefix[doc]
    ptoken, pdoc = token[inside], doc[inside]
    once = np.bincount(ptoken, minlength=len(df))[ptoken] > 1
    ptoken, pdoc = ptoken[once], pdoc[once]
    by = np.argsort(ptoken, kind="stable")
    listed, cut = pdoc[by], np.concatenate([[0], np.cumsum(np.bincount(ptoken, minlength=len(df)))])
    pcut = np.searchsorted(pdoc, np.arange(len(n) + 1))
    tree, out = Forest(len(n)), []
    label = np.arange(len(n))
    for x in np.argsort(-(pcut[1:] - pcut[:-1]), kind="stable").tolist():
        mine = ptoken[pcut[x] : pcut[x + 1]]
        if not len(mine):
            break
        met = np.unique(np.concatenate([listed[cut[t] : cut[t + 1]] for t in mine.tolist()]))
        met = met[(label[met] != label[x]) & (100 * np.minimum(n[met], n[x]) >= percent * np.maximum(n[met], n[x]))]
        if side is not None:
            met = met[side[met] != side[x]]
        if not len(met):
            continue
        own = token[at[x] : at[x + 1]]
        spans = np.repeat(at[met] - (np.cumsum(n[met]) - n[met]), n[met]) + np.arange(n[met].sum())
        has = np.zeros(len(df), bool) if len(met) > 8 else None
        if has is not None:
            has[own] = True
            hit = has[token[spans]]
        else:
            hit = np.isin(token[spans], own)
        both = np.add.reduceat(hit.astype(np.int64), np.cumsum(n[met]) - n[met])
        linked = met[100 * both >= percent * (n[met] + n[x] - both)]
        for y in linked.tolist():
            if tree.join(x, y):
                out.append((x, y))
        if len(linked):
            touched = np.unique(label[np.append(linked, x)])
            label[np.isin(label, touched)] = touched[0]
    return out


def _confirmed(batches, shingle: int, percent: int):
    a, b = [], []
    for rows in groups(batches, "component", "i", "j"):
        ids = rows.column("key").to_numpy()
        h, doc = shingles(words(rows.column("text"), SPACED), shingle)
        sets, at = distinct(h, doc, rows.num_rows)
        mine = rows.column("mine").to_numpy()
        i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        for x, y in similar(sets, at, percent, None if j - i <= 1 else (mine == j).astype(np.int8)):
            a.append(ids[x])
            b.append(ids[y])
        if len(a) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            a, b = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: the key, ``n_shingles``, ``component_id`` and ``kept``.

    A document's set holds its distinct runs of ``shingle`` words (all its words if it has fewer);
    two documents are linked when 100 * intersection >= ``percent`` * union. ``component_id`` is the
    smallest key that links reach, ``kept`` is true for the document of that key. Words are runs of
    bytes other than white space with A-Z lowered.

    Null and empty texts have no set, are linked with nothing and kept. Rows that repeat a key each
    get a row; texts of one key count as linked. A null key is never kept and names no component:
    its row has the component of the keys whose text has the same set, null if there are none.
    Work on a candidate group grows with the square of its number of blocks; two texts, of any length,
    are two rows.
    """
    sigs = settle(signatures(docs, key, text, shingle, percent))
    name = ["n", "h1", "h2"]
    classes = sigs.where((F.col("n") > 0) & F.col("key").isNotNull()).groupBy(*name)
    classes = settle(classes.agg(F.min(F.struct("key", "th")).alias("least")).select(*name, "least.key", "least.th"))
    full = settle(sigs.join(classes, ["key", "th", *name]).select("key", "bands", "sketch"))
    group = settle(components(candidate_links(full, percent)))
    members = group.join(classes.select(F.col("key").alias("node"), "th", "n"), "node")
    sizes = members.groupBy("component").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("texts"))
    members = settle(members.join(sizes, "component"))
    texts = docs.select(F.col(key).cast("long").alias("node"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    # Only the texts of candidates are shuffled.
    texts = marked(texts, "node", settle(bitmap(members, "node")), "wanted").where("wanted")
    rows = members.join(texts, ["node", "th"]).select("component", "size", "texts", F.col("node").alias("key"), "text")
    met = _in_blocks(rows, "component", "size", GROUP_BLOCK, "key", "texts")
    confirmed = met.select("component", "i", "j", "mine", "key", "text").mapInArrow(
        lambda it: _confirmed(it, shingle, percent), "a bigint, b bigint"
    )
    final = components(confirmed).select(F.col("node").alias("least"), "component")
    named = classes.select(*name, F.col("key").alias("least")).join(final, "least", "left")
    named = settle(named.select(*name, F.coalesce("component", "least").alias("component_id")))
    component = F.coalesce("component_id", F.when(F.col("n") == 0, F.col("key")))
    return (
        sigs.select("key", *name)
        .join(named, name, "left")
        .select(
            F.col("key").alias(key),
            F.col("n").alias("n_shingles"),
            component.alias("component_id"),
            F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"),
        )
    )


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The document of the smallest key of each group, and all documents without a group."""
    found = near_copies(docs, key, text, shingle, percent)
    gone = settle(found.where(~F.col("kept") & F.col(key).isNotNull()).select(F.col(key).alias("gone")).distinct())
    rows, names = set_aside(docs)
    own = next(n for n, c in names.items() if c == key)
    # Documents that no bit of the bitmap marks are not shuffled.
    rows = marked(rows, own, settle(bitmap(gone, "gone")), "asked")
    sure = rows.where(~F.col("asked"))
    asked = rows.where("asked")
    return put_back(sure.unionByName(asked.join(gone, asked[own].cast("long") == gone["gone"], "left_anti")), names)
