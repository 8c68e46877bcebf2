"""Near copies against all pairs, and the parts of the method."""

import random

import numpy as np

import __spark_entry__ as entry
from gridtally.llm import near_copies as N
from gridtally.llm.linked import components
from corpus_helpers import groups_by_brute_force, no_documents, odd_documents, shingle_set


def check(spark, rows, shingle, percent):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {k: shingle_set(t, shingle) for k, t in rows}
    root = groups_by_brute_force(sets, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.near_copies(df, shingle=shingle, percent=percent).collect()}
    assert got == {k: (len(sets[k]), root[k], root[k] == k) for k in sets}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return " ".join(out)


def near_groups(n):
    rng = random.Random(3)
    rows, key = [], 0
    for base in range(4):
        words = [f"b{base}x{rng.randrange(60)}" for _ in range(80)]
        for _ in range(n):
            rows.append((key * 3 + 1, edited(rng, words, rng.randrange(6))))
            key += 1
    rng.shuffle(rows)
    return rows


def test_equals_all_pairs_on_documents(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in entry.queries()["op2_odd_sketch_near_copies"](spark, data).collect()}
    sets = {k: shingle_set(t, 3) for k, t in rows}
    root = groups_by_brute_force(sets, 85)
    assert got == {k: (len(sets[k]), root[k], root[k] == k) for k in sets}


def test_groups_around_the_threshold(spark):
    check(spark, near_groups(40), 3, 85)
    check(spark, near_groups(25), 5, 80)


def test_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BUCKET_BLOCK", 7)
    monkeypatch.setattr(N, "GROUP_BLOCK", 900)
    check(spark, near_groups(40), 3, 85)


def test_odd_documents(spark):
    rows = N.near_copies(odd_documents(spark)).collect()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows), key=str)
    assert len(got) == 11
    by = {r[0]: r[1:] for r in got if r[0] is not None}
    assert by[0] == (0, 0, True) and by[1] == (0, 1, True) and by[2] == (0, 2, True)
    assert by[3] == (1, 3, True) and by[4] == (1, 3, False)
    assert [r for r in got if r[0] is None] == [(None, 0, None, False), (None, 1, 3, False)]
    assert sum(r[0] == 6 for r in got) == 2
    assert N.near_copies(no_documents(spark)).count() == 0
    kept = N.drop_near_copies(odd_documents(spark))
    assert kept.columns == odd_documents(spark).columns and kept.count() == 10


def test_sketches_tell_differing_samples():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, (1, 140)).astype(np.uint64)
    b = a.copy()
    b[0, :20] += np.uint64(1)
    ones = int(np.bitwise_count(N.odd_sketch(a) ^ N.odd_sketch(b)).sum())
    assert 28 <= ones <= 40 and not (N.odd_sketch(a) ^ N.odd_sketch(a)).any()
    assert N.flips_allowed(85, 140) < N.flips_allowed(80, 205)


def test_components(spark):
    links = [(5, 4), (4, 3), (9, 8), (3, 1), (7, 7), (None, 2), (8, 9)] + [(i, i + 1) for i in range(100, 160)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8, **{i: 100 for i in range(100, 161)}}
