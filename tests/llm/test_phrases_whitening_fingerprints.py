"""Phrase mining, whitening and Lempel-Ziv fingerprints against plain versions."""

import hashlib
import math
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from corpus_helpers import CLASHING, EXTRA, LONG, lower, no_documents, odd_documents
from pyspark.sql import functions as F

from gridtally.llm import lempel_ziv, phrases, whitening


# Phrases ---------------------------------------------------------------------------------------------


def plain_phrases(rows, max_words, min_count, percent, top):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for m in range(1, max_words + 1):
                for i in range(len(words) - m + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + m])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        rows = []
        for p, a in candidates.items():
            longer = [
                b for q, b in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            ]
            if any(100 * b >= percent * a for b in longer):
                continue
            cuts = [(math.floor(Fraction(10**6 * a * a, f[p[:k]] * f[p[k:]])), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            score, _, l, r = min(cuts)  # noqa: E741
            rows.append((score, a, " ".join(p), l, r))
        rows.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, x[2], x[1], x[3], x[4], totals[lang], x[0]) for i, x in enumerate(rows[:top])]
    return sorted(out)


def mined(df, **options):
    return sorted(map(tuple, phrases.phrases(df, **options).collect()))


@pytest.mark.parametrize("budget,max_words,top", [(phrases.BUDGET, 3, 2000), (64, 3, 2000), (64, 4, 7), (64, 2, 2000)])
def test_phrases_equal_counting_all_windows(spark, budget, max_words, top):
    """With the small budget, words and word pairs are heavy and the groups are many."""
    rng = np.random.default_rng(5)
    words = ["the", "of", "a", "x", "Ünder", "Big", "bang", "Q"]
    texts = []
    for _ in range(60):
        some = rng.choice(words, size=rng.integers(0, 80), p=[0.4, 0.2, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05])
        texts.append("".join(w + str(rng.choice([" ", "  ", "\t", ", ", ".", "\n", " "], p=[0.7, 0.05, 0.05, 0.05, 0.05, 0.05, 0.05])) for w in some))
    rows = [([None, "en", "und", "fr"][i % 4], t) for i, t in enumerate(texts)] + [("en", None), (None, ""), ("xx", "  "), ("en", texts[1]), ("en", texts[1])]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    want = plain_phrases(rows, max_words, 3, 50, top)
    assert want and mined(df, max_words=max_words, min_count=3, top=top, budget=budget) == want


def test_phrases_of_odd_documents(spark):
    df = odd_documents(spark).withColumn("lang", F.lit("de"))
    rows = [("de", r["text"]) for r in df.collect()]
    assert mined(df) == plain_phrases(rows, 3, 10, 50, 2000) != []
    assert mined(no_documents(spark).withColumn("lang", F.lit("de"))) == []


def test_scores_are_exact_beyond_64_bits(spark):
    a, l, r = 10**14 - 3, 10**14, 10**14 + 7  # noqa: E741
    df = spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(phrases._score("a", "l", "r"))
    assert df.first()[0] == 10**6 * a * a // (l * r)


# Whitening -------------------------------------------------------------------------------------------


def test_rank_one_updates_equal_a_direct_eigendecomposition():
    rng = np.random.default_rng(1)
    x = rng.integers(-60, 60, (3, 70, 6)).astype(float)
    x[1, :, 5] = x[1, :, 4]  # equal columns: an eigenvalue 0
    x[2] = x[2, 0]  # one vector only
    held = whitening.Spectra.empty(3, 6)
    for i in range(70):
        held.add(x[:, i], np.array([True, True, i < 30]))
    one = held.one()
    for lane, rows in enumerate([x[0], x[1], x[2, :30]]):
        off = rows - rows.mean(axis=0)
        want = np.linalg.eigvalsh(off.T @ off)[::-1]
        assert np.allclose(held.values[lane], want, atol=1e-5 * max(want[0], 1))
        assert np.allclose(held.vectors[lane].T @ held.vectors[lane], np.eye(6), atol=1e-10)
    every = np.concatenate([x[0], x[1], x[2, :30]])
    off = every - every.mean(axis=0)
    want = np.linalg.eigvalsh(off.T @ off)[::-1]
    assert np.allclose(one.values[0], want, atol=1e-5 * want[0]) and np.allclose(one.mean[0], every.mean(axis=0))


def plain_whitening(vectors, k=4):
    x = np.unique(np.floor(256 * np.asarray(vectors, float)).astype(np.int64), axis=0)
    n, s = len(x), x.sum(axis=0)
    off = x - s / n
    values, u = np.linalg.eigh(off.T @ off / n)
    return n, s, values[::-1][:k], u[:, ::-1][:, :k], values.sum()


def check_whitening(got, vectors, ids):
    n, s, values, u, trace = plain_whitening(vectors)
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    x = np.floor(256 * np.asarray(vectors, float)).astype(np.int64)
    want = (x - s / n) @ u / np.sqrt(values)
    signs = [np.sign(by[ids[0]][c + 1]["whitened"] * want[0, c]) for c in range(len(values))]
    for i, id_ in enumerate(ids):
        for c in range(len(values)):
            r = by[id_][c + 1]
            assert r["whitened"] == pytest.approx(signs[c] * want[i, c], abs=1e-8)
            assert r["explained"] == pytest.approx(values[c] / trace, rel=1e-10)
            assert r["n"] == n and r["identity_error"] < 1e-9
            assert int(r["deviation"]) == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[i], s))


@pytest.mark.parametrize("dim,tracked", [(24, 6), (8, 16), (3, 16)])
def test_whitening_equals_numpy(spark, dim, tracked):
    """With few tracked pairs the refinement has to widen its basis."""
    rng = np.random.default_rng(dim)
    v = rng.normal(size=(400, dim)) * (1 + np.arange(dim) % 5)
    v = np.concatenate([v, v[:50], np.repeat(v[:1], 100, axis=0)])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>").repartition(5)
    got = whitening.whiten(df, tracked=tracked).collect()
    assert len(got) == len(v) * min(4, dim)
    check_whitening(got, v, list(range(len(v))))


def test_spectra_of_many_tasks_meet_in_levels(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 3)
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(600, 5)) * [50, 40, 30, 20, 10]).astype(int)
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>").repartition(11)
    u = whitening.leading_basis(df, 5)
    off = x - x.mean(axis=0)
    want = np.linalg.eigh(off.T @ off)[1][:, ::-1]
    assert np.allclose(np.abs((u * want).sum(axis=0)), 1, atol=1e-6)


def test_whitening_of_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [0.5, 0.25]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 0.0]), (6, [-0.5, 0.75]), (6, [-0.5, 0.75])]
    rows += [(7, [1.0, -1.0]), (None, [0.0, 0.125]), (8, []), (9, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([r + EXTRA for r in rows], "vec_id long, embedding array<double>, " + CLASHING)
    got = whitening.whiten(df).collect()
    two = [r for r in got if r["vec_id"] in (1, 6, 7, None)]
    assert Counter(r["vec_id"] for r in got) == {1: 2, 6: 4, 7: 2, None: 2, 9: 3}
    keep = [r for r in rows if r[0] in (1, 6, 7, None)]
    check_whitening(two, [r[1] for r in keep], [r[0] for r in keep])
    alone = [r for r in got if r["vec_id"] == 9]  # a single distinct vector has no variance
    assert all((r["n"], r["whitened"], r["explained"], r["identity_error"], int(r["deviation"])) == (1, None, None, None, 0) for r in alone)
    assert whitening.whiten(df.where("vec_id > 99")).count() == 0


# Fingerprints ----------------------------------------------------------------------------------------


def plain_parse(text):
    """The phrases by looking every prefix up in a set."""
    data, seen, start = (text or "").encode(), set(), 0
    for end in range(1, len(data) + 1):
        if data[start:end] not in seen:
            seen.add(data[start:end])
            start = end
    return seen


def test_phrases_and_hashes_of_a_parse():
    texts = ["", "a", "aaaaaaaaaaaaaaaa", "abababababab", LONG[:3000], "ümläut ümläut", "abc" * 50]
    sets = [plain_parse(t) for t in texts]
    tries = [lempel_ziv._keys(lempel_ziv._trie(t.encode())) for t in texts]
    assert [len(t) for t in tries] == [len(s) for s in sets]
    h = lempel_ziv.phrase_hashes(tries)
    cut = np.cumsum([0, *map(len, tries)])
    hashes = [set(h[a:b].tolist()) for a, b in zip(cut[:-1], cut[1:])]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(hashes[i] & hashes[j]) == len(sets[i] & sets[j])


def test_likeness_estimates_the_similarity_of_phrase_sets(spark):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(400)]
    text = lambda: " ".join(rng.choice(words, 700))
    pairs = []
    for share in (0.0, 0.3, 0.6, 0.9, 1.0):
        for _ in range(8):
            a = text()
            pairs.append((a, a[: int(share * len(a))] + text()[int(share * len(a)) :]))
    sides = lempel_ziv.fingerprints(spark.createDataFrame([(i, s, t) for i, p in enumerate(pairs) for s, t in enumerate(p)], "i int, s int, text string"))
    a, b = (sides.where(f"s = {s}").select("i", F.col("lz_fingerprint").alias(n)) for s, n in ((0, "a"), (1, "b")))
    got = dict(a.join(b, "i").select("i", lempel_ziv.likeness("a", "b")).collect())
    for i, (x, y) in enumerate(pairs):
        p, q = plain_parse(x), plain_parse(y)
        assert got[i] == pytest.approx(len(p & q) / len(p | q), abs=0.17)
    errors = [got[i] - len(plain_parse(x) & plain_parse(y)) / len(plain_parse(x) | plain_parse(y)) for i, (x, y) in enumerate(pairs)]
    assert abs(np.mean(errors)) < 0.03


def plain_compare(rows):
    """Sorted (id, n_chars, digest of the edited text, next text) of (id, text) rows."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for i, (id_, text) in enumerate(order):
        t, nxt = text or "", order[(i + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        out.append((id_, len(t), hashlib.sha256(edited.encode()).hexdigest(), t, edited, nxt))
    return out


@pytest.mark.parametrize("task_bytes", [lempel_ziv.TASK_BYTES, 300])
def test_edited_texts_and_fingerprints(spark, monkeypatch, task_bytes):
    monkeypatch.setattr(lempel_ziv, "LEAST_TASK_BYTES", min(task_bytes, lempel_ziv.LEAST_TASK_BYTES))
    rng = np.random.default_rng(4)
    rows = [(int(i), " ".join(rng.choice(["ein", "zwei", "drei", "vier", "fünf", "😀", "sechs"], rng.integers(0, 60)))) for i in rng.permutation(90)]
    rows += [(200, None), (201, ""), (202, LONG), (-5, "minus five"), (300, rows[0][1]), (301, rows[0][1])]
    df = spark.createDataFrame([r + EXTRA for r in rows], "doc_id long, text string, " + CLASHING).repartition(4)
    got = {r["doc_id"]: r for r in lempel_ziv.compare_edited(df, task_bytes=task_bytes).collect()}
    assert len(got) == len(rows)
    texts = {}
    for id_, n, digest, text, edited, nxt in plain_compare(rows):
        r = got[id_]
        assert (r["n_chars"], r["edited_sha256"]) == (n, digest)
        assert texts.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        for value, other in ((r["near_edited"], edited), (r["near_next"], nxt)):
            p, q = plain_parse(text), plain_parse(other)
            assert value == pytest.approx(len(p & q) / len(p | q) if p | q else 1.0, abs=0.25)
        assert texts.setdefault(edited, r["edited_fingerprint"]) == r["edited_fingerprint"]
    assert got[200]["fingerprint"] == got[201]["fingerprint"] and got[300]["near_next"] <= 1.0 == got[301]["near_next"]


def test_fingerprints_of_odd_documents(spark):
    df = odd_documents(spark)
    rows = lempel_ziv.compare_edited(df).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in df.collect())
    prints = lempel_ziv.fingerprints(df)
    assert prints.columns == [*df.columns, "lz_phrases", "lz_fingerprint"] and prints.count() == df.count()
    assert {(r["text"] or ""): r["lz_phrases"] for r in prints.collect()} == {(r["text"] or ""): len(plain_parse(r["text"])) for r in df.collect()}
    one = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")
    only = lempel_ziv.compare_edited(one).first()
    assert (only["near_next"], only["edited_sha256"]) == (1.0, hashlib.sha256(b"abcabc").hexdigest())
    assert lempel_ziv.compare_edited(no_documents(spark)).count() == 0
    again = spark.createDataFrame([(7, "same text")] * 3 + [(7, None)], "doc_id long, text string")
    assert sorted(r["near_next"] for r in lempel_ziv.compare_edited(again).collect()) == [0.0, 0.0, 1.0, 1.0]
