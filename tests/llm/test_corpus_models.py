"""Severity, pseudo-likelihood, nearest rows, surrogates and the pipeline."""

import math
import os
import random
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridtally.llm import knn, pseudo_likelihood, severity, surrogates
from gridtally.llm.words import words
from corpus_helpers import groups_by_brute_force, no_documents, odd_documents, plain_words, shingle_set

# -------------------------------------------------------------------- severity


def graded(n, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        grade = rng.choice([0, 0, 0, 1, 2])
        w = [f"w{rng.randrange(300)}" for _ in range(40)] + ["rude", "mean"][: grade > 0] + ["vile"] * (grade > 1)
        rng.shuffle(w)
        rows.append((i, " ".join(w), grade))
    return rows


def test_held_out_grades(spark):
    rows = graded(1200)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows[:600]] + [(99999, 1), (None, 1), (5000, None)], "doc_id long, grade int")
    model = severity.fit_severity(docs, labels, "grade", sample_rows=500)
    assert model.grades == 3 and (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in severity.score_severity(docs, model).collect()}
    held = rows[600:]
    assert np.mean([got[k].grade == g for k, _, g in held]) > 0.97
    assert np.mean([(got[k].p_above >= 0.5) == (g > 0) for k, _, g in held]) > 0.98
    assert np.mean([got[k].expected_severity for k, _, g in held if g == 2]) > 1.7


def test_probabilities_and_gradient_agree():
    rng = np.random.default_rng(2)
    doc, feature, grade = rng.integers(0, 60, 300), rng.integers(0, 6, 300), rng.integers(0, 4, 60)
    pairs = np.unique(np.stack([doc, feature]), axis=1)
    w, cuts = severity.fit_thresholds(*pairs, grade, 6, ridge=1.0, steps=3000)

    def objective(w, cuts):
        score = np.bincount(pairs[0], w[pairs[1]], 60)
        over = np.hstack([np.ones((60, 1)), 1 / (1 + np.exp(cuts - score[:, None])), np.zeros((60, 1))])
        return np.log(over[np.arange(60), grade] - over[np.arange(60), grade + 1]).sum() - 0.5 * (w**2).sum()

    best = objective(w, cuts)
    for _ in range(60):
        step = rng.standard_normal(9) * 0.02
        assert objective(w + step[:6], cuts + step[6:]) <= best + 1e-3


def test_severity_without_labels_or_with_one_grade(spark):
    docs = odd_documents(spark)
    none = spark.createDataFrame([], "doc_id long, grade int")
    assert severity.fit_severity(docs, none, "grade") is None
    assert severity.score_severity(docs, None).where("grade is null").count() == 11
    assert severity.drop_severe(docs, None).count() == 11
    for g in (0, 2):
        one = spark.createDataFrame([(3, g), (5, g)], "doc_id long, grade int")
        scored = severity.score_severity(docs, severity.fit_severity(docs, one, "grade"))
        assert {r.grade for r in scored.collect()} == {g}
    assert severity.drop_severe(docs, severity.fit_severity(docs, one, "grade")).columns == docs.columns
    assert severity.score_severity(no_documents(spark), severity.fit_severity(docs, one, "grade")).count() == 0


# ------------------------------------------------------------ pseudo-likelihood


def test_scores_equal_a_plain_loop(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    model = pseudo_likelihood.fit(docs)
    got = {r.doc_id: r for r in pseudo_likelihood.score(docs, model).collect()}
    lex, net = model.lexicon, model.network
    embed, w1, b1, w2, b2, w3, b3 = (x.astype(float) for x in net.parts)
    ids_of = dict(zip(lex.hashes.tolist(), lex.ids.tolist()))
    rows = sorted(docs.where(F.length("text") < 700).collect())[:12]
    for key, text in rows:
        ids = [ids_of.get(h, 0) for h in words(pa.array([text])).hash.tolist()]
        total = 0.0
        for t, i in enumerate(ids):
            around = [ids[t + s] if 0 <= t + s < len(ids) else lex.outside for s in (-2, -1, 1, 2)]
            hidden = np.tanh(np.concatenate([embed[x] for x in around]) @ w1 + b1)
            c, m = divmod(i, pseudo_likelihood.MEMBERS)
            total -= 0.0 if i else lex.rare
            for z, x in ((hidden @ w2 + b2, c), (hidden @ w3[c] + b3[c], m)):
                total += z[x] - np.log(np.exp(z).sum())
        assert got[key].lm_tokens == len(ids) and math.isclose(got[key].lm_log_likelihood, total, rel_tol=1e-4)


def test_gradient_of_the_window_network():
    rng = np.random.default_rng(4)
    lex = pseudo_likelihood.Lexicon.build(np.arange(300, dtype=np.uint64), np.arange(300, 0, -1), 50_000, 500)
    net = pseudo_likelihood.Network(pseudo_likelihood.Network.start(lex).params.astype(np.float64))
    net.params += 0.1 * rng.standard_normal(len(net.params))
    target = rng.integers(0, 300, 40)
    around = np.append(rng.integers(0, 300, (39, 4)), [[lex.outside] * 4], axis=0)
    grad = net.gradient(around, target)
    for at in np.flatnonzero(grad)[:: max(1, np.count_nonzero(grad) // 60)].tolist():
        value = []
        for step in (1e-5, -2e-5):
            net.params[at] += step
            value.append(-net.log_probability(around, target).mean())
        net.params[at] += 1e-5
        assert math.isclose((value[0] - value[1]) / 2e-5, grad[at], rel_tol=1e-2, abs_tol=1e-6)


def test_registered_settings_beat_the_unigram_model_on_held_out_documents(spark, data):
    # The tables next to the small ones: a vocabulary of 4,095 words needs some text.
    docs = spark.read.parquet(f"{os.path.dirname(data)}/sf0.01/documents.parquet").select("doc_id", "text").dropDuplicates(["text"])
    model = pseudo_likelihood.fit(docs.where("doc_id % 5 > 0"), key="doc_id")
    lex, gain, n = model.lexicon, 0.0, 0
    for row in pseudo_likelihood.score(docs.where("doc_id % 5 = 0"), model).collect():
        ids = lex.look_up(words(pa.array([row.text])))
        gain += row.lm_log_likelihood - (lex.unigram[ids] - np.where(ids == 0, lex.rare, 0.0)).sum()
        n += len(ids)
    print(f"held-out gain over the unigram model: {gain / n:.3f} a token, {n} tokens")
    assert gain / n > 0.3


def test_model_does_not_depend_on_the_layout(spark, data, monkeypatch):
    monkeypatch.setattr(pseudo_likelihood, "SHARD_TOKENS", 4096)
    monkeypatch.setattr(pseudo_likelihood, "FAN_IN", 3)
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    one = pseudo_likelihood.fit(docs.coalesce(1), key="doc_id", rounds=1)
    many = pseudo_likelihood.fit(docs.orderBy(F.desc("doc_id")).repartition(8), key="doc_id", rounds=1)
    assert np.array_equal(one.params, many.params) and (one.params != pseudo_likelihood.Network.start(one.lexicon).params).any()


def test_documents_are_dealt_once_and_states_are_floats(spark, data, monkeypatch, tmp_path):
    monkeypatch.setattr(pseudo_likelihood, "SHARD_TOKENS", 4096)
    monkeypatch.setattr(pseudo_likelihood, "FAN_IN", 3)
    made, average, persist = [], pseudo_likelihood._average, type(spark.range(1)).persist
    monkeypatch.setattr(pseudo_likelihood, "_average", lambda s, n: made.append((s.limit(1).first(), n)) or average(s, n))
    kept = []
    monkeypatch.setattr(type(spark.range(1)), "persist", lambda df, level: kept.append(df.columns) or persist(df, level))
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    model = pseudo_likelihood.fit(docs, key="doc_id", rounds=2)
    assert kept == [["place", "ids"]] and [n for _, n in made] == [made[0][1]] * 2 and made[0][1] > 3
    assert all(len(s["state"]) == 2 * 4 * len(model.params) for s, _ in made)


def test_large_exponents_are_shifted():
    lex = pseudo_likelihood.Lexicon.build(np.arange(300, dtype=np.uint64), np.arange(300, 0, -1), 50_000, 500)
    net = pseudo_likelihood.Network.start(lex)
    around, target = np.random.default_rng(3).integers(0, 300, (50, 4)), np.arange(50) * 5
    net.parts[4][:] += 500.0  # all classes alike, so that probabilities stay
    assert not pseudo_likelihood._is_safe(*net.parts[3:5]) and pseudo_likelihood._is_safe(*net.parts[5:])
    moved, grad = net.log_probability(around, target), net.gradient(around, target).copy()
    net.parts[4][:] -= 500.0
    assert moved == pytest.approx(net.log_probability(around, target), abs=1e-3) and np.isfinite(grad).all()
    assert grad == pytest.approx(net.gradient(around, target), abs=1e-3)


def test_training_uses_both_sides_and_all_levels(spark, monkeypatch):
    monkeypatch.setattr(pseudo_likelihood, "FAN_IN", 2)
    rng = random.Random(1)
    # The middle word is told by the word after it only.
    text = lambda: " ".join(f"{'ab'[x]} {'cd'[x]} . ." for x in (rng.randrange(2) for _ in range(60)))
    docs = spark.createDataFrame([(i, text()) for i in range(200)], "doc_id long, text string").repartition(5)
    model = pseudo_likelihood.fit(docs, rounds=25)
    mixed = spark.createDataFrame([(0, "a c . . b d . . a c . . b d . ."), (1, "a d . . b c . . a d . . b c . .")], "doc_id long, text string")
    good, bad = (r.lm_mean for r in pseudo_likelihood.score(mixed, model).orderBy("doc_id").collect())
    assert good > bad + 0.3


def test_likelihood_of_odd_documents(spark):
    docs = odd_documents(spark)
    got = pseudo_likelihood.score(docs, pseudo_likelihood.fit(docs))
    assert got.count() == 11 and set(docs.columns) <= set(got.columns)
    assert {(r.lm_tokens, r.lm_log_likelihood, r.lm_mean) for r in got.where("doc_id < 3").collect()} == {(0, 0.0, None)}
    empty = no_documents(spark)
    assert pseudo_likelihood.score(empty, pseudo_likelihood.fit(empty)).count() == 0


# ---------------------------------------------------------------- nearest rows


def brute_top(rows, k):
    kept = [(n, i, [math.floor(1024 * x) for x in v]) for n, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q in kept:
        if i % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for m, j, v in kept if m != n and len(v) == len(q))[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return sorted(out)


def vectors(n, length=5, seed=1):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) for _ in range(length)]) for i in range(n)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)]
    return rows + [(2000, None), (2100, [1.0, None, 0.0, 0.0, 0.0]), (2200, [float("nan")] * 5), (2300, [float("inf")] * 5), (2400, [1.0, 2.0]), (2401, [0.5, 0.5]), (None, [9.0] * 5), (100, [0.25] * 5)]


@pytest.mark.parametrize("blocks", [(16384, 2048), (16, 2)])
def test_top_k_equals_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(knn, "DATA_BLOCK", blocks[0])
    monkeypatch.setattr(knn, "QUERY_BLOCK", blocks[1])
    rows = vectors(400)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = knn.top_k(df, lambda i: i % 100 == 0, k=10).collect()
    assert sorted(map(tuple, got)) == brute_top(rows, 10)


def test_top_k_of_few_large_and_no_rows(spark):
    rows = [(0, [1e6, -1e6]), (1, [5e5 + 0.001, 1.0]), (2, [5.0, 1e6])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, knn.top_k(df, lambda i: i % 100 == 0).collect())) == brute_top(rows, 10)
    assert knn.top_k(df.limit(0), lambda i: i % 100 == 0).count() == 0


def test_cells_that_cannot_matter_are_left_out():
    pivots, q = np.array([[100.0, 0.0], [-100.0, 0.0]]), np.array([[50, 0]])
    assert knn.needed_cells(q, pivots, np.array([5.0, 5.0]), np.array([20, 20]), 10).tolist() == [[True, False]]
    assert knn.needed_cells(q, pivots, np.array([5.0, 5.0]), np.array([10, 20]), 10).tolist() == [[True, True]]


# ------------------------------------------------------------------ surrogates


def test_surrogates_keep_form_identity_and_difference(spark):
    rows = [
        (1, "Mr. John Smith met Mrs. Smith. Call +1 (988) 555-2485 or 988-555-2485."),
        (2, "SMITH Mr. SMITH, a.b-7@x.org A.B-7@X.ORG card 4111 1111 1111 1111 and 123-45-6789"),
        (3, "Госпожа Анна Иванова, DE89 3704 0044 0532 0130 00, 10.0.0.1."),
    ]
    got = {r.doc_id: r for r in surrogates.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    one, two, three = got[1].text, got[2].text, got[3].text
    name = re.match(r"Mr\. (\w+) (\w+) met Mrs\. (\w+)\.", one)
    assert name[1] in surrogates.GIVEN["m", "latin"] and name[2] == name[3] != "Smith"
    area, a, b = re.search(r"\+1 \((\d{3})\) (\d{3})-(\d{4}) or", one).groups()
    assert f"{area}-{a}-{b}." in one and (area, a, b) != ("988", "555", "2485")
    assert f"Mr. {name[2].upper()}" in two
    mails = re.findall(r"\S+@\S+", two)
    assert mails[0].upper() == mails[1] and "x.org" not in two
    card = re.search(r"card (4\d{3}) (\d{4}) (\d{4}) (\d{4})", two)
    digits = [int(x) for x in "".join(card.groups())]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
    assert re.search(r"and 9\d\d-\d\d-\d{4}$", two)
    woman = re.match(r"Госпожа (\w+) (\w+), DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d, (24|25)\d\.\d+\.\d+\.\d+\.$", three)
    assert woman and woman[1] in surrogates.GIVEN["f", "cyrillic"] and re.fullmatch(r"[А-я]+", woman[2])
    assert [got[i].n_entities for i in (1, 2, 3)] == [4, 5, 3]


def test_collisions_are_resolved(spark, monkeypatch):
    real = surrogates.surrogate

    def narrow(key, kind, value, attempt):
        # At first only eight different surrogates, some of them values of the corpus.
        wide = real(key, kind, value, attempt)
        return wide if attempt >= 3 else F.concat(F.lit("240.0.0."), F.pmod(F.xxhash64(value, F.lit(attempt)), F.lit(8)).cast("string"))

    monkeypatch.setattr(surrogates, "surrogate", narrow)
    values = [f"240.0.0.{i}" for i in range(4)] + [f"10.1.{i}.7" for i in range(40)]
    parts = spark.createDataFrame([("ip", v) for v in values] * 2, "kind string, value string")
    got = {r.value: r.new for r in surrogates.surrogate_table(parts, "k").collect()}
    assert set(got) == set(values) and len(set(got.values())) == len(values) and not set(got.values()) & set(values)


def test_surrogates_of_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = surrogates.replace_entities(docs, "k").select("doc_id", F.col("text").alias("new"), "n_entities")
    pattern = re.compile(r"[\w.+-]+@[\w-]+\.[\w.-]*\w|\b\d{1,3}(?:\.\d{1,3}){3}\b|\+\d \(\d{3}\) \d{3}-\d{4}|\b\d{16}\b")
    there, back = {}, {}
    for r in docs.join(out, "doc_id").collect():
        a, b = pattern.findall(r.text or ""), pattern.findall(r.new or "")
        assert len(a) == len(b) == r.n_entities and pattern.sub("#", r.text or "") == pattern.sub("#", r.new or "")
        for x, y in zip(a, b):
            assert there.setdefault(x, y) == y and back.setdefault(y, x) == x and x != y
    assert len(there) > 5


def test_surrogates_of_odd_documents(spark):
    docs = odd_documents(spark)
    out = surrogates.replace_entities(docs, "k")
    assert out.columns == [*docs.columns, "n_entities"] and out.count() == 11
    assert sorted(r.n_entities for r in out.collect()) == [0] * 9 + [1, 1]
    assert out.where("text is null").count() == 2
    assert surrogates.replace_entities(no_documents(spark), "k").count() == 0


# -------------------------------------------------------------------- pipeline


def test_stages_equal_plain_versions(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    start = {r.doc_id: r.text for r in docs.collect()}
    clean = corpus_pipeline.toxicity(spark, docs, data)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    left = {r.doc_id for r in clean.collect()}
    assert clean.columns == docs.columns
    assert np.mean([(k in left) == (not t) for k, t in labels.items() if start.get(k)]) > 0.95
    single = corpus_pipeline.near_dedup(spark, docs, data)
    root = groups_by_brute_force({k: shingle_set(t, 5) for k, t in start.items()}, 80)
    assert {r.doc_id for r in single.collect()} == {k for k in start if root[k] == k} and set(single.columns) == set(docs.columns)
    windows = set()
    for r in spark.read.parquet(f"{data}/benchmark.parquet").collect():
        w = plain_words(r.text)
        windows |= {tuple(w[i : i + min(10, len(w))]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(x) for x in windows}
    fine = corpus_pipeline.decontamination(spark, docs, data)
    hit = lambda w: any(tuple(w[i : i + k]) in windows for k in sizes for i in range(len(w) - k + 1))
    assert {r.doc_id for r in fine.collect()} == {k for k, t in start.items() if not hit(plain_words(t))}


def test_pipeline_runs_all_stages_in_order(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    want = docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        want = stage(spark, want, data)
        assert set(want.columns) == set(docs.columns)
    texts = {r.doc_id: r.text for r in want.collect()}
    import base64

    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, data).collect()}
    assert got == {k: library.encode_ordinary(t or "") for k, t in texts.items()}


def test_stages_of_odd_documents(spark, data):
    for docs in (odd_documents(spark), no_documents(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, data)
            assert out.count() == (0 if not docs.head(1) else 10 if name == "near_dedup" else 11), name
