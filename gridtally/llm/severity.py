"""Severity grades by cumulative-link ordinal regression on sparse text features.

Features of a document are the presence of words and of word beginnings (4 and 5 bytes). One weight
vector is shared by all thresholds: P(grade > k) = sigmoid(x w - t_k) with rising t_k. Expected
severity is the sum of these probabilities.

The classifier is fitted on at most SAMPLE_ROWS labelled documents, chosen by the hash of their id
from all labels; feature counts of the sample are summed by Spark, and the SELECTED most telling
features stay. Every document is scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import settle
from .words import ALNUM, U64, distinct, mix, pieces, put_back, row_schema, set_aside, signed, text_bytes, words

SAMPLE_ROWS = 20_000
SELECTED = 4_096
#: A feature has to stand in so many sampled documents.
MIN_DOCS = 3
STEMS = (4, 5)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature hashes of every text and the texts' offsets in them."""
    w = words(column, ALNUM)
    raw = text_bytes(column)[0]
    doc, long_ = w.doc, w.end - w.start
    hashes, docs = [w.hash], [doc]
    for n in STEMS:
        has = np.flatnonzero(long_ > n)
        h = np.full(len(has), n, U64)
        for i in range(n):
            b = raw[w.start[has] + i]
            h = h * U64(257) + np.where((b >= 65) & (b <= 90), b + 32, b).astype(U64)
        hashes.append(mix(h))
        docs.append(doc[has])
    return distinct(np.concatenate(hashes), np.concatenate(docs), len(column))


@dataclass
class OrdinalModel:
    """``vocabulary`` (sorted hashes), a weight for each, and rising thresholds between grades."""

    vocabulary: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    @property
    def grades(self) -> int:
        return len(self.thresholds) + 1

    def above(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        """P(grade > k) for every text and threshold."""
        score = np.zeros(len(at) - 1)
        if len(self.vocabulary) and len(h):
            place = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
            value = np.where(self.vocabulary[place] == h, self.weights[place], 0.0)
            score = np.diff(np.concatenate([[0.0], np.cumsum(value)])[at])
        return _sigmoid(score[:, None] - self.thresholds)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def fit_thresholds(
    doc: np.ndarray, feature: np.ndarray, grade: np.ndarray, n_features: int, ridge: float = 0.5, steps: int = 400
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that maximise the cumulative-link likelihood, by Adam steps over the
    whole (bounded) sample. (doc, feature) are the ones of a sparse 0/1 matrix. Grades are 0, 1, ...

    Thresholds are a first value and positive gaps, so that they stay in order. A grade that no
    document has keeps a small share through half an observation at score 0."""
    n, top = len(grade), int(grade.max())
    share = np.array([(np.sum(grade > k) + 0.5) / (n + 1.0) for k in range(top)])
    cut = -np.log(share / (1.0 - share))
    gap = np.log(np.maximum(np.diff(cut), 1e-3))
    params = np.concatenate([np.zeros(n_features), cut[:1], gap])
    first, second = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        w, t0, g = params[:n_features], params[n_features], params[n_features + 1 :]
        cuts = t0 + np.concatenate([[0.0], np.cumsum(np.exp(g))])
        score = np.bincount(doc, w[feature], n)
        over = np.hstack([np.ones((n, 1)), _sigmoid(score[:, None] - cuts), np.zeros((n, 1))])
        slope = over * (1.0 - over)
        rows = np.arange(n)
        mass = np.maximum(over[rows, grade] - over[rows, grade + 1], 1e-12)
        upper, lower = slope[rows, grade] / mass, slope[rows, grade + 1] / mass
        by_score = upper - lower
        by_cut = np.array([np.sum(lower[grade == k]) - np.sum(upper[grade == k + 1]) for k in range(top)])
        grad = np.concatenate(
            [
                np.bincount(feature, by_score[doc], n_features) - ridge * w,
                [by_cut.sum()],
                np.exp(g) * np.array([by_cut[k:].sum() for k in range(1, top)]),
            ]
        )
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        rate = 0.1 * min(1.0, 4.0 * (1.0 - step / (steps + 1)))
        params = params + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    w = params[:n_features]
    return w, params[n_features] + np.concatenate([[0.0], np.cumsum(np.exp(params[n_features + 1 :]))])


def sample_labels(labels: DataFrame, key: str, grade: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` labelled keys, the smallest by hash; keys with two grades have the higher."""
    each = labels.where(F.col(key).isNotNull() & F.col(grade).isNotNull()).groupBy(key)
    each = each.agg(F.max(F.col(grade).cast("int")).alias("grade"))
    return each.orderBy(F.xxhash64(F.col(key)), key).limit(rows)


def fit_severity(
    docs: DataFrame,
    labels: DataFrame,
    grade: str,
    key: str = "doc_id",
    text: str = "text",
    sample_rows: int = SAMPLE_ROWS,
    selected: int = SELECTED,
) -> OrdinalModel | None:
    """Fit on the sampled labelled documents. None if there is no labelled document; a model
    without features if only one grade occurs. Labels without grade or document do not count."""
    sample = settle(sample_labels(labels, key, grade, sample_rows).withColumnRenamed(key, "key"))
    # The sample is bounded by ``sample_rows``, so it may be sent to all executors.
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(sample), "key")

    def run(batches):
        for part in pieces(batches, "text"):
            h, at = features(part.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(signed(h), pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("grade"), lists], names=["grade", "features"])

    seen = settle(rows.mapInArrow(run, "grade int, features array<bigint>").withColumn("row", F.monotonically_increasing_id()))
    totals = {r["grade"]: r["n"] for r in seen.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).limit(1000).collect()}
    n = sum(totals.values())
    if not n:
        return None
    top = max(totals)
    if min(totals) < 0 or top > 100:
        raise ValueError("grades have to be whole numbers from 0 to 100")
    if len(totals) == 1:
        return OrdinalModel(np.zeros(0, U64), np.zeros(0), np.where(np.arange(top) < top, -50.0, 50.0) if top else np.array([50.0]))
    mean = sum(g * c for g, c in totals.items()) / n
    # How far the mean grade of the documents with a feature lies from the overall mean, in standard errors.
    told = seen.select("grade", F.explode("features").alias("feature")).groupBy("feature").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.col("grade") - F.lit(mean)).alias("shift")
    )
    strength = F.abs("shift") / F.sqrt(F.col("docs"))
    chosen = [
        r["feature"]
        for r in told.where(F.col("docs") >= MIN_DOCS).orderBy(strength.desc(), "feature").limit(selected).select("feature").collect()
    ]
    vocabulary = np.sort(np.array(chosen, np.int64).view(U64))
    wanted = docs.sparkSession.createDataFrame([(int(x),) for x in chosen], "feature bigint")
    cells = seen.select("row", F.explode("features").alias("feature")).join(F.broadcast(wanted), "feature")
    per_row = cells.groupBy("row").agg(F.collect_list("feature").alias("features"))
    # At most ``sample_rows`` rows (and the copies of their documents) of at most ``selected`` features.
    got = seen.select("row", "grade").join(per_row, "row", "left").orderBy("row").limit(4 * sample_rows).collect()
    grades = np.array([r["grade"] for r in got])
    lists = [np.array(r["features"] or [], np.int64).view(U64) for r in got]
    doc = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    feature = np.searchsorted(vocabulary, np.concatenate(lists)) if len(doc) else np.zeros(0, np.int64)
    weights, cuts = fit_thresholds(doc, feature, grades, len(vocabulary))
    return OrdinalModel(vocabulary, weights, cuts)


def score_severity(docs: DataFrame, model: OrdinalModel | None, text: str = "text") -> DataFrame:
    """Add ``expected_severity``, ``p_above`` (P(grade > 0)) and ``grade`` (the most probable, the
    lower of equals). A null or empty text has no features and gets the model's base rate; without
    a model all three are null. A given column of the name of an added one is replaced."""
    docs = docs.drop("expected_severity", "p_above", "grade")
    state = ["expected_severity double", "p_above double", "grade int"]
    if model is None:
        return docs.selectExpr("*", *[f"cast(null as {t}) as {c}" for c, t in (x.split() for x in state)])
    sent = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns

    def run(batches):
        for part in pieces(batches, text):
            over = sent.value.above(*features(part.column(text)))
            mass = -np.diff(np.hstack([np.ones((len(over), 1)), over, np.zeros((len(over), 1))]), axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    *[part.column(c) for c in columns],
                    pa.array(over.sum(axis=1)),
                    pa.array(over[:, 0].copy()),
                    pa.array(mass.argmax(axis=1), pa.int32()),
                ],
                names=[*columns, "expected_severity", "p_above", "grade"],
            )

    return docs.mapInArrow(run, row_schema(docs, *state))


def drop_severe(docs: DataFrame, model: OrdinalModel | None, text: str = "text", limit: float = 0.5) -> DataFrame:
    """Documents whose P(grade > 0) is below ``limit``, with their columns; without a model, all."""
    rows, names = set_aside(docs)
    scored = score_severity(rows, model, next(n for n, c in names.items() if c == text))
    return put_back(scored.where(F.coalesce(F.col("p_above") < limit, F.lit(True))), names)
