"""Named queries of this subpackage over the supplied tables, next to their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe,
    decontaminate,
    knn,
    lempel_ziv,
    licenses,
    near_copies,
    passages,
    phrases,
    pseudo_likelihood,
    secrets,
    severity,
    surrogates,
    whitening,
)
from .license_texts import KNOWN, SPELLINGS
from .words import bounded_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_chained_passages(spark, sf_dir):
    return passages.shared_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op2_odd_sketch_near_copies(spark, sf_dir):
    return near_copies.near_copies(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3, percent=85)


ORACLE["op2_odd_sketch_near_copies"] = r"""
WITH RECURSIVE
lists AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 3 THEN list_transform(generate_series(1, len(words) - 2), lambda i: words[i : i + 2])
                                      WHEN len(words) > 0 THEN [words] ELSE [] END) AS shingle
  FROM lists),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reached r JOIN edges e ON r.b = e.a),
least AS (SELECT a AS doc_id, least(a, min(b)) AS component_id FROM reached GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""


SURROGATE_KEY = "corpus-surrogates"


@query
def op3_surrogates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replace_entities(docs, SURROGATE_KEY)


@query
def op4_byte_bpe(spark, sf_dir):
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), *vocabulary)
    return bpe.decode(coded.drop("text"), *vocabulary).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def graded_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grade 0: not toxic; 1: toxic; 2: toxic and of low quality."""
    grade = F.when(F.col("toxic") == 1, F.when(F.col("quality") == 0, 2).otherwise(1)).when(F.col("toxic") == 0, 0)
    return table(spark, sf_dir, "labels").select("doc_id", grade.alias("grade"))


@query
def op5_severity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = severity.fit_severity(docs, graded_labels(spark, sf_dir), "grade")
    return severity.score_severity(docs, model).select(
        "doc_id", "expected_severity", "grade", (F.col("p_above") >= 0.5).alias("toxic")
    )


@query
def op6_suffix_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("leak_words").alias("n_words"),
        F.col("leak_hits").alias("n_hit"),
        F.size("leak_items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "leak_items"), 256).alias("items_sha256"),
        (F.col("leak_hits") > 0).alias("contaminated"),
        F.col("leak_longest.words").alias("longest_match"),
    )


# Windows of words as strings, joined; runs of neighbouring windows along a diagonal are the matches.
_ITEM_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
ORACLE["op6_suffix_decontamination"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ITEM_WORDS} AS w FROM documents),
b AS (
  SELECT row_number() OVER () AS k, item, w, least(len(w), {decontaminate.WINDOW}) AS need
  FROM (SELECT DISTINCT item_id::VARCHAR AS item, {_ITEM_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0),
p AS (
  SELECT k, item, need, i, string_agg(word, ' ') OVER (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND need - 1 FOLLOWING) AS g
  FROM (SELECT k, item, need, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM b)
  QUALIFY count(*) OVER (PARTITION BY k) - need + 1 >= i),
q AS (
  SELECT r, need, i, string_agg(word, ' ') OVER (PARTITION BY r, need ORDER BY i ROWS BETWEEN CURRENT ROW AND need - 1 FOLLOWING) AS g
  FROM (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d) CROSS JOIN (SELECT DISTINCT need FROM b)
  QUALIFY count(*) OVER (PARTITION BY r, need) - need + 1 >= i),
m AS (SELECT q.r, p.k, p.item, p.need, q.i, q.i - p.i AS diagonal FROM q JOIN p USING (need, g)),
hit AS (
  SELECT r, count(DISTINCT place) AS n_hit
  FROM (SELECT r, unnest(range(i, i + need)) AS place FROM (SELECT DISTINCT r, i, need FROM m)) GROUP BY r),
item AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, item FROM m) GROUP BY r),
run AS (
  SELECT r, max(n) AS longest
  FROM (SELECT r, count(*) + any_value(need) - 1 AS n
        FROM (SELECT *, i - row_number() OVER (PARTITION BY r, k, diagonal ORDER BY i) AS start FROM m)
        GROUP BY r, k, diagonal, start)
  GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(longest, 0)::INTEGER AS longest_match
FROM d LEFT JOIN hit USING (r) LEFT JOIN item USING (r) LEFT JOIN run USING (r)
"""


@query
def op7_pseudo_likelihood(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = pseudo_likelihood.score(docs, pseudo_likelihood.fit(docs, key="doc_id"))
    return scored.select(
        "doc_id", F.col("lm_tokens").alias("n_tokens"), F.col("lm_log_likelihood").alias("log_likelihood"), F.col("lm_mean").alias("mean")
    )


@query
def op8_voronoi_top_k(spark, sf_dir):
    return knn.top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


ORACLE["op8_voronoi_top_k"] = """
WITH p AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r AS qr, q.vec_id AS query_id, p.vec_id AS vec_id, p.r AS r, list_inner_product(q.v, p.v)::BIGINT AS score
  FROM p q JOIN p ON q.r <> p.r AND len(q.v) = len(p.v)
  WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id, r) AS rank FROM s)
WHERE rank <= 10
"""


@query
def op9_license_digests(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _license_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def canonical(x):
        x = f"regexp_replace(lower({x}), {quote(licenses._COPYRIGHT)}, '', 'g')"
        x = f"regexp_replace({x}, {quote('[^\\p{L}\\p{N}' + chr(10) + ']+')}, ' ', 'g')"
        x = f"trim(regexp_replace({x}, {quote(' ?' + chr(10) + '[ ' + chr(10) + ']*')}, chr(10), 'g'), ' ' || chr(10))"
        for a, b in SPELLINGS:
            x = f"replace({x}, {quote(a)}, {quote(b)})"
        return x

    def whole(x):
        x = f"replace({x}, chr(10), ' ')"
        for a, b in SPELLINGS:
            x = f"replace({x}, {quote(a)}, {quote(b)})" if " " in a else x
        return x

    rows = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in KNOWN)
    return f"""
    WITH known AS (
      SELECT digest, min(license) AS license
      FROM (SELECT license, sha256({whole('t')}) AS digest
            FROM (SELECT license, {canonical('text')} AS t FROM (VALUES {rows}) v(license, text)))
      GROUP BY digest),
    canon AS (SELECT doc_id, {canonical("coalesce(text, '')")} AS t FROM documents),
    parts AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS value, generate_subscripts(string_split(t, chr(10)), 1) AS line FROM canon)
    SELECT doc_id, 'text' AS unit, 0 AS line, c.digest AS digest, license
    FROM (SELECT doc_id, sha256({whole('t')}) AS digest FROM canon) c LEFT JOIN known USING (digest)
    UNION ALL
    SELECT doc_id, 'line', line::INTEGER, p.digest, license
    FROM (SELECT doc_id, line, sha256(value) AS digest FROM parts) p JOIN known USING (digest)
    """


ORACLE["op9_license_digests"] = _license_sql()


def _listed(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query
def op10_secret_ownership(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    base = F.filter("secrets", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint")
    return secrets.find_secrets(docs).select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed("secrets").alias("spans"),
        F.size(F.filter("secrets", lambda s: s["example"])).alias("n_examples"),
        F.size(F.filter("secrets", lambda s: ~s["example"])).alias("n_live"),
    )


@query
def op11_grouped_subtree_phrases(spark, sf_dir):
    return phrases.phrases(table(spark, sf_dir, "documents").select("text", "lang"))


ORACLE["op11_grouped_subtree_phrases"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
lines AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
windows AS (
  SELECT lang, unnest(list_transform(generate_series(1, len(words) - m + 1), lambda i: words[i : i + m - 1])) AS path
  FROM lines CROSS JOIN (VALUES (1), (2), (3)) v(m)),
counts AS (SELECT lang, path, count(*) AS f FROM windows GROUP BY lang, path),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE len(path) = 1 GROUP BY lang),
candidates AS (SELECT lang, path, f AS a FROM counts WHERE len(path) > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.path, a, k, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM (SELECT *, unnest(generate_series(1, len(path) - 1)) AS k FROM candidates) c
  JOIN counts l ON l.lang = c.lang AND l.path = c.path[1:k]
  JOIN counts r ON r.lang = c.lang AND r.path = c.path[k + 1:]),
scored AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, path ORDER BY score, k) AS nth FROM cuts) WHERE nth = 1),
inside AS (
  SELECT lang, path[i : i + 1] AS path, max(a) AS longer
  FROM (SELECT *, unnest([1, 2]) AS i FROM candidates WHERE len(path) = 3) GROUP BY 1, 2),
ranked AS (
  SELECT s.lang, array_to_string(s.path, ' ') AS phrase, a, l, r, score,
         row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, array_to_string(s.path, ' ')) AS rank
  FROM scored s LEFT JOIN inside i ON s.lang = i.lang AND s.path = i.path
  WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@query
def op12_incremental_whitening(spark, sf_dir):
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.col("deviation").cast("bigint"))


@query
def op13_phrase_fingerprints(spark, sf_dir):
    return lempel_ziv.compare_edited(table(spark, sf_dir, "documents").select("doc_id", "text"))
