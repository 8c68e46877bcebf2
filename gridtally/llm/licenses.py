"""Licence scan by canonical digest: entire texts are normalised and hash-joined to known digests.

Case, punctuation, copyright lines and equivalent spellings do not count. Only DataFrame functions
are used; the documents are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import KNOWN, SPELLINGS

#: The known digests are broadcast up to this number; more are joined by shuffle.
BROADCAST_DIGESTS = 100_000

_COPYRIGHT = r"(?m)^[^\p{L}\p{N}\n]*(copyright\s*(\(c\)|©|[0-9])|\(c\)\s|©|all rights reserved)[^\n]*$"


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, letters and digits only, one space between words and one
    line break between lines that are not empty."""
    t = F.regexp_replace(F.lower(text), _COPYRIGHT, "")
    t = F.regexp_replace(t, r"[^\p{L}\p{N}\n]+", " ")
    t = F.trim(F.regexp_replace(t, r" ?\n[ \n]*", "\n"), F.lit(" \n"))
    for spelling, common in SPELLINGS:
        t = F.replace(t, F.lit(spelling), F.lit(common))
    return t


def whole(lines: Column) -> Column:
    """A canonical text as one line. Spellings that a line break kept apart are joined as well."""
    t = F.replace(lines, F.lit("\n"), F.lit(" "))
    for spelling, common in SPELLINGS:
        if " " in spelling:
            t = F.replace(t, F.lit(spelling), F.lit(common))
    return t


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """(digest, license, length) of every known text; a digest that two licences share has the first by name."""
    rows = spark.createDataFrame([tuple(x) for x in known], "license string, text string")
    text = whole(canonical(F.col("text")))
    return rows.groupBy(F.sha2(text, 256).alias("digest"), F.length(text).alias("length")).agg(
        F.min("license").alias("license")
    )


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, text: str = "text") -> DataFrame:
    """Units of every document with the licence that they are.

    One row for each whole text (``unit`` 'text', ``line`` 0), whose ``license`` is null if it is
    no known licence text, and one for each line that is a known text of its own (``unit`` 'line',
    ``line`` from 1, counted over canonical lines). A null text is empty, and an empty text has the
    digest of '' and no licence unless the known texts have it. Repeated documents are scanned one
    by one. All other columns are kept, but for those of the names that are added.
    """
    docs = docs.drop("unit", "line", "digest", "license", "license_text")
    if known is None:
        known = known_digests(docs.sparkSession)
    lengths = [r[0] for r in known.select("length").distinct().limit(BROADCAST_DIGESTS + 1).collect()]
    few = len(lengths) <= 1000 and known.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS
    kept = [c for c in docs.columns if c != text]
    lines = docs.select(*kept, canonical(F.coalesce(text, F.lit(""))).alias("license_text"))
    # A line can only be a known text if it has the length of one.
    fits = (lambda x: F.length(x).isin(lengths)) if len(lengths) <= 1000 else (lambda x: F.length(x) > 0)
    per_line = F.transform(
        F.split("license_text", "\n"),
        lambda x, i: F.struct(F.lit("line").alias("unit"), (i + 1).alias("line"), x.alias("value")),
    )
    units = F.concat(
        F.array(F.struct(F.lit("text").alias("unit"), F.lit(0).alias("line"), whole(F.col("license_text")).alias("value"))),
        F.filter(per_line, lambda u: fits(u["value"])),
    )
    each = lines.select(*kept, F.explode(units).alias("u")).select(
        *kept, F.col("u.unit").alias("unit"), F.col("u.line").alias("line"), F.sha2(F.col("u.value"), 256).alias("digest")
    )
    found = known.select("digest", "license")
    out = each.join(F.broadcast(found) if few else found, "digest", "left")
    return out.where((F.col("unit") == "text") | F.col("license").isNotNull()).select(
        *kept, "unit", "line", "digest", "license"
    )
