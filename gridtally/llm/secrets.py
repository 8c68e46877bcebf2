"""Secrets in text, told apart by how many owners and repositories in the corpus have them.

The base patterns give their spans as they are. Further patterns add candidates. Every candidate's
hash is then counted over the whole corpus by distinct owners and repositories: one that several
owners have is a copied example, one that a single owner has is taken for a live credential.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import settle
from .words import pieces

ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Kinds that the method adds; all are of fixed public shapes but the last, which needs mixed characters.
MORE = (
    ("pem", re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----[A-Za-z0-9+/=\s]++-----END (?:[A-Z]+ )?PRIVATE KEY-----")),
    ("jwt", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]*+")),
    ("github", re.compile(r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,}+")),
    ("slack", re.compile(r"(?<![A-Za-z0-9-])xox[abprs]-[A-Za-z0-9-]{10,}+")),
    ("mixed", re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}+")),
)
KINDS = ("assign", "access", "hex", *(k for k, _ in MORE))
MIN_BITS = 3.5
SPAN = "array<struct<kind:string,start:int,end:int,hash:string>>"


def entropy(value: str) -> float:
    """Bits a character."""
    return -sum(c / len(value) * math.log2(c / len(value)) for c in Counter(value).values())


def _mixed(value: str) -> bool:
    """Letters of both cases and digits, as spread as random text."""
    return bool(re.search("[a-z]", value) and re.search("[A-Z]", value) and re.search("[0-9]", value)) and entropy(value) >= MIN_BITS


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, secret) in code points, by start and then by kind as listed."""
    found = [("assign", m.start(), m.end(), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans in order, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def added_spans(text: str, base: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
    """Spans of the further kinds that touch no span found before them. Each kind's matches and the
    spans before them are gone through side by side, in order."""
    taken = _joined([(s[1], s[2]) for s in base])
    out = []
    for kind, pattern in MORE:
        new, at = [], 0
        for m in pattern.finditer(text):
            while at < len(taken) and taken[at][1] <= m.start():
                at += 1
            if (at == len(taken) or taken[at][0] >= m.end()) and (kind != "mixed" or _mixed(m[0])):
                new.append((kind, m.start(), m.end(), m[0]))
        if new:
            out += new
            taken = _joined(taken + [(s[1], s[2]) for s in new])
    return out


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace the text by its spans: ``base`` and ``added``, arrays of kind, start, end and the
    secret's SHA-256. The secrets themselves are not passed on."""
    columns = [c for c in docs.columns if c != text]
    kept = docs.select(*columns)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), f"base {SPAN}", f"added {SPAN}"])
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("hash", pa.string())]))

    def cells(spans):
        return [{"kind": k, "start": a, "end": b, "hash": hashlib.sha256(v.encode()).hexdigest()} for k, a, b, v in spans]

    def run(batches):
        for part in pieces(batches, text):
            base, added = [], []
            for value in part.column(text).to_pylist():
                found = base_spans(value or "")
                base.append(cells(found))
                added.append(cells(added_spans(value or "", found)))
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in columns], pa.array(base, span_type), pa.array(added, span_type)],
                names=[*columns, "base", "added"],
            )

    return docs.select(*columns, text).mapInArrow(run, schema)


def ownership(spans: DataFrame, owner: str, repository: str) -> DataFrame:
    """Per secret's hash the numbers of distinct owners and repositories that have it. Distinct
    triples come first, so that a secret with very many copies is spread over tasks; a null owner
    or repository counts as one of its own."""
    each = spans.select("hash", F.col(owner).alias("owner"), F.col(repository).alias("repository")).distinct()
    by_owner = each.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    return by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"))


def find_secrets(
    docs: DataFrame,
    text: str = "text",
    owner: str = "source",
    repository: str = "doc_id",
    example_owners: int = 2,
) -> DataFrame:
    """Replace each document's text by what was found in it, one row a document.

    ``secrets`` holds all spans by start and kind as (kind, start, end, hash, base, owners,
    repositories, example); ``example`` is true when ``example_owners`` or more owners have the
    secret. Repositories are counted within owners. A null or empty text has no spans. Repeated
    rows stay repeated. Offsets are code points, the end exclusive. A given column ``secrets`` is
    replaced.
    """
    row = "secrets_row"
    names = {f"column_{i}": c for i, c in enumerate(docs.columns)}
    named = {c: n for n, c in names.items()}
    docs = docs.toDF(*names)
    text, owner, repository = named[text], named[owner], named[repository]
    found = settle(scan(docs, text).withColumn(row, F.monotonically_increasing_id()))
    both = F.concat(
        F.transform("base", lambda s: s.withField("base", F.lit(True))),
        F.transform("added", lambda s: s.withField("base", F.lit(False))),
    )
    spans = found.where((F.size("base") > 0) | (F.size("added") > 0)).select(
        F.col(row), F.col(owner).alias("owner"), F.col(repository).alias("repository"), F.explode(both).alias("span")
    )
    spans = spans.select("*", F.col("span.hash").alias("hash"))
    known = ownership(spans, "owner", "repository")
    place = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    told = spans.join(known, "hash").groupBy(row).agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    F.col("span.start").alias("start"),
                    place[F.col("span.kind")].alias("place"),
                    F.col("span.kind").alias("kind"),
                    F.col("span.end").alias("end"),
                    "hash",
                    F.col("span.base").alias("base"),
                    "owners",
                    "repositories",
                    (F.col("owners") >= example_owners).alias("example"),
                )
            )
        ).alias("secrets")
    )
    return found.join(told, row, "left").select(
        *[F.col(n).alias(c) for n, c in names.items() if n != text and c != "secrets"],
        F.coalesce("secrets", F.array().cast(told.schema["secrets"].dataType)).alias("secrets"),
    )
