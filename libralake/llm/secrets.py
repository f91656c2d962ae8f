"""Secret scans with corpus-wide ownership frequency.

Candidates of three base kinds (assign, access, hex), of further kinds with a fixed
shape (jwt, github, slack, google, pem) and bare values (runs of 16 or more letters, digits and
``+/_=-`` with a letter and a digit, outside all other candidates) are found in every whole text.
The value of a candidate is hashed, and over the whole corpus the distinct repositories and
owners of each hash are counted.  The counts give each candidate a verdict:

* ``copied``: a value of many owners or in many repositories, a widely copied example;
* ``live``: another value of a single owner;
* ``shared``: the rest.

Base spans always stay.  Spans of the further kinds stay unless their value is copied.  A bare
value is a span only where the corpus shows that it is a credential: it is live, and its value
stands under one of the other kinds elsewhere or looks random (20 or more characters, both
cases, digits, 3.5 or more bits a character).

Null texts are empty and have no spans.  Null owners or repositories count as one
common owner or repository.  Rows that are repeated give repeated results and count
once.  An empty table gives no rows.  Other columns are not looked at.
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._arrow import filled, row_ids, slices, whole, with_text
from ._store import materialize

BASE = ("assign", "access", "hex")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_DOTTED = re.compile(r"[A-Za-z0-9_.-]+")


class _Jwt:
    """Three runs with dots between them, the first two of eyJ and 8 more, the last of 8; every run is looked at once."""

    @staticmethod
    def finditer(text: str) -> Iterator[re.Match]:
        for m in _DOTTED.finditer(text):
            parts = m[0].split(".")
            at, i = m.start(), 0
            while i + 2 < len(parts):
                first = parts[i].find("eyJ")
                if first >= 0 and len(parts[i]) - first >= 11 and parts[i + 1].startswith("eyJ") and len(parts[i + 1]) >= 11 and len(parts[i + 2]) >= 8:
                    size = sum(map(len, parts[i : i + 3])) + 2
                    yield _ANY.match(text, at + first, at + size)
                    at, i = at + size + 1, i + 3
                else:
                    at, i = at + len(parts[i]) + 1, i + 1


_ANY = re.compile(".*", re.S)
#: Kind, a string that every match has, pattern.
FURTHER = (
    ("jwt", "eyJ", _Jwt),
    ("github", "gh", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}")),
    ("slack", "xox", re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}")),
    ("google", "AIza", re.compile(r"AIza[A-Za-z0-9_-]{35}")),
    ("pem", "-----BEGIN", re.compile(r"-----BEGIN [A-Z ]*?PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*?PRIVATE KEY-----")),
)
KINDS = (*BASE, *(k for k, _, _ in FURTHER), "value")
VALUE = len(KINDS) - 1
_VALUE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(start, number of the kind, end, value) of every candidate, by start and then kind."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    for i, (_, hint, pattern) in enumerate(FURTHER):
        if hint in text:
            out += [(m.start(), 3 + i, m.end(), m[0]) for m in pattern.finditer(text)]
    bare = [(m.start(), VALUE, m.end(), m[0]) for m in _VALUE.finditer(text) if any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0])]
    if bare:
        taken = sorted((s, e) for s, _, e, _ in out)
        i = 0
        for b in bare:
            while i < len(taken) and taken[i][1] <= b[0]:
                i += 1
            if i == len(taken) or taken[i][0] >= b[2]:
                out.append(b)
    out.sort()
    return out


def random_looking(value: str) -> bool:
    """Whether a bare value is long and mixed enough for a generated one."""
    if len(value) < 20 or not (any(c.islower() for c in value) and any(c.isupper() for c in value)):
        return False
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values()) >= 3.5


FOUND = T.ArrayType(T.StructType().add("start", "integer").add("kind", "integer").add("end", "integer").add("digest", "long").add("random", "boolean"))
_FOUND = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("digest", pa.int64()), ("random", pa.bool_())]))


def find(docs: DataFrame, key: str, text: str, repo: Column, owner: Column, carry: bool = False) -> DataFrame:
    """at (number of the row), key, repo, owner, found: array of (start, kind, end, digest of the value, random); with ``carry`` also row."""
    more = ["row"] if carry else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = row_ids()
        # A full stop at its end is none of a value.
        hashed = lambda v: int.from_bytes(hashlib.blake2b(v.rstrip(".").encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)
        for b in slices(with_text(batches, place) if carry else batches, "text"):
            found = [[{"start": s, "kind": k, "end": e, "digest": hashed(v), "random": k == VALUE and random_looking(v)} for s, k, e, v in candidates(t)] for t in filled(b.column("text")).to_pylist()]
            cols = [pa.array([next(ids) for _ in found], pa.int64()), *map(b.column, ("key", "repo", "owner")), pa.array(found, _FOUND), *map(b.column, more)]
            yield pa.RecordBatch.from_arrays(cols, names=["at", "key", "repo", "owner", "found", *more])

    place = docs.columns.index(text)
    src = docs.select(docs[key].cast("long").alias("key"), F.coalesce(repo.cast("string"), F.lit("")).alias("repo"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"), whole() if carry else docs[text].cast("string").alias("text"))
    schema = T.StructType().add("at", "long").add("key", "long").add("repo", "string").add("owner", "string").add("found", FOUND)
    return src.mapInArrow(run, schema.add("row", docs.schema) if carry else schema)


def _each(rows: DataFrame) -> DataFrame:
    """One row for each candidate: at, repo, owner and what was found."""
    return rows.where(F.size("found") > 0).select("at", "repo", "owner", F.explode("found").alias("f")).select("at", "repo", "owner", "f.*")


def ownership(each: DataFrame) -> DataFrame:
    """digest, n_owners, n_repos over all candidates, and whether some are more than bare values.

    Distinct (value, owner, repository) first, which deals a value that many documents hold to all tasks, then sums.
    """
    named = F.max(F.col("kind") != VALUE)
    return (
        each.groupBy("digest", "owner", "repo").agg(named.alias("named"))
        .groupBy("digest", "owner").agg(F.count(F.lit(1)).alias("n_repos"), F.max("named").alias("named"))
        .groupBy("digest").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n_repos").alias("n_repos"), F.max("named").alias("named"))
    )


def judged(rows: DataFrame, copied_owners: int, copied_repos: int) -> DataFrame:
    """Candidates with their verdict, and whether they are spans."""
    each = _each(rows)
    copied = (F.col("n_owners") >= copied_owners) | (F.col("n_repos") >= copied_repos)
    verdict = F.when(copied, "copied").when(F.col("n_owners") == 1, "live").otherwise("shared")
    base, bare = F.col("kind") < len(BASE), F.col("kind") == VALUE
    span = base | (~bare & (F.col("verdict") != "copied")) | (bare & (F.col("verdict") == "live") & (F.col("named") | F.col("random")))
    return each.join(ownership(each), "digest").withColumn("verdict", verdict).withColumn("span", span)


def scan(docs: DataFrame, repo: Column, owner: Column, key: str = "doc_id", text: str = "text", copied_owners: int = 3, copied_repos: int = 10) -> DataFrame:
    """Per row: key, counts by base kind, base_spans, spans, verdicts (of the spans), n_live, n_shared, n_copied, n_repos (of its most widespread value).

    A value of ``copied_owners`` or more owners or in ``copied_repos`` or more repositories is copied.
    The last four count candidates that are more than bare values, and bare ones that are spans.
    The scan's small result is written once; only candidates are counted and joined back, rows
    without candidates are never shuffled.
    """
    rows = materialize(find(docs, key, text, repo, owner), "secrets")
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    at = F.struct("start", "kind", F.concat_ws(":", name, F.col("start").cast("string"), F.col("end").cast("string")).alias("s"), F.col("verdict").alias("v"))
    base, span = F.col("kind") < len(BASE), F.col("span")
    joined = lambda only, field: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(only, at))), lambda x: x[field]), ",")
    counted = (F.col("kind") != VALUE) | span
    per_row = (
        judged(rows, copied_owners, copied_repos)
        .groupBy("at")
        .agg(
            *[F.count_if(F.col("kind") == i).alias(f"n_{k}") for i, k in enumerate(BASE)],
            joined(base, "s").alias("base_spans"),
            joined(span, "s").alias("spans"),
            joined(span, "v").alias("verdicts"),
            *[F.count_if(counted & (F.col("verdict") == v)).alias(f"n_{v}") for v in ("live", "shared", "copied")],
            F.coalesce(F.max(F.when(counted, F.col("n_repos"))), F.lit(0)).alias("n_repos"),
        )
    )
    none = [*[F.lit(0).cast("long").alias(f"n_{k}") for k in BASE], *[F.lit("").alias(c) for c in ("base_spans", "spans", "verdicts")], *[F.lit(0).cast("long").alias(c) for c in ("n_live", "n_shared", "n_copied", "n_repos")]]
    have = rows.where(F.size("found") > 0).select("at", F.col("key").alias(key)).join(per_row, "at").drop("at")
    return have.unionByName(rows.where(F.size("found") == 0).select(F.col("key").alias(key), *none))


def masked(docs: DataFrame, repo: Column, owner: Column, key: str = "doc_id", text: str = "text", copied_owners: int = 3, copied_repos: int = 10, mask: str = "[secret]", example: str = "[example]") -> DataFrame:
    """The documents with every credential replaced: by ``example`` where its value is copied, else by ``mask``.

    Credentials are all candidates but bare values that are no spans.  Overlapping ones become one,
    with the mark of the first; all other columns and all rows stay as they were.  The texts are written once with
    what was found in them; only rows with candidates are shuffled.
    """
    place = docs.columns.index(text)
    rows = materialize(find(docs, key, text, repo, owner, carry=True), "secrets")
    found = judged(rows, copied_owners, copied_repos).where((F.col("kind") != VALUE) | F.col("span"))
    marks = found.groupBy("at").agg(F.sort_array(F.collect_set(F.struct("start", "end", (F.col("verdict") == "copied").alias("copied")))).alias("marks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(with_text(batches, place), "text"):
            out = []
            for t, spans in zip(b.column("text").to_pylist(), b.column("marks").to_pylist()):
                parts, at = [], 0
                for s in spans or ():
                    if s["start"] >= at:
                        parts += [t[at : s["start"]], example if s["copied"] else mask]
                    at = max(at, s["end"])
                out.append("".join([*parts, t[at:]]))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(out, pa.string())], names=["row", "text"])

    some = rows.where(F.size("found") > 0).join(marks, "at", "left").select("row", "marks")
    some = some.mapInArrow(run, T.StructType().add("row", docs.schema).add("text", "string"))
    changed = some.select(*[F.col("text").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
    return rows.where(F.size("found") == 0).select("row.*").unionByName(changed)
