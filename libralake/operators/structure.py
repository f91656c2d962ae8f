"""Units, headings, sections and fragments of documents."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def small(batches: Iterator[pd.DataFrame], most: int = 1000) -> Iterator[pd.DataFrame]:
    """The frames in slices of at most ``most`` rows, so that what is made of a slice stays small."""
    for pdf in batches:
        for i in range(0, len(pdf), most):
            yield pdf.iloc[i : i + most]


def units(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, place (from 0), unit: the non-empty lines of every text."""
    parts = F.filter(F.split(text, "\n"), lambda s: F.length(F.trim(s)) > 0)
    return docs.select(key, F.posexplode(parts).alias("place", "unit"))


def joined_lines(x: Column) -> Column:
    """Paragraph text without line ends: words parted by a hyphen are joined."""
    return F.regexp_replace(F.regexp_replace(x, r"(\p{L})-\n(\p{Ll})", "$1$2"), r"\s*\n\s*", " ")


def running_titles(heads: DataFrame, doc: str, unit: str, text: str, least: int = 3, share: float = 0.05) -> DataFrame:
    """doc, title: headings that repeat over so many units that they are page headers."""
    k = heads.select(doc, unit, T.key(F.regexp_replace(F.col(text), r"\d+", "")).alias("title")).where("title <> ''")
    n = heads.groupBy(doc).agg(F.countDistinct(unit).alias("n"))
    return k.groupBy(doc, "title").agg(F.countDistinct(unit).alias("c")).join(n, doc).where(F.col("c") >= F.greatest(F.lit(float(least)), share * F.col("n"))).select(doc, "title", "c")


def sections(heads: DataFrame, doc: str, place: str, level: str, deepest: int = 9) -> DataFrame:
    """Adds parent (place of the last heading of a smaller level), next_place (first later heading of the same or a smaller level).

    One place is carried along for each level from 1 to ``deepest``; deeper headings count as of that level.
    """
    own = F.greatest(F.lit(1), F.least(F.col(level), F.lit(deepest))).cast("int")

    def seen(order) -> list:
        w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return [F.last(F.when(own == n, F.col(place)), ignorenulls=True).over(w) for n in range(1, deepest + 1)]

    out = heads.withColumn("_b", F.array(*seen(F.col(place).asc()))).withColumn("_a", F.array(*seen(F.col(place).desc())))
    parent = F.when(own > 1, F.array_max(F.slice("_b", F.lit(1), own - 1)))
    return out.withColumn("parent", parent).withColumn("next_place", F.array_min(F.slice("_a", F.lit(1), own))).drop("_a", "_b")


_ABBREVIATED = re.compile(r"(?:\b(?:dr|mr|mrs|ms|st|sr|sra|vol|cap|ed|eds|fig|no|núm|pp?|cf|etc|vs|bzw|z\.b)|\b\p{Lu})\.$".replace(r"\p{Lu}", "[A-ZÁÉÍÓÚÑ]"), re.I)
_END = re.compile(r"[.!?…]+[\"'»”)\]]*\s+(?=[\"'«“¿¡(\[]*[A-ZÁÉÍÓÚÀÈÙÂÊÎÔÛÄÖÜÑÇ0-9—])")


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences of a text; abbreviations and initials end none, line breaks do."""
    out, at = [], 0
    for block in re.finditer(r"[^\n]+", text):
        at, stop = block.start(), block.end()
        for m in _END.finditer(text, at, stop):
            end = m.start() + len(m[0].rstrip())
            if not _ABBREVIATED.search(text[at:end]):
                out.append((at, end))
                at = m.end()
        if text[at:stop].strip():
            out.append((at, stop))
    return out


def estimate(text: str) -> int:
    return max(-(-len(text) // 4), -(-13 * len(text.split()) // 10))


def fragments(text: str, least: int = 250, target: int = 350, most: int = 450) -> list[tuple[int, int]]:
    """Spans of fragments: whole paragraphs up to the target, long paragraphs cut evenly at sentence ends, a short tail joined."""
    parts: list[tuple[int, int, int]] = []
    for p in re.finditer(r"[^\n]+(?:\n(?!\s*\n)[^\n]+)*", text):
        n = estimate(p[0])
        if n <= most:
            parts.append((p.start(), p.end(), n))
            continue
        spans = [(p.start() + a, p.start() + b) for a, b in sentences(p[0])] or [(p.start(), p.end())]
        share = n / -(-n // target)
        at, held = spans[0][0], 0
        for i, (a, b) in enumerate(spans):
            held += estimate(text[a:b])
            if held >= share or i + 1 == len(spans):
                parts.append((at, b, held))
                at, held = (spans[i + 1][0], 0) if i + 1 < len(spans) else (b, 0)
    out: list[list[int]] = []
    for a, b, n in parts:
        if out and (out[-1][2] + n <= target or (out[-1][2] < least and out[-1][2] + n <= most)):
            out[-1][1], out[-1][2] = b, out[-1][2] + n
        else:
            out.append([a, b, n])
    if len(out) > 1 and out[-1][2] < 0.4 * least:
        out[-2][1], out[-2][2] = out[-1][1], out[-2][2] + out[-1][2]
        out.pop()
    return [(a, b) for a, b, _ in out]


def chunk(docs: DataFrame, key: str, text: str, least: int = 250, target: int = 350, most: int = 450) -> DataFrame:
    """key, place, start, end, fragment: the fragments of every text, in Arrow batches without a shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in small(batches):
            rows = [(k, i, a, b, t[a:b]) for k, t in zip(pdf[key], pdf[text].fillna("")) for i, (a, b) in enumerate(fragments(t, least, target, most))]
            if rows:
                yield pd.DataFrame(rows, columns=[key, "place", "start", "end", "fragment"])

    return docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text)).mapInPandas(run, f"{key} long, place int, start int, end int, fragment string")


def passage(text: str, terms: set[str], most_words: int = 70) -> tuple[int, int, int]:
    """(start, end, distinct terms) of the best run of at most three sentences, by distinct terms and a quarter of all hits."""
    fold = lambda s: re.findall(r"[^\W_]+", s.lower().translate(str.maketrans(T.ACCENTED, T.PLAIN)))
    spans = sentences(text)
    words = [fold(text[a:b]) for a, b in spans]
    best, at = 0.0, (0, 0, 0)
    for i in range(len(spans)):
        for j in range(i, min(i + 3, len(spans))):
            run = [w for ws in words[i : j + 1] for w in ws]
            if j > i and len(run) > most_words:
                break
            hits = [w for w in run if w in terms]
            score = len(set(hits)) + 0.25 * len(hits) - 0.01 * (j - i)
            if hits and score > best:
                best, at = score, (spans[i][0], spans[j][1], len(set(hits)))
    return at


def passages(docs: DataFrame, terms: list[str], key: str, text: str, least_terms: int = 2) -> DataFrame:
    """key, start, end, n_terms, passage of the texts that have a passage with so many distinct terms."""
    wanted = set(terms)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in small(batches):
            rows = []
            for k, t in zip(pdf[key], pdf[text].fillna("")):
                a, b, n = passage(t, wanted)
                if n >= least_terms:
                    rows.append((k, a, b, n, t[a:b]))
            if rows:
                yield pd.DataFrame(rows, columns=[key, "start", "end", "n_terms", "passage"])

    return docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text)).mapInPandas(run, f"{key} long, start int, end int, n_terms int, passage string")


def skeleton(text: str) -> tuple[str, list[int]]:
    """Letters and digits of a text, folded, and where each stands."""
    low = text.lower().translate(str.maketrans(T.ACCENTED, T.PLAIN))
    at = [i for i, ch in enumerate(low) if ch.isalnum()] if len(low) == len(text) else [i for i, ch in enumerate(text) if ch.isalnum()]
    return "".join(low[i] if len(low) == len(text) else text[i].lower()[:1] for i in at), at


def locate(quote: str, text: str, ends: int = 24) -> tuple[int, int, float] | None:
    """(start, end, confidence) of a quotation: exact 1, same letters .95, same first and last letters .75."""
    i = text.find(quote) if quote else -1
    if i >= 0:
        return i, i + len(quote), 1.0
    q, _ = skeleton(quote)
    t, at = skeleton(text)
    if not q:
        return None
    i = t.find(q)
    if i >= 0:
        return at[i], at[i + len(q) - 1] + 1, 0.95
    if len(q) >= 2 * ends:
        a = t.find(q[:ends])
        b = t.find(q[-ends:], a + ends) if a >= 0 else -1
        if a >= 0 and b >= 0 and b + ends - a <= 2 * len(q):
            return at[a], at[b + ends - 1] + 1, 0.75
    return None


def locate_quotes(pairs: DataFrame, quote: str, text: str) -> DataFrame:
    """Adds start, end, confidence (null where not found) to rows with a quotation and a text."""
    out = pairs.schema.simpleString()[7:-1] + ",start:int,end:int,confidence:double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in small(batches):
            found = [locate(q or "", t or "") or (None, None, None) for q, t in zip(pdf[quote], pdf[text])]
            yield pdf.assign(start=pd.array([f[0] for f in found], "Int32"), end=pd.array([f[1] for f in found], "Int32"), confidence=[f[2] for f in found])

    return pairs.mapInPandas(run, out.replace(":", " "))


def reach(quote: str, ends: int = 24) -> set[str]:
    """What a text's letters must have one of, for ``locate`` to find the quotation there: its first letters, folded and not."""
    return {_loose(x)[:ends] for x in (skeleton(quote)[0], "".join(ch.lower()[:1] for ch in quote if ch.isalnum()))}


def _loose(letters: str) -> str:
    """Small final sigma depends on what follows, which a quotation may lack."""
    return letters.replace("ς", "σ")


#: Characters of quotations that one pass sends to the tasks.
QUOTE_CHARS = 16_000_000


def locate_all(docs: DataFrame, quotes: DataFrame, doc: str, text: str, item: str, quote: str) -> DataFrame:
    """doc, item, start, end, confidence: every hit of ``locate`` among all documents and quotations.

    Quotations go to the tasks in blocks of ``QUOTE_CHARS`` characters (one pass over the documents for each) by their
    first letters; those of a text are looked up at every place of its letters, so a pair that is passed by is one
    that ``locate`` would not find.
    """
    total = quotes.agg(F.sum(F.length(quote))).first()[0] or 0
    n = max(1, -(-total // QUOTE_CHARS))
    own = F.pmod(F.xxhash64(F.col(item), F.col(quote)), F.lit(n))
    return reduce(DataFrame.unionByName, [_locate_block(docs, quotes.where(own == i) if n > 1 else quotes, doc, text, item, quote) for i in range(n)])


def _locate_block(docs: DataFrame, quotes: DataFrame, doc: str, text: str, item: str, quote: str) -> DataFrame:
    """As ``locate_all``, for quotations that fit in one broadcast."""
    wanted: dict[int, dict[str, list[tuple[int, str]]]] = {}
    for k, q in quotes.select(F.col(item).cast("long"), F.col(quote).cast("string")).where(F.length(quote) > 0).collect():
        for letters in reach(q):
            wanted.setdefault(len(letters), {}).setdefault(letters, []).append((k, q))
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in small(batches):
            rows = []
            for k, t in zip(pdf[doc], pdf[text].fillna("")):
                letters = _loose(skeleton(t)[0])
                near: set[tuple[int, str]] = set()
                for n, heads in sent.value.items():
                    for head in {letters[i : i + n] for i in range(len(letters) - n + 1)} & heads.keys():
                        near.update(heads[head])
                for i, q in sorted(near):
                    if hit := locate(q, t):
                        rows.append((k, i, *hit))
            if rows:
                yield pd.DataFrame(rows, columns=[doc, item, "start", "end", "confidence"])

    src = docs.where(F.col(doc).isNotNull()).select(F.col(doc).cast("long").alias(doc), F.col(text).cast("string").alias(text))
    return src.mapInPandas(run, f"{doc} long, {item} long, start int, end int, confidence double")


def pack(rows: DataFrame, doc: str, order: str, size: str, most: int) -> DataFrame:
    """Adds batch: rows of a document packed greedily in order, no batch above ``most`` unless one row is."""
    schema = rows.schema.simpleString()[7:-1].replace(":", " ") + ", batch int"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        batch, held, out = 0, 0, []
        for n in pdf[size]:
            if held and held + n > most:
                batch, held = batch + 1, 0
            held += n
            out.append(batch)
        return pdf.assign(batch=out)

    return rows.groupBy(doc).applyInPandas(one, schema)
