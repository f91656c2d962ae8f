"""Works and their relations: signals from texts and cards, blocked pairs, links to catalogues, candidates, correspondences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import graph
from .intervals import overlap_join

# Phrases that tell an adaptation or a translation of a work named beside them.
ADAPTATION = (
    "basado en, basada en, basados en, basadas en, inspirado en, inspirada en, inspirados en, inspiradas en, adaptacion de, adaptado de, adaptada de, adaptados de, adaptadas de, version cinematografica de, version libre de, "
    "version teatral de, version radiofonica de, a partir de, guion, based on, adapted from, inspired by, from the novel, from the story, from the book, from the play, screenplay, d apres, adapte de, tratto da, basato su, ispirato a"
)
TRANSLATION = (
    "traduccion de, traducido del, traducida del, traducidos del, traducidas del, traducido de la, traducida de la, traducidos de la, traducidas de la, traducido de, traducida de, traducidos de, traducidas de, traducido por, "
    "traducida por, traducidos por, traducidas por, version castellana de, version espanola de, version inglesa de, version francesa de, version italiana de, translated from, translated by, translation of, translator, traduit de, "
    "traduit par, traduction de, tradotto da, tradotto dal, traduzione di"
)
#: Spanish also says on what story, told or written, a film is made.
ADAPTATION += "".join(f", sobre {the} {what}" for the in ("el", "la", "un", "una", "su") for what in ("cuento", "relato", "novela", "obra"))


def cue_pattern(phrases: str) -> str:
    return "(?:^| )(?:" + "|".join(phrases.split(", ")) + ")(?: |$)"


def content_signals(texts: DataFrame, works: DataFrame, doc: str, text: str, work: str, title: str, surname: str, around: int = 220) -> DataFrame:
    """doc, work, relation, weight, n_places: titles of other works that texts name, one row for each relation.

    A title of two words and ten letters counts alone, one of six letters or more only with its author within
    ``around`` characters.  Beside each place of the title, phrases of translation (0.75) or adaptation (0.85 with the author, else 0.75)
    tell the relation; else it is cited (0.5 with the author, else 0.35); the weight is the best of a relation's places.  Titles meet
    texts by equality of word runs, whatever their length.
    """
    named = works.select(work, T.key(F.col(title)).alias("_t"), T.key(F.col(surname)).alias("_s")).where(F.length("_t") >= 6)
    hits = graph.mentions(texts, named, doc, text, work, "_t").join(named, work).groupBy(doc).agg(F.collect_list(F.struct(work, "start", "n_words", "_t", "_s")).alias("_hits"))
    # Each text is taken apart once for all its places; as many words as ``around`` characters can hold are looked at.
    words = T.computed(hits.join(texts.select(doc, text), doc), [doc, "_hits"], _w=T.tokens(F.col(text)))
    most = around // 2 + 1

    def near(h: Column) -> Column:
        first, end = F.greatest(F.lit(1), h["start"] - most), h["start"] + h["n_words"]
        before = F.concat(F.array_join(F.slice("_w", first, h["start"] - first), " "), F.lit(" "))
        after = F.concat(F.lit(" "), F.array_join(F.slice("_w", end, most), " "))
        return F.concat(F.substring(before, F.greatest(F.lit(1), F.length(before) - around + 1), F.lit(around)), h["_t"], F.substring(after, 1, around))

    rows = words.select(doc, F.explode(F.transform("_hits", lambda h: F.struct(h[work].alias(work), h["_t"].alias("_t"), h["_s"].alias("_s"), near(h).alias("_near")))).alias("h")).select(doc, "h.*")
    near_by = F.contains(F.concat(F.lit(" "), F.col("_near"), F.lit(" ")), F.concat(F.lit(" "), "_s", F.lit(" "))) & (F.col("_s") != "")
    whole = (F.size(F.split("_t", " ")) >= 2) & (F.length("_t") >= 10)
    relation = F.when(F.col("_near").rlike(cue_pattern(TRANSLATION)), "translation").when(F.col("_near").rlike(cue_pattern(ADAPTATION)), "adaptation").otherwise("cites")
    weight = F.when(F.col("relation") == "translation", 0.75).when(F.col("relation") == "adaptation", F.when(F.col("_by"), 0.85).otherwise(0.75)).otherwise(F.when(F.col("_by"), 0.5).otherwise(0.35))
    each = rows.withColumn("_by", near_by).where(F.col("_by") | whole).withColumn("relation", relation).withColumn("weight", weight)
    return each.groupBy(doc, work, "relation").agg(F.max("weight").alias("weight"), F.count(F.lit(1)).alias("n_places"))


def card_similarity(cosine: Column | None = None, jaccard: Column | None = None) -> Column:
    """Weight of two cards' likeness: the cosine from 0.62 to 0.92, else shared words from 0.06 to 0.31, times 0.6; null below a fifth."""
    wide = (cosine - 0.62) / 0.3 if jaccard is None else (jaccard - 0.06) / 0.25 if cosine is None else F.coalesce((cosine - 0.62) / 0.3, (jaccard - 0.06) / 0.25)
    alike = F.greatest(F.lit(0.0), F.least(F.lit(1.0), wide))
    return F.when(alike >= 0.2, F.round(alike * 0.6, 2))


def pairs(works: DataFrame, work: str, keys: Column, per_part: int = 1000, carried: tuple[str, ...] = ()) -> DataFrame:
    """a, b (a < b): works that share a key (an array for each work), each pair once; no others are ever compared.

    One side of a key with many works is parted, so that no task makes more than ``per_part`` works meet all others of a key.
    Pairs are made under the smallest of their common keys, so that none is made twice and the pairs, which can be many, are
    neither dealt out nor stored.  ``carried`` columns of both come along as a_ and b_ columns; each row is then a work of its own.
    """
    own = F.array_distinct(F.filter(keys, lambda k: k.isNotNull() & (k != "")))
    each = works.where(F.col(work).isNotNull()).select(F.col(work).alias("_w"), own.alias("_ks"), *carried)
    if not carried:
        # Rows of one work have their keys together.
        each = each.groupBy("_w").agg(F.array_distinct(F.flatten(F.collect_list("_ks"))).alias("_ks"))
    each = each.withColumn("_k", F.explode("_ks"))
    parts = each.groupBy("_k").agg(F.ceil(F.count(F.lit(1)) / per_part).cast("int").alias("_n"), F.count(F.lit(1)).alias("_c")).where("_c > 1").drop("_c")
    # Keys of a work beside the one it meets under; most works have none.
    each = each.hint("merge").join(parts, "_k").withColumn("_ks", F.when(F.size("_ks") > 1, F.col("_ks")))
    left = each.select(F.col("_w").alias("a"), "_k", F.col("_ks").alias("_ka"), F.pmod(F.xxhash64("_w"), F.col("_n")).alias("_p"), *[F.col(c).alias(f"a_{c}") for c in carried])
    right = each.select(F.col("_w").alias("b"), "_k", F.col("_ks").alias("_kb"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n").cast("long") - 1)).alias("_p"), *[F.col(c).alias(f"b_{c}") for c in carried])
    first = F.col("_ka").isNull() | F.col("_kb").isNull() | (F.array_min(F.array_intersect("_ka", "_kb")) == F.col("_k"))
    # Files say little about the size of what is read: no side is gathered in one place.
    return left.hint("merge").join(right, ["_k", "_p"]).where((F.col("a") < F.col("b")) & first).select("a", "b", *[f"a_{c}" for c in carried], *[f"b_{c}" for c in carried])


def correspondences(anchors: DataFrame, alignments: DataFrame, pair: str, start: str, end: str, width: float) -> DataFrame:
    """For anchors (pair, start, end) the other side of every aligned piece they meet: anchors' columns, other_start, other_end, other_text.

    ``alignments`` has pair, a_start, a_end, b_start, b_end, b_text; ``width`` is the usual length of a piece.
    """
    met = overlap_join(anchors, alignments, [pair], (start, end), ("a_start", "a_end"), width)
    return met.select(*anchors.columns, F.col("b_start").alias("other_start"), F.col("b_end").alias("other_end"), F.col("b_text").alias("other_text"))


def choose_link(candidates: DataFrame, entity: str, place: str, kind: Column, exact: Column, disambiguation: Column, described: Column, author: Column, year: Column, derived: Column, is_work: Column) -> DataFrame:
    """entity, place, points: the catalogue record of an entity, or no row where there is doubt.

    Only exact names with a description that is no disambiguation.  People: author 2, year 1; works, which need the author and to
    be called a work: 3, year 2, less 3 for derived ones, two at least.  Of equal best ones only the first of the search counts.
    """
    points = F.when(kind == "person", F.when(author, 2).otherwise(0) + F.when(year, 1).otherwise(0)).when(kind == "work", F.lit(3) + F.when(year, 2).otherwise(0) - F.when(derived, 3).otherwise(0)).otherwise(0)
    fit = exact & described & ~disambiguation & ((kind != "work") | (is_work & author))
    order = Window.partitionBy(entity).orderBy(F.desc("points"), place)
    best = candidates.withColumn("_first", F.min(place).over(Window.partitionBy(entity))).withColumn("points", points).withColumn("_work", kind == "work").where(fit)
    best = best.withColumn("_next", F.lead("points").over(order)).withColumn("_r", F.row_number().over(order)).where("_r = 1")
    sure = F.col("_next").isNull() | (F.col("_next") < F.col("points")) | (F.col(place) == F.col("_first"))
    return best.where(sure & (~F.col("_work") | (F.col("points") >= 2))).select(entity, place, "points")


def candidate_works(doc_hits: DataFrame, fragment_hits: DataFrame, relations: DataFrame, doc: str, score: str, rank: str, most: int = 12) -> DataFrame:
    """doc, points: works for a plan: 3 x document score + 1, plus 1 / (rank + 2) of each fragment hit (ranks from 0); then related works without points."""
    p = doc_hits.select(doc, (3 * F.col(score) + 1).alias("p")).unionByName(fragment_hits.select(doc, (1 / (F.col(rank) + 2)).alias("p")))
    base = p.groupBy(doc).agg(F.sum("p").alias("points")).orderBy(F.desc(F.round("points", 9)), doc).limit(most)
    # At most ``most`` rows.
    held = F.broadcast(base.select(doc))
    both = relations.select("a", "b").unionByName(relations.select(F.col("b").alias("a"), F.col("a").alias("b")))
    more = both.join(held.withColumnRenamed(doc, "a"), "a", "left_semi").select(F.col("b").alias(doc)).distinct().join(held, doc, "left_anti")
    return base.unionByName(more.withColumn("points", F.lit(0.0))).orderBy(F.desc(F.round("points", 9)), doc).limit(most)


def catalogue_rows(docs: DataFrame, segments: DataFrame, cards: DataFrame, mentions: DataFrame, relations: DataFrame, doc: str, entity: str, top: int = 12) -> DataFrame:
    """doc, n_segments, n_cards, n_mentions, n_relations, entities (the most mentioned, joined by commas): one row for each document."""
    count = lambda df, name: df.groupBy(doc).agg(F.count(F.lit(1)).alias(name))
    ends = relations.select(F.col("a").alias(doc)).unionByName(relations.select(F.col("b").alias(doc)))
    per = mentions.groupBy(doc, entity).agg(F.count(F.lit(1)).alias("_n"))
    best = per.withColumn("_r", F.row_number().over(Window.partitionBy(doc).orderBy(F.desc("_n"), entity))).where(F.col("_r") <= top)
    names = best.groupBy(doc).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", F.col(entity).cast("string").alias("e")))), lambda x: x["e"]), ",").alias("entities"))
    out = docs.select(doc)
    for df in (count(segments, "n_segments"), count(cards, "n_cards"), count(mentions, "n_mentions"), count(ends, "n_relations"), names):
        out = out.join(df, doc, "left")
    return out.na.fill(0, ["n_segments", "n_cards", "n_mentions", "n_relations"]).na.fill("", ["entities"])


def context_line(title: Column, author: Column, year: Column, section: Column, page: Column) -> Column:
    """Where a fragment stands, in one line: title, author, year, section, page, as far as known."""
    some = lambda c: F.nullif(F.trim(c.cast("string")), F.lit(""))
    return F.concat_ws(" · ", some(title), F.concat_ws(", ", some(author), some(year)), some(section), F.concat(F.lit("p. "), some(page)))


def embedding_input(context: Column, path: Column, text: Column) -> Column:
    """What is embedded of a fragment: its context, the headings above it and its text."""
    return F.concat_ws("\n", F.nullif(context, F.lit("")), F.nullif(F.array_join(path, " > "), F.lit("")), text)


_PRINTED_BY = r"(?:por|en casa de|en la imprenta de|imprenta de|printed by|printed for|chez|presso|apud)"
_NAME = r"\p{Lu}[\p{L}'-]*(?: (?:de|del|la|y|and|et|von|van|di|\p{Lu}[\p{L}'-]*))*"


def colophon(x: Column) -> dict[str, Column]:
    """place, printer and year (1400 to 1999, digits or a Roman numeral) of an imprint, null where it does not say."""
    got = lambda p: F.nullif(F.regexp_extract(x, p, 1), F.lit(""))
    digits = got(r"(?:^|[^\d])(1[4-9]\d{2})(?:[^\d]|$)").cast("int")
    roman = T.roman(F.regexp_replace(got(r"(?:^|[^\p{L}])(M[.]?(?:[CDLXVI][.]?){1,14})(?:[^\p{L}]|$)"), "[.]", ""))
    return {"place": got(rf"(?:^|[.;] *)(?:En|In|A|À|Impreso en|Printed at) ({_NAME})"), "printer": got(rf"(?:^|[ ,:;])(?i:{_PRINTED_BY}) ({_NAME})"), "year": F.coalesce(digits, roman)}


def printer_years(rows: DataFrame, printers: DataFrame, name: str) -> DataFrame:
    """Adds from_year, to_year, confidence of a printer's work.

    ``printers`` (bounded: a table of known printers) has printer, born, died, active_from, active_to.  A widow or
    heirs begin where the printer died (0.45); else the work begins with the activity (0.5) or 18 years after the birth (0.4).
    """
    heir = F.col(name).rlike(r"(?i)^(la )?viuda de |^(los )?herederos de |^widow of |^heirs of ")
    plain = T.key(F.regexp_replace(name, r"(?i)^(la )?viuda de |^(los )?herederos de |^widow of |^heirs of |^(la )?imprenta de ", ""))
    known = printers.select(T.key(F.col("printer")).alias("_k"), "born", "died", "active_from", "active_to")
    start = F.when(F.col("_heir"), F.col("died")).otherwise(F.coalesce(F.col("active_from"), F.col("born") + 18))
    end = F.when(~F.col("_heir"), F.coalesce("active_to", "died"))
    sure = F.when(F.col("_heir"), F.when(F.col("died").isNotNull(), 0.45)).when(F.col("active_from").isNotNull() | F.col("active_to").isNotNull(), 0.5).when(start.isNotNull() | end.isNotNull(), 0.4)
    got = rows.withColumn("_k", plain).withColumn("_heir", heir).join(known, "_k", "left")
    return got.select(*rows.columns, start.alias("from_year"), end.alias("to_year"), sure.alias("confidence"))
