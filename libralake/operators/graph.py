"""Entities and graphs: mentions, co-occurrence, neighbours, paths, components, resolution."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import shared_folder


def _saved(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage by a table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mentions(docs: DataFrame, forms: DataFrame, key: str, text: str, owner: str, form: str, cased: str | None = None) -> DataFrame:
    """key, owner, start (word place), n_words: where a form stands in a text; of overlapping ones the longest, then the first, stays.

    Forms of any length are joined by equality with the word runs of each text: no text meets all forms.  A form that
    two owners claim names neither, but covers what is inside it.  Where ``cased`` is true, the words must stand as the form writes them.
    """
    raw = lambda c: F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    known = forms.select(F.array_join(T.tokens(F.col(form)), " ").alias("_run"), F.array_join(raw(F.col(form)), " ").alias("_own"), F.size(T.tokens(F.col(form))).alias("n_words"), F.col(owner).alias("_o"), (F.col(cased) if cased else F.lit(False)).alias("_c"))
    known = known.where("_run <> ''").groupBy("_run", "n_words").agg(F.min("_o").alias("_o"), F.max("_o").alias("_o2"), F.collect_set("_own").alias("_own"), F.min("_c").alias("_c"))
    known = known.withColumn(owner, F.when(F.col("_o") == F.col("_o2"), F.col("_o"))).drop("_o", "_o2")
    # One number for each length of forms that occurs.
    lengths = sorted(r[0] for r in known.select("n_words").distinct().collect())
    if not lengths:
        return docs.select(key).join(forms.select(owner), F.lit(False)).select(key, owner, F.lit(0).alias("start"), F.lit(0).alias("n_words"))
    toks = docs.select(key, T.tokens(F.col(text)).alias("_t"), (raw(F.col(text)) if cased else F.array().cast("array<string>")).alias("_r"))
    runs = []
    for n in lengths:
        at = F.when(F.size("_t") >= n, F.sequence(F.lit(1), F.size("_t") - (n - 1))).otherwise(F.array().cast("array<int>"))
        own = F.array_join(F.slice("_r", F.col("start"), n), " ") if cased else F.lit("")
        runs.append(toks.select(key, F.explode(at).alias("start"), "_t", "_r").select(key, "start", F.array_join(F.slice("_t", F.col("start"), n), " ").alias("_run"), own.alias("_is")))
    hit = reduce(DataFrame.unionByName, runs).join(known, "_run").where(~F.col("_c") | F.array_contains("_own", F.col("_is"))).drop("_run", "_own", "_c", "_is")
    # Chains of overlapping forms; in each the longest are taken first.
    w = Window.partitionBy(key).orderBy("start", "n_words")
    reach = F.max(F.col("start") + F.col("n_words")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    chained = hit.withColumn("_new", F.when(F.col("start") < reach, 0).otherwise(1)).withColumn("_chain", F.sum("_new").over(w))
    spans = chained.groupBy(key, "_chain").agg(F.sort_array(F.collect_list(F.struct((-F.col("n_words")).alias("m"), "start", "n_words", owner))).alias("_all"))
    clear = lambda kept, x: ~F.exists(kept, lambda o: (o["start"] < x["start"] + x["n_words"]) & (x["start"] < o["start"] + o["n_words"]))
    kept = F.aggregate("_all", F.slice("_all", 1, 0), lambda acc, x: F.when(clear(acc, x), F.array_append(acc, x)).otherwise(acc))
    return spans.select(key, F.explode(kept).alias("_m")).where(F.col("_m")[owner].isNotNull()).select(key, F.col("_m")[owner].alias(owner), F.col("_m.start").alias("start"), F.col("_m.n_words").alias("n_words"))


def cooccurrence(ments: DataFrame, doc: str, part: str, entity: str, at: str | None = None, most: int = 40, adjacent: float = 0.15) -> DataFrame:
    """a, b, doc, weight: entities of one part 0.4 + 0.6 exp(-gap/400) with the closest gap, of neighbouring parts ``adjacent``; a < b.

    Parts count their ``most`` first entities, as the weights are defined.  Pairs are made within a part only.
    """
    m = ments.groupBy(doc, part, entity).agg(F.sort_array(F.collect_set(F.col(at) if at else F.lit(0))).alias("at"))
    m = m.withColumn("_n", F.row_number().over(Window.partitionBy(doc, part).orderBy(entity))).where(F.col("_n") <= most).drop("_n")
    x = m.select(doc, part, F.col(entity).alias("a"), F.col("at").alias("at_a"))
    y = m.select(doc, part, F.col(entity).alias("b"), F.col("at").alias("at_b"))
    gap = F.array_min(F.flatten(F.transform("at_a", lambda p: F.transform("at_b", lambda q: F.abs(p - q)))))
    same = x.join(y, [doc, part]).where("a < b").select(doc, "a", "b", (0.4 + 0.6 * F.exp(-gap / 400.0)).alias("w"))
    z = y.withColumn(part, F.col(part) - 1)
    near = x.join(z, [doc, part]).where("a <> b").select(doc, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(adjacent).alias("w"))
    return same.unionByName(near).groupBy(doc, "a", "b").agg(F.round(F.sum("w"), 3).alias("weight"))


def neighbours(edges: DataFrame, k: int, a: str = "a", b: str = "b", weight: str = "weight", doc: str | None = None) -> DataFrame:
    """node, other, weight, n_docs, rank: the k strongest neighbours of every node."""
    cols = [F.sum(weight).alias("weight"), (F.countDistinct(doc) if doc else F.count(F.lit(1))).alias("n_docs")]
    # A pair is summed once, then seen from both ends.
    pair = edges.groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(*cols)
    total = pair.select(F.col("a").alias("node"), F.col("b").alias("other"), "weight", "n_docs").unionByName(pair.where("a <> b").select(F.col("b").alias("node"), F.col("a").alias("other"), "weight", "n_docs"))
    w = Window.partitionBy("node").orderBy(F.desc(F.round("weight", 6)), "other")
    return total.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def path(edges: DataFrame, start, goal, hops: int = 4, strongest: int = 40, cap: float = 5.0, node: str = "node", other: str = "other", weight: str = "weight") -> DataFrame:
    """One row with the strongest of the shortest paths (nodes joined by >) and its strength, or none.

    A frontier of best paths by node grows hop by hop; each node keeps its ``strongest`` edges, edge weights are capped.
    """
    w = Window.partitionBy(node).orderBy(F.desc(weight), other)
    near = edges.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= strongest).select(F.col(node).alias("_from"), F.col(other).alias("_to"), F.least(F.col(weight), F.lit(cap)).alias("_w"))
    near = _saved(near, "edges")
    spark = edges.sparkSession
    front = spark.createDataFrame([(start, 0.0, str(start))], f"at {edges.schema[node].dataType.simpleString()}, strength double, path string")
    seen = front.select("at")
    for hop in range(hops):
        step = front.join(near, F.col("at") == F.col("_from")).select(F.col("_to").alias("at"), (F.col("strength") + F.col("_w")).alias("strength"), F.concat_ws(">", "path", F.col("_to").cast("string")).alias("path"))
        step = step.join(seen, "at", "left_anti").groupBy("at").agg(F.max(F.struct("strength", "path")).alias("_b")).select("at", "_b.strength", "_b.path")
        front = _saved(step, "front")
        found = front.where(F.col("at") == F.lit(goal))
        if found.count():
            return found.select("path", "strength", F.lit(hop + 1).alias("hops"))
        seen = seen.unionByName(front.select("at"))
    return front.limit(0).select("path", "strength", F.lit(0).alias("hops"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node): alternating large and small stars until nothing changes."""
    now = _saved(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "star")
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        now = _saved(small, "star")
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def shared_entities(ments: DataFrame, doc: str, entity: str, target, most: int = 8, most_docs: int = 1000) -> DataFrame:
    """Other documents by number of entities they share with the target: doc, n_shared, names."""
    own = ments.where(F.col(doc) == target).select(entity).distinct()
    return ments.where(F.col(doc) != target).join(own, entity).groupBy(doc).agg(F.countDistinct(entity).alias("n_shared"), F.array_join(F.slice(F.sort_array(F.collect_set(entity)), 1, 20), ",").alias("names")).orderBy(F.desc("n_shared"), doc).limit(most)


def redirects(links: DataFrame, src: str, dst: str, hops: int = 12) -> DataFrame:
    """src, final: where chains of redirects end (at most ``hops`` links; rings stop there), by pointer doubling."""
    now = links.select(F.col(src).alias("_s"), F.col(dst).alias("_d"))
    step = 1
    while step < hops:
        nxt = now.select(F.col("_s").alias("_d"), F.col("_d").alias("_e"))
        now = _saved(now.join(nxt, "_d", "left").select("_s", F.coalesce("_e", "_d").alias("_d")), "redirect")
        step *= 2
    return now.select(F.col("_s").alias(src), F.col("_d").alias("final"))


def resolve(entities: DataFrame, key: str, name: str, kind: str, fictional: str, linked: str, n_mentions: str) -> DataFrame:
    """key, winner: entities with one comparison key and kind are one; the real and the fictional never are.

    The winner is linked before unlinked, then has more words, more mentions, the smaller key.
    """
    group = [kind, fictional, "_k"]
    e = entities.withColumn("_k", T.key(F.col(name)))
    order = [F.desc(F.col(linked).cast("int")), F.desc(F.size(F.split(name, " "))), F.desc(n_mentions), key]
    first = F.first(key).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return e.select(key, F.when(F.col("_k") == "", F.col(key)).otherwise(first).alias("winner"))


def merge_links(entities: DataFrame, places: DataFrame, key: str, doc: str, name: str, kind: str, aliases: str, linked: str, n_mentions: str) -> DataFrame:
    """rule, a, b: which entities of one kind may be one.

    1: one catalogue record.  2: a form of one is the name of another and fits its own name, or has only words of it, however short;
    a form of one word only where both stand in one document.  3: a person known by the last word alone, with the only full name of a shared document that ends in it and is
    mentioned as often.  4: first and last word of the only longer name that has all the words.
    """
    e = entities.select(F.col(key).alias("id"), F.col(kind).alias("kind"), F.col(name).alias("name"), T.key(F.col(name)).alias("k"), F.col(aliases).alias("forms"), F.col(linked).alias("link"), F.col(n_mentions).alias("m"))
    e = e.withColumn("w", F.split("k", " ")).where("k <> '' and kind <> 'date'")
    at = places.select(F.col(key).alias("id"), F.col(doc).alias("doc")).distinct()
    # The first entity of a record, so that records with many entities make no pairs.
    named = e.where("link is not null").select("kind", "link", "id")
    one = named.join(named.groupBy("kind", "link").agg(F.min("id").alias("a")), ["kind", "link"]).where("a <> id").select(F.lit(1).alias("rule"), "a", F.col("id").alias("b"))
    forms = e.select("id", "kind", "name", F.explode("forms").alias("form"))
    part = (F.size(T.tokens(F.col("form"))) > 0) & (F.size(F.array_except(T.tokens(F.col("form")), T.tokens(F.col("name")))) == 0)
    forms = forms.where(compatible(F.col("form"), F.col("name")) | part).select(F.col("id").alias("a"), "kind", T.key(F.col("form")).alias("k"))
    met = forms.join(e.groupBy("kind", "k").agg(F.max("id").alias("b")), ["kind", "k"]).where("a <> b")
    long = met.where("instr(k, ' ') > 0").select("a", "b")
    short = met.where("instr(k, ' ') = 0").select("a", "b").distinct()
    together = short.join(at.withColumnRenamed("id", "a"), "a").join(at.withColumnRenamed("id", "b"), ["b", "doc"]).select("a", "b").distinct()
    two = long.unionByName(together).select(F.lit(2).alias("rule"), "a", "b")
    people = e.where("kind = 'person'")
    full = people.where(F.size("w") >= 2).select("id", "m", "w", F.element_at("w", -1).alias("last"), F.col("w")[0].alias("first"))
    alone = people.where((F.size("w") == 1) & (F.length("k") >= 3)).select(F.col("id").alias("a"), F.col("m").alias("m_a"), F.col("k").alias("last"))
    near = alone.join(at.withColumnRenamed("id", "a"), "a").join(full.join(at, "id").select(F.col("id").alias("b"), "m", "last", "doc"), ["last", "doc"]).select("a", "m_a", "b", "m").distinct()
    three = near.groupBy("a", "m_a").agg(F.count(F.lit(1)).alias("n"), F.max("b").alias("b"), F.max("m").alias("m")).where("n = 1 and m >= m_a").select(F.lit(3).alias("rule"), "a", "b")
    other = full.select(F.col("id").alias("b"), F.col("w").alias("w_b"), "first", "last")
    inner = full.select(F.col("id").alias("a"), "w", "first", "last").join(other, ["first", "last"]).where((F.size("w_b") > F.size("w")) & (F.size(F.array_except("w", "w_b")) == 0))
    four = inner.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.max("b").alias("b")).where("n = 1").select(F.lit(4).alias("rule"), "a", "b")
    return one.unionByName(two).unionByName(three).unionByName(four)


def constrained(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """key, winner: components of links taken in the order of their rule, without those that would join the real and the fictional.

    ``links``: rule, a, b; ``nodes``: key, rank (a struct, the smallest of a component names it), fic (true, false or null: unknown).
    A link that is the first of all at both its ends is decided: it joins the two components, or is dropped for good where
    one is known as real and the other as fictional.  All such links of a round are decided at once, as one after the other would;
    within a rule the order is that of a hash, so that rounds are few.
    """
    now = _saved(nodes.select("key", F.col("key").alias("label")), "labels")
    groups = _saved(nodes.select(F.col("key").alias("label"), "rank", "fic"), "groups")
    left = links.select("rule", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").groupBy("a", "b").agg(F.min("rule").alias("rule"))
    left = _saved(left.select(F.struct("rule", F.xxhash64("a", "b").alias("h"), F.col("a").alias("x"), F.col("b").alias("y")).alias("o"), "a", "b"), "links")
    while left.limit(1).count():
        ends = left.select("o", F.explode(F.array("a", "b")).alias("label")).groupBy("label").agg(F.min("o").alias("first"))
        due = left.join(ends.withColumnRenamed("label", "a").withColumnRenamed("first", "_a"), "a").where("o = _a").join(ends.withColumnRenamed("label", "b").withColumnRenamed("first", "_b"), "b").where("o = _b").select("o", "a", "b")
        side = lambda s: groups.select(F.col("label").alias(s), F.col("rank").alias(f"r{s}"), F.col("fic").alias(f"f{s}"))
        due = due.join(side("a"), "a").join(side("b"), "b")
        apart = F.coalesce(F.col("fa") != F.col("fb"), F.lit(False))
        first = F.col("ra") <= F.col("rb")
        due = _saved(due.select("o", apart.alias("apart"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("win"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("lose"), F.coalesce("fa", "fb").alias("fic")), "due")
        moved = due.where("not apart").select(F.col("lose").alias("label"), F.col("win").alias("_to"))
        known = due.where("not apart").select(F.col("win").alias("label"), F.col("fic").alias("_f"), F.lit(True).alias("_w"))
        now = _saved(now.join(moved, "label", "left").select("key", F.coalesce("_to", "label").alias("label")), "labels")
        groups = _saved(groups.join(moved, "label", "left_anti").join(known, "label", "left").select("label", "rank", F.when(F.col("_w"), F.col("_f")).otherwise(F.col("fic")).alias("fic")), "groups")
        end = lambda df, s: df.join(moved.select(F.col("label").alias(s), F.col("_to").alias(f"_{s}")), s, "left").withColumn(s, F.coalesce(f"_{s}", s)).drop(f"_{s}")
        rest = end(end(left.join(due.select("o"), "o", "left_anti"), "a"), "b").where("a <> b")
        left = _saved(rest.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("o").alias("o")).select("o", "a", "b"), "links")
    return now.select("key", F.col("label").alias("winner"))


def merged(entities: DataFrame, places: DataFrame, key: str, doc: str, name: str, kind: str, aliases: str, linked: str, n_mentions: str, fictional: str) -> DataFrame:
    """key, winner of every entity, after all rules of ``merge_links``; people known as real and as fictional are never one.

    The winner is linked before unlinked, then has more words, more mentions (an unknown number is the least), the smaller key.
    Of rows with one key the best counts, rows without a key are no entities.
    """
    entities = entities.where(F.col(key).isNotNull())
    links = merge_links(entities, places, key, doc, name, kind, aliases, linked, n_mentions)
    much = F.col(n_mentions).cast("double")
    rank = F.struct(F.col(linked).isNull().alias("l"), (-F.size(F.split(T.key(F.col(name)), " "))).alias("w"), much.isNull().alias("u"), (~F.isnan(much)).alias("n"), (-much).alias("m"), F.col(key).alias("k"))
    nodes = entities.select(F.col(key).alias("key"), rank.alias("rank"), F.when(F.col(kind) == "person", F.col(fictional)).alias("fic")).groupBy("key").agg(F.min("rank").alias("rank"), F.bool_or("fic").alias("fic"))
    return constrained(links, nodes).withColumnRenamed("key", key)


def idf_overlap(ments: DataFrame, pairs: DataFrame, doc: str, entity: str, a: str, b: str) -> DataFrame:
    """a, b, overlap: shared weight of rare entities over the smaller total of the two documents, for given pairs."""
    own = ments.select(doc, entity).distinct()
    n = own.select(doc).distinct().agg(F.count(F.lit(1)).alias("_n"))
    idf = own.groupBy(entity).agg(F.count(F.lit(1)).alias("_df")).crossJoin(F.broadcast(n)).select(entity, F.log(1 + F.col("_n") / F.col("_df")).alias("idf"))
    mass = own.join(idf, entity)
    total = mass.groupBy(doc).agg(F.sum("idf").alias("t"))
    both = pairs.join(mass.withColumnRenamed(doc, a), a).join(own.withColumnRenamed(doc, b), [b, entity]).groupBy(a, b).agg(F.sum("idf").alias("c"))
    return both.join(total.select(F.col(doc).alias(a), F.col("t").alias("ta")), a).join(total.select(F.col(doc).alias(b), F.col("t").alias("tb")), b).select(a, b, (F.col("c") / F.least("ta", "tb")).alias("overlap"))


def degree(edges: DataFrame, a: str, b: str, confidence: Column | None = None) -> DataFrame:
    """node, n_out, n_in over edges that meet the confidence predicate."""
    e = edges if confidence is None else edges.where(confidence)
    return e.select(F.col(a).alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col(b).alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"))).groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def complete_mentions(docs: DataFrame, ments: DataFrame, forms: DataFrame, key: str, text: str, owner: str, form: str) -> DataFrame:
    """Mentions that forms with a single owner have in the texts and the given mentions lack: key, owner, start, n_words."""
    return mentions(docs, forms, key, text, owner, form).join(ments.select(key, owner, "start"), [key, owner, "start"], "left_anti")


def search_entities(entities: DataFrame, query: str, key: str, name: str, aliases: str, weight: str, most: int = 20) -> DataFrame:
    """Entities whose name or alias holds the query (articles left out), those that begin with it first."""
    import re

    q = re.sub(r"^(the|el|la|los|las|le|les|der|die|das) ", "", query.lower().translate(str.maketrans(T.ACCENTED, T.PLAIN)).strip())
    n = T.key(F.col(name))
    any_alias = F.exists(F.col(aliases), lambda a: F.contains(T.key(a), F.lit(q)))
    hit = entities.where(F.contains(n, F.lit(q)) | F.coalesce(any_alias, F.lit(False)))
    return hit.orderBy(F.desc(F.startswith(n, F.lit(q))), F.desc(weight), key).limit(most)


def neighbourhood(edges: DataFrame, centre, hops: int = 2, most: int = 48, visible: float = 0.8) -> DataFrame:
    """Edges (node, other, weight) around a node: its strongest neighbours, and theirs where strong enough to be seen."""
    first = edges.where(F.col("node") == F.lit(centre)).orderBy(F.desc("weight"), "other").limit(most)
    if hops == 1:
        return first.select("node", "other", "weight")
    held = F.broadcast(first.select(F.col("other").alias("node")))
    inner = edges.where(F.col("weight") >= visible).join(held, "node", "left_semi").join(held.withColumnRenamed("node", "other"), "other", "left_semi").where("node < other")
    return first.select("node", "other", "weight").unionByName(inner.select("node", "other", "weight"))


def timeline(ments: DataFrame, dates: DataFrame, docs: DataFrame, part: str, doc: str, year: str) -> DataFrame:
    """part, doc, year: one row for each part with a mention, with its own date else the document's; undated ones last."""
    own = dates.groupBy(part).agg(F.min(year).alias("_own"))
    rows = ments.select(part, doc).distinct().join(own, part, "left").join(docs.select(doc, F.col(year).alias("_doc")), doc, "left")
    return rows.select(part, doc, F.coalesce("_own", "_doc").alias(year)).orderBy(F.asc_nulls_last(year), part)


def entities_of(ments: DataFrame, doc: str, entity: str, part: str, target) -> DataFrame:
    """entity, n, parts (sorted): the entities of one document and where they stand."""
    return ments.where(F.col(doc) == target).groupBy(entity).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set(part)).alias("parts"))


def labels_to_redo(edges: DataFrame, names: DataFrame, key: str, name: str, a: str, b: str, sentence: str) -> DataFrame:
    """Labelled edges whose sentence does not name both ends."""
    side = lambda c, out: names.select(F.col(key).alias(c), T.key(F.col(name)).alias(out))
    s = T.key(F.col(sentence))
    return edges.join(side(a, "_na"), a).join(side(b, "_nb"), b).where(~(F.contains(s, F.col("_na")) & F.contains(s, F.col("_nb")))).drop("_na", "_nb")


def merge_entities(rows: DataFrame, kind: str, name: str, forms: str, importance: str, analysis: str) -> DataFrame:
    """One row for each kind and comparison key: all forms, largest importance, first analysis that is there."""
    k = T.key(F.col(name))
    return rows.groupBy(kind, k.alias("entity_key")).agg(F.array_distinct(F.flatten(F.collect_list(forms))).alias(forms), F.max(importance).alias(importance), F.min(F.when(F.col(analysis).isNotNull(), F.struct(name, analysis))).alias("_a")).withColumn(analysis, F.col(f"_a.{analysis}")).drop("_a")


def compatible(a: Column, b: Column) -> Column:
    """Whether two forms may name one entity: a shared word of three letters or more, words alike for five letters, or initials in order."""
    x, y = T.tokens(a), T.tokens(b)
    long = lambda ws: F.filter(ws, lambda w: F.length(w) >= 3)
    heads = lambda ws: F.transform(F.filter(ws, lambda w: F.length(w) >= 5), lambda w: F.substring(w, 1, 5))
    first = lambda ws: F.array_join(F.transform(ws, lambda w: F.substring(w, 1, 1)), "")
    short = lambda ws: (F.size(ws) > 1) & F.forall(ws, lambda w: F.length(w) == 1)
    initials = (short(x) & (F.array_join(x, "") == first(y))) | (short(y) & (F.array_join(y, "") == first(x)))
    return F.arrays_overlap(long(x), long(y)) | F.arrays_overlap(heads(x), heads(y)) | initials


#: Words of descriptions that say nothing; a parameter of ``corroborated``.
GENERIC = ("american", "british", "english", "french", "german", "italian", "spanish", "writer", "person", "author", "escritor", "persona", "autor", "espanol", "espanola", "estadounidense")


def corroborated(description: Column, context: Column, generic: tuple[str, ...] = GENERIC) -> Column:
    """Whether the passages about someone have a telling word of a description: five letters or more, whole, or seven or more but for the last two."""
    told = F.filter(F.split(T.key(description), " "), lambda w: (F.length(w) >= 5) & ~w.isin(*generic) & ~w.rlike(r"^\d+$"))
    seen = F.concat(F.lit(" "), T.key(context), F.lit(" "))
    begins = lambda w: (F.length(w) >= 7) & F.contains(seen, F.concat(F.lit(" "), F.substring(w, F.lit(1), F.length(w) - 2)))
    return F.exists(told, lambda w: F.contains(seen, F.concat(F.lit(" "), w, F.lit(" "))) | begins(w))


def rehome(ments: DataFrame, doc: str, kind: str, name: str, form: str) -> DataFrame:
    """doc, kind, name, form, home: the name that each form of a mention belongs to.

    Its own name where the form can name it; else the only other name of the document that it can name; else the form itself.
    """
    each = ments.select(doc, kind, name, form).distinct()
    others = each.select(doc, kind, F.col(name).alias("_other")).distinct()
    lost = each.where(~compatible(F.col(form), F.col(name)))
    met = lost.join(others, [doc, kind]).where((F.col("_other") != F.col(name)) & compatible(F.col(form), F.col("_other")))
    one = met.groupBy(doc, kind, name, form).agg(F.min("_other").alias("_home"), F.countDistinct(T.key(F.col("_other"))).alias("_c"))
    lost = lost.join(one, [doc, kind, name, form], "left").select(doc, kind, name, form, F.when(F.col("_c") == 1, F.col("_home")).otherwise(F.trim(F.regexp_replace(form, r"\s+", " "))).alias("home"))
    return each.where(compatible(F.col(form), F.col(name))).withColumn("home", F.col(name)).unionByName(lost)


def recount(ments: DataFrame, entity: str, doc: str) -> DataFrame:
    """entity, n_mentions, n_docs."""
    return ments.groupBy(entity).agg(F.count(F.lit(1)).alias("n_mentions"), F.countDistinct(doc).alias("n_docs"))


def lookup(names: DataFrame, forms: DataFrame, name: str, owner: str, form: str) -> DataFrame:
    """names' columns and owner: by the whole form, else by its first word; null where two owners claim it or none does."""
    k = forms.select(T.key(F.col(form)).alias("_k"), F.col(owner).alias("_o")).distinct()
    single = lambda df: df.groupBy("_k").agg(F.min("_o").alias("_o"), F.countDistinct("_o").alias("_c")).where("_c = 1").drop("_c")
    heads = k.select(F.split_part("_k", F.lit(" "), F.lit(1)).alias("_k"), "_o").distinct()
    rows = names.withColumn("_full", T.key(F.col(name))).withColumn("_head", F.split_part("_full", F.lit(" "), F.lit(1)))
    claimed = k.select("_k").distinct().withColumn("_known", F.lit(True))
    rows = rows.join(single(k).withColumnRenamed("_o", "_a"), F.col("_full") == F.col("_k"), "left").drop("_k").join(claimed, F.col("_full") == F.col("_k"), "left").drop("_k")
    rows = rows.join(single(heads).withColumnRenamed("_o", "_b"), F.col("_head") == F.col("_k"), "left").drop("_k")
    # A form that two owners claim is not looked up by its first word.
    return rows.select(*names.columns, F.coalesce("_a", F.when(F.col("_known").isNull(), F.col("_b"))).alias(owner))
