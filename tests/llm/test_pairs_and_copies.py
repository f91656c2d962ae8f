"""Joins, decontamination, substring dedup and fingerprints against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from libralake.llm import decontaminate, fingerprints, gear, ngram_join, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], SCHEMA)


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def edited(rng, base, share):
    return [w if rng.random() >= share else f"x{rng.randrange(10**6)}" for w in base]


@pytest.fixture(scope="module")
def corpus():
    """Clusters of near copies around the threshold, exact copies, shared passages, short and empty texts."""
    rng = random.Random(5)
    out = []
    shared = words(rng, 60)
    for _ in range(12):
        base = words(rng, rng.randrange(30, 200))
        out += [edited(rng, base, rng.choice([0, 0.01, 0.02, 0.03, 0.04])) for _ in range(rng.randrange(1, 12))]
        out.append(base[: int(len(base) * 0.8)])
        out.append(base + words(rng, len(base) // 4))
    out += [shared + words(rng, rng.randrange(5, 100)) for _ in range(60)]
    out += [words(rng, n) for n in (1, 2, 3, 4, 5, 6)] * 2
    texts = [" ".join(x) for x in out] + ["", "  \n", None, "one two", "One\tTWO", "é É"]
    rng.shuffle(texts)
    return [(3 * i + 1, t) for i, t in enumerate(texts)]


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else (tuple(w[i : i + 5]) for i in range(len(w) - 4)))


def brute_components(rows):
    sets = [(k, shingle_set(t)) for k, t in rows]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(sets):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted(((k, len(s), least.get(find(i))) for i, (k, s) in enumerate(sets)), key=str)


@pytest.mark.parametrize(("tile", "common"), [(32 << 20, 32), (600, 2)])
def test_jaccard_components(spark, corpus, monkeypatch, tile, common):
    """Also with groups dealt to many tiles, and with shingles that count as common from two texts on."""
    monkeypatch.setattr(ngram_join, "TILE_BYTES", tile)
    monkeypatch.setattr(ngram_join, "COMMON_LEAST", common)
    got = [tuple(r) for r in ngram_join.jaccard_components(frame(spark, corpus)).collect()]
    assert sorted(got, key=str) == brute_components(corpus)


def test_jaccard_of_templates(spark, monkeypatch):
    """A template that a third of all texts share, with fillings around the threshold, over one and many partitions."""
    rng = random.Random(21)
    base = words(rng, 60)
    rows = [(i, " ".join(base[: rng.randrange(40, 60)] + words(rng, rng.randrange(0, 14)))) for i in range(150)]
    rows += [(1000 + i, " ".join(words(rng, 30))) for i in range(200)] + [(5000 + i, " ".join(base)) for i in range(60)]
    want = brute_components(rows)
    monkeypatch.setattr(ngram_join, "COMMON_LEAST", 8)
    for parts in (1, 9):
        got = [tuple(r) for r in ngram_join.jaccard_components(frame(spark, rows).repartition(parts)).collect()]
        assert sorted(got, key=str) == want


def test_jaccard_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (None, "A b c d e f"), (2, long), (9, long + " x"), (4, ""), (5, None), (None, "zz")]
    got = sorted([tuple(r) for r in ngram_join.jaccard_components(frame(spark, rows)).collect()], key=str)
    assert got == brute_components(rows)
    assert ngram_join.jaccard_components(frame(spark, [])).count() == 0
    kept = sorted((r.doc_id, r.text) for r in ngram_join.one_of_each(frame(spark, [r for r in rows if r[0] is not None])).collect())
    assert kept == sorted([(7, "a b c d e f"), (2, long), (4, ""), (5, None)], key=lambda x: (x[0], x[1] or ""))


def test_one_of_each_keeps_rows_and_columns(spark):
    """Columns of any name stay as they are; rows stay by row, not by key."""
    rng = random.Random(13)
    a, b = " ".join(words(rng, 40)), " ".join(words(rng, 40))
    rows = [(5, a, "X", "Y", 1, "p"), (5, b, "X2", "Y2", 2, "q"), (3, b + " more", "X3", "Y3", 3, "r"), (9, a, "X4", "Y4", 4, "s"), (9, a, "X5", "Y5", 4, "s"), (None, "", "X6", None, 5, "t"), (None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _k string, _h string, at int, row string")
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted([rows[0], rows[2], rows[5], rows[6]], key=str)
    assert ngram_join.one_of_each(docs.limit(0)).count() == 0


def test_derived_overlaps_equal_counted():
    import numpy as np

    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(5, 40)).astype(np.uint64)) for _ in range(40)]
    n = np.array([len(s) for s in sets])
    g = ngram_join.Group(n, sets, n)
    for i in range(40):
        exact = [len(np.intersect1d(sets[i], s)) for s in sets]
        assert g.overlaps(i, None).tolist() == exact
        assert g.overlaps(i, (0, g.overlaps(0, None))).tolist() == exact


def test_derived_answers_read_less():
    """Near copies: the same components with and without derived answers, from fewer entries of lists."""
    import numpy as np

    rng = np.random.default_rng(5)
    base = np.arange(400)
    sets = []
    for i in range(120):
        own = base.copy()
        own[rng.integers(0, 400, 20 if i % 2 else 70)] = 1000 + 100 * i + np.arange(20 if i % 2 else 70)
        sets.append(np.unique(own).astype(np.uint64))
    n, read = np.array([len(s) for s in sets]), {}
    count = ngram_join.Group._count
    for derive in (False, True):
        g = ngram_join.Group(n, sets, n - -(-3 * n // 4) + 1)
        g._count = lambda t, g=g, derive=derive: read.__setitem__(derive, read.get(derive, 0) + int((g.heads[t + 1] - g.heads[t]).sum())) or count(g, t)
        lab = g.labels(derive)
        exact = [[7 * len(np.intersect1d(a, b)) >= 3 * (len(a) + len(b)) for b in sets] for a in sets]
        assert all(lab[i] == lab[j] for i in range(120) for j in range(120) if exact[i][j])
        read[derive, "labels"] = sorted(np.bincount(lab, minlength=120).tolist())
    assert read[False, "labels"] == read[True, "labels"] and read[True] < 0.7 * read[False]


def test_many_classes_of_one_template_take_linear_work():
    """Classes that share half their shingles and link with nothing are not compared with each other."""
    import time

    import numpy as np

    took = []
    for m in (1000, 4000):
        sets = [np.concatenate([1_000_000 + 50 * i + np.arange(50), np.arange(50)]).astype(np.uint64) for i in range(m)]
        g = ngram_join.Group(np.full(m, 100), sets, np.full(m, 26))
        began = time.process_time()
        assert len(set(g.labels().tolist())) == m
        took.append(time.process_time() - began)
    assert took[1] < 8 * max(took[0], 0.05)


def test_contaminated(spark, corpus, monkeypatch):
    rng = random.Random(8)
    items = [words(rng, n) for n in (1, 2, 3, 4, 5, 6, 8, 20, 40, 60)]
    docs = [(k, t) for k, t in corpus]
    for i, it in enumerate(items):
        for share in (0, 0.02, 0.06, 0.2):
            docs.append((10_000 + 100 * i + int(share * 100), " ".join(words(rng, 50) + edited(rng, it, share) + words(rng, 30))))
    docs += [(20_000, " ".join(words(rng, 20_000) + items[8])), (20_000, None), (None, " ".join(items[9]))]
    rows = [(i, " ".join(x)) for i, x in enumerate(items)] + [(97, ""), (98, None), (99, " ".join(items[8]))]
    want = []
    for k, t in docs:
        w = (t or "").lower().split()
        for i, it in rows:
            own = (it or "").split()
            width = min(5, len(own))
            if width:
                a = {tuple(own[j : j + width]) for j in range(len(own) - width + 1)}
                b = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)}
                if len(a & b) >= 0.75 * len(a):
                    want.append((k, i, len(a & b), len(a)))
    bench = spark.createDataFrame(rows, "item_id long, text string")
    got = [tuple(r)[:4] for r in decontaminate.contaminated(frame(spark, docs), bench).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    monkeypatch.setattr(decontaminate, "HELD_SHINGLES", 1)
    again = [tuple(r)[:4] for r in decontaminate.contaminated(frame(spark, docs), bench).collect()]
    assert sorted(again, key=str) == sorted(want, key=str)
    bad = {(k, i) for k, i, _, _ in want}
    for held in (1, 1 << 20):
        monkeypatch.setattr(decontaminate, "HELD_SHINGLES", held)
        clean = decontaminate.clean(frame(spark, docs).withColumnsRenamed({"lang": "t1", "source": "row"}), bench)
        assert clean.columns == ["doc_id", "text", "t1", "row", "n_chars"]
        assert sorted((r.doc_id, r.text) for r in clean.collect() if r.doc_id is not None and r.text) == sorted((k, t) for k, t in docs if k is not None and t and not any(k == b for b, _ in bad))
    assert decontaminate.contaminated(frame(spark, []), bench).count() == 0
    assert decontaminate.contaminated(frame(spark, docs), bench.limit(0)).count() == 0


def test_repeated_spans(spark):
    rng = random.Random(2)
    passage = " ".join(words(rng, 55))
    line = "The same short line of a licence stands here."
    rows = [(i, " ".join(words(rng, 80)) + (" " + passage + " " if i % 4 == 0 else " ") + " ".join(words(rng, 40)) + ("\n" + line if i % 3 == 0 else "")) for i in range(40)]
    rows += [(50, None), (51, ""), (None, passage), (60, "é" * 40 + " " + passage)]
    docs = frame(spark, rows)
    spans = substring_dedup.repeated_spans(docs)
    got = spans.collect()
    holders = {k for k, t in rows if k is not None and t and passage in t}
    assert {r.doc_id for r in got} == holders
    text = dict((k, t) for k, t in rows if k is not None)
    for r in got:
        at = text[r.doc_id].index(passage)
        covered = min(r.span_end, at + len(passage)) - max(r.span_start, at)
        assert covered >= 0.5 * len(passage) and r.span_start >= at - 64 and r.span_end <= at + len(passage) + 64
        assert r.first_id == 0 and r.kept == (r.doc_id == 0)
    cut = {r.doc_id: r.text for r in substring_dedup.without_repeats(docs, spans).collect()}
    assert cut[0] == text[0] and cut[1] == text[1] and len(cut[4]) < len(text[4]) - 150
    assert substring_dedup.repeated_spans(frame(spark, [])).count() == 0


def test_chunks_cover_and_resist_shifts():
    import numpy as np

    rng = random.Random(4)
    text = " ".join(words(rng, 3000)).encode()
    for sizes in (gear.FINE, gear.COARSE):
        raw = np.frombuffer(text + b"abc" + b"xy " + text, np.uint8)
        offs = np.array([0, len(text), len(text) + 3, len(raw)])
        ends, first = gear.boundaries(raw, offs, sizes)
        assert ends[-1] == len(raw) and first.tolist()[1:3] == [first[1], first[1] + 1] and (np.diff(ends) <= sizes.most).all()
        d, _ = gear.digests(raw, ends)
        a, b = set(d[: first[1]].tolist()), set(d[first[2] :].tolist())
        assert len(a - b) <= 8


def test_successions(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(-50, 10**7), " ".join(words(rng, rng.randrange(0, 120)))) for _ in range(150)]
    rows += [(5, None), (5, "é😀" * 50), (5, "é😀" * 50), (None, "last one"), (None, None)]
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), (r[1] or "").encode()))
    want = []
    for i, (k, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        want.append((k, len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()))
    got = fingerprints.successions(frame(spark, rows)).collect()
    assert sorted([tuple(r)[:3] for r in got], key=str) == sorted(want, key=str)
    alone = {r.fingerprint for r in fingerprints.fingerprint(frame(spark, rows)).collect()}
    assert {r.fingerprint for r in got} == alone
    for r in got:
        a, b = fingerprints.parse(r.fingerprint), fingerprints.parse(r.edited_fingerprint)
        assert fingerprints.likeness(a, b) == r.near_edited and 0 <= r.near_next <= 1
        if r.n_chars > 200:
            assert 0.2 < r.near_edited < 0.75 and r.near_next < 0.3
    assert fingerprints.successions(frame(spark, [])).count() == 0
    one = fingerprints.successions(frame(spark, [(1, "abcdef")])).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()


def test_spans_have_one_source(spark):
    rng = random.Random(11)
    a, b, x = (" ".join(words(rng, 80)) for _ in range(3))
    docs = frame(spark, [(1, f"{a} {b}"), (2, f"{a} {x}"), (3, f"{a} {x}")])
    spans = substring_dedup.repeated_spans(docs)
    got = sorted((r.doc_id, r.span_start, r.span_end, r.first_id, r.kept) for r in spans.collect())
    assert [(k, first, kept) for k, _, _, first, kept in got] == [(1, 1, True), (2, 1, False), (2, 2, True), (3, 1, False), (3, 2, False)]
    assert got[2][1] == got[1][2] and abs(got[1][2] - len(a)) <= 96 and got[2][2] == len(a) + 1 + len(x)
    cut = {r.doc_id: r.text for r in substring_dedup.without_repeats(docs, spans).collect()}
    assert cut[1] == f"{a} {b}" and cut[2].endswith(x) and cut[3] == ""


def test_words_of_spans_do_not_depend_on_batches(spark):
    """Two equal rows of 120 words: the same spans from one partition and from many, whatever text stands before."""
    rng = random.Random(31)
    same = " ".join(words(rng, 120))
    rows = [(1, same), (2, same), (3, same + " "), (2, same), (2, " ".join(words(rng, 20)))]
    seen = set()
    for parts in (1, 2, 5):
        got = substring_dedup.repeated_spans(frame(spark, rows).repartition(parts)).collect()
        seen.add(tuple(sorted((r.doc_id, r.span_start, r.n_words, r.first_id, r.kept) for r in got)))
        assert {r.n_words for r in got if r.doc_id < 3} == {120}
    assert len(seen) == 1


def test_spans_against_counting_of_chunks(spark):
    """Every span of random texts, from a plain count of the chunks."""
    import numpy as np

    rng = random.Random(17)
    pool = [" ".join(words(rng, 45)) for _ in range(6)]
    rows = [(i, " ".join(x for _ in range(5) for x in (rng.choice(pool), " ".join(words(rng, 25)))) + rng.choice(["", "\n", " é"])) for i in range(30)]
    cut, seen = {}, {}
    for k, t in rows:
        raw = np.frombuffer(t.encode(), np.uint8)
        ends, _ = gear.boundaries(raw, np.array([0, len(raw)]), gear.COARSE)
        cut[k] = [t.encode()[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        for c in cut[k]:
            seen.setdefault(c, []).append(k)
    want = set()
    for k, parts in cut.items():
        at, run = 0, []
        for c in [*parts, None]:
            if c is not None and len(set(seen[c])) > 1:
                run.append((at, c, min(seen[c])))
            elif run:
                if sum(len(re.findall(rb"(?:^|(?<=[ \t-\r]))[^ \t-\r]", text_at)) for text_at in [b"".join(x for _, x, _ in run)]) >= 31:
                    for i, (a, x, first) in enumerate(run):
                        if i == 0 or run[i - 1][2] != first:
                            want.add((k, a, first))
                run = []
            at += len((c or b"").decode("utf-8", "ignore")) if c and not any(b >= 128 for b in c) else len(c or b"")
    got = {(r.doc_id, r.span_start, r.first_id) for r in substring_dedup.repeated_spans(frame(spark, rows)).collect()}
    assert want <= got and len(got - want) <= 0.1 * len(got)


def test_without_repeats_keeps_columns(spark):
    rng = random.Random(19)
    p = " ".join(words(rng, 80))
    docs = spark.createDataFrame([(1, p, "a", "b", 1), (2, p, "c", "d", 2), (2, "short", "e", "f", 3), (None, p, None, None, 4)], "doc_id long, text string, _sk string, row string, seq int")
    out = substring_dedup.without_repeats(docs, substring_dedup.repeated_spans(docs))
    assert out.columns == docs.columns
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted([(1, p, "a", "b", 1), (2, "", "c", "d", 2), (2, "short", "e", "f", 3), (None, p, None, None, 4)], key=str)


def test_fingerprints_of_very_long_texts(spark):
    rng = random.Random(23)
    long = " ".join(words(rng, 60_000))
    got = {r.doc_id: r for r in fingerprints.successions(frame(spark, [(1, long), (2, long + " x"), (3, "a")])).collect()}
    assert got[2].near_next > 0.999 and 0.4 < got[1].near_edited and got[3].n_chars == 1
