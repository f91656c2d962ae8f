"""Codecs, counts, scans, extraction and the classifier against libraries and brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from libralake.llm import html_text, licenses, quality, queries, secrets, token_counts, word_bpe

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = queries.tokenizer("word_bpe_49k.json")
PIECE = queries.tokenizer("piece_bpe_32k.model")


def frame(spark, rows, source="s"):
    return spark.createDataFrame([(k, t, "en", source if isinstance(source, str) else source(k), len(t or "")) for k, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    letters = "aAbcdefgh  \n\t\x1c\x85 é̈ΣςİK12３Ⅷ²!?'s'll<|>startoftext▁日本語😀ﬁ​　ñç--__\x00&#"
    out = ["", "  ", " ", "a  b", "<|startoftext|>", "x<|endoftext|>y <|startoftext|>", "don't'S we'LL", "ΑΣ ΣΑΣ", "é ̈", "a\x1cb", "İstanbul", "<s></s> <0x0A>", " lead", "trail ", "\n\n x\n", "▁▁a ▁"]
    out += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    out += ["".join(rng.choice("abcdeothirnsl") for _ in range(rng.randint(1, 40))) for _ in range(300)]
    return out + ["long words " * 30_000]


def test_word_bpe(spark, texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(WORD)
    rows = [(i, t) for i, t in enumerate(texts)] + [(-1, None), (3, texts[3])]
    full = {(r.doc_id): r for r in word_bpe.encode(frame(spark, rows), WORD).collect()}
    short = {(r.doc_id): r for r in word_bpe.encode_digests(frame(spark, rows), WORD).collect()}
    for k, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        assert full[k].ids == ids and full[k].n_tokens == len(ids) and full[k].decoded == text, repr(t)
        assert short[k].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert short[k].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    back = {r.doc_id: r.decoded for r in word_bpe.decode(spark.createDataFrame([(k, r.ids) for k, r in full.items()], "doc_id long, ids array<int>"), WORD).collect()}
    assert back == {k: r.decoded for k, r in full.items()}
    assert word_bpe.encode(frame(spark, []), WORD).count() == 0


def test_token_counts(spark, texts):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    rows = [(i, t) for i, t in enumerate(texts)] + [(-1, None)]
    for r in token_counts.token_counts(frame(spark, rows), PIECE, limit=20).collect():
        t = (dict(rows)[r.doc_id]) or ""
        n = len(lib.encode(t))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 20), repr(t)
        if n <= 20:
            assert r.fit_chars == len(t)
        elif len(t) < 100:
            assert r.fit_chars == max(i for i in range(len(t)) if len(lib.encode(t[:i])) <= 20)


def test_prefix_table(spark, texts):
    import sentencepiece
    from pyspark.sql import functions as F

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    rows = [(i, t) for i, t in enumerate(texts) if len(t) < 70][:200] + [(-1, None), (-2, "")]
    table = token_counts.prefix_table(frame(spark, rows), PIECE)
    got = {r.doc_id: r for r in table.select("doc_id", "counts", token_counts.counted(7).alias("seven"), token_counts.fitting(5).alias("fit")).collect()}
    for k, t in rows:
        t = t or ""
        want = [len(lib.encode(t[:i])) for i in range(len(t) + 1)]
        assert got[k].counts == want, repr(t)
        assert got[k].seven == want[min(7, len(t))] and got[k].fit == max(i for i, c in enumerate(want) if c <= 5)
    again = token_counts.token_counts(frame(spark, [(1, "a b"), (1, "a b"), (2, "x")]), PIECE).collect()
    assert sorted(r.n_tokens for r in again) == sorted(len(lib.encode(t)) for t in ("a b", "a b", "x"))
    assert token_counts.token_counts(frame(spark, []), PIECE).count() == 0


def test_remembered_stays_in_its_bytes():
    from libralake.llm.bpe_dp import Remembered

    class Doubled(Remembered):
        most_bytes = 40_000

        def compute(self, key):
            return key + key

    d = Doubled()
    for i in range(5000):
        assert d[f"k{i}"] == f"k{i}k{i}"
    assert len(d) + len(d.older) < 250 and d["k4999"] == "k4999k4999"
    d.forget()
    assert not d and not d.older


def test_prefix_counts(texts):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    counter = token_counts.PieceCounter(PIECE)
    for t in texts[16:120]:
        t = t.replace(" ", "").replace("▁", "").replace("\n", "")
        if t:
            assert counter.prefix_counts("▁" + t)[2:] == [len(lib.encode(t[: i + 1])) for i in range(len(t))]


def test_texts_of_all_kinds_are_counted_together(texts):
    import pyarrow as pa
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    counter = token_counts.PieceCounter(PIECE)
    mixed = [*texts[:-1], "a\n", "\n", "\na", "a\n b", "a \nb", "\n\n▁x", "\n  x\n\n y", "a▁\n▁", "w" * 5000, "日本語" * 300, "\ue000\ue000 a\ue000b", "  \n  \n"]
    for kind in (pa.string(), pa.large_string()):
        n, fit = counter.fitted(pa.array(mixed, kind), 7)
        for t, k, f in zip(mixed, n.tolist(), fit.tolist()):
            assert k == len(lib.encode(t)), repr(t)
            if len(t) < 100:
                assert f == max(i for i in range(len(t) + 1) if len(lib.encode(t[:i])) <= 7), repr(t)


def test_words_that_begin_alike_share_their_table():
    import sentencepiece

    class Asked(dict):
        times = 0

        def get(self, *a):
            self.times += 1
            return super().get(*a)

    counter = token_counts.PieceCounter(PIECE)
    counter.dp._fits = asked = Asked()
    text = " ".join(f"internationalisation{a}{b}" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz")
    assert counter.count(text) == len(sentencepiece.SentencePieceProcessor(model_file=PIECE).encode(text))
    # 676 words of 22 characters; only some 750 prefixes of them differ.
    assert asked.times < 3000


def test_pairs_are_decided_as_merging_decides():
    dp, asked = token_counts.PieceCounter(PIECE).dp, 0
    rank, names = dp.rank, dp.names

    def counting(a, b):
        nonlocal asked
        asked += 1
        return rank(a, b)

    dp.rank = counting
    rng = random.Random(3)
    long = [i for i, t in enumerate(names) if len(t) > 5]
    pairs = [(rng.choice(long), rng.choice(long)) for _ in range(300)] + [(rng.randrange(len(names)), rng.randrange(len(names))) for _ in range(3000)]
    # Halves of pieces as well, whose merge over the seam comes late.
    number = {t: i for i, t in enumerate(names)}
    pairs += [(number[t[:k]], number[t[k:]]) for t in rng.sample(names, 3000) for k in range(1, len(t)) if t[:k] in number and t[k:] in number]
    got = [dp._decide(a, b) for a, b in pairs]
    assert got == [dp.merge(names[a] + names[b]) == [names[a], names[b]] for a, b in pairs]
    assert True in got and False in got
    asked = 0
    assert got == [dp._decide(a, b) for a, b in pairs]
    # The merges of a token by itself are not gone through again for each of its pairs.
    assert asked < 9 * len(pairs)


_ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(t):
    out = [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end(), m[0]) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def all_candidates(t):
    """Candidates of all kinds, by plain reading of the definition."""
    out = [(a, secrets.BASE[k], b, v) for a, k, b, v in base_spans(t)]
    shapes = {"jwt": r"eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,}", "github": r"gh[pousr]_[A-Za-z0-9]{36,}", "slack": r"xox[abprs]-[A-Za-z0-9-]{10,}", "google": r"AIza[\w-]{35}"}
    for kind, shape in shapes.items():
        out += [(m.start(), kind, m.end(), m[0]) for m in re.finditer(shape, t, re.A)]
    taken = {i for a, _, b, _ in out for i in range(a, b)}
    for m in re.finditer(r"[A-Za-z0-9+/_=-]+", t):
        if 16 <= len(m[0]) <= 256 and re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and not taken & set(range(*m.span())):
            out.append((m.start(), "value", m.end(), m[0]))
    return sorted(out, key=lambda x: (x[0], secrets.KINDS.index(x[1])))


def test_secrets(spark):
    rng = random.Random(9)
    bits = ["token", "TOKEN", "apikey", "api_key", "Secret", "paſſword", "passwd", "=", ":", " ", "  ", '"', "'", "é", "AKIA", "abcdef0123456789", "ABCDEFGH12345678", "x_y.z", "=", ":", "\n", "0" * 12, "short"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(1, 30)))) for i in range(400)]
    hot = "é token = \"deadbeefdeadbeefdeadbeef00\" 😀"
    rows += [(1000 + i, hot) for i in range(30)] + [(2000, "secret: onlymine77"), (2000, "secret: onlymine77"), (2001, None), (2002, ""), (None, "password=abcdef"), (2003, "ghp_" + "a" * 36)]
    rows += [(3000 + i, "ghp_" + "b" * 36) for i in range(4)]
    rows += [(4000, "xoxb-0123456789a eyJabcdefgh1.eyJabcdefgh2.abcdefgh3 AIza" + "k" * 35), (4001, "secret = knownvalue1234567."), (4008, "see knownvalue1234567 there"), (4002, "bare unnamed12345678901 only"), (4003, "q7Xb9Kd2Lm5Nc8Rt1VwZ here")]
    rows += [(4010 + i, "copied everywhere t5Fg7Hj9Kl1Zx3Cv5Bn7 it is") for i in range(12)]
    docs = frame(spark, rows, source=lambda k: f"s{(k or 0) % 7}")
    from pyspark.sql import functions as F

    got = secrets.scan(docs, F.col("doc_id"), F.col("source")).collect()
    assert len(got) == len(rows)
    texts = {}
    for k, t in rows:
        texts[k] = t or ""
    every = {k: all_candidates(t) for k, t in texts.items()}
    where, named = {}, set()
    for k, t in rows:
        for _, kind, _, v in every[k]:
            where.setdefault(v.rstrip("."), set()).add((f"s{(k or 0) % 7}", k))
            if kind != "value":
                named.add(v.rstrip("."))
    verdict = {v: "copied" if len({o for o, _ in w}) >= 3 or len(w) >= 10 else "live" if len({o for o, _ in w}) == 1 else "shared" for v, w in where.items()}
    for r in got:
        want = base_spans(texts[r.doc_id])
        joined = ",".join(f"{secrets.BASE[k]}:{a}:{b}" for a, k, b, _ in want)
        assert r.base_spans == joined and [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _, _ in want) for i in range(3)]
        spans = []
        for a, kind, b, v in every[r.doc_id]:
            own = verdict[v.rstrip(".")]
            if kind in secrets.BASE or (kind != "value" and own != "copied") or (kind == "value" and own == "live" and (v in named or secrets.random_looking(v))):
                spans.append((f"{kind}:{a}:{b}", own))
        assert r.spans == ",".join(x for x, _ in spans) and r.verdicts == ",".join(v for _, v in spans)
    masked = {r.doc_id: r for r in secrets.masked(docs, F.col("doc_id"), F.col("source")).collect()}
    assert masked[1000].text == "é [example]\" 😀" and masked[2000].text == "[secret]" and masked[2003].text == "[secret]"
    assert masked[2001].text is None and masked[2002].text == "" and masked[None].text == "[secret]"
    spans = {r.doc_id: r.spans for r in got}
    assert spans[4008] == "value:4:21" and spans[4002] == "" and spans[4003] == "value:0:20" and spans[4010] == ""
    assert masked[4008].text == "see [secret] there" and masked[4010].text.startswith("copied everywhere t5Fg")
    assert secrets.masked(docs, F.col("doc_id"), F.col("source")).count() == len(rows)
    odd = docs.withColumnsRenamed({"lang": "_at", "n_chars": "at", "source": "row"}).withColumn("found", F.lit(1))
    out = secrets.masked(odd, F.col("doc_id"), F.col("row"))
    assert out.columns == odd.columns and sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == sorted((r.doc_id or 0, r.text or "") for r in secrets.masked(docs, F.col("doc_id"), F.col("source")).collect())
    assert secrets.scan(frame(spark, []), F.col("doc_id"), F.col("source")).count() == 0


def test_licenses(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
    rows = [(1, "a b.\nLicensed under CC BY-NC 4.0.\nc"), (2, mit + "x"), (3, "Released under the MIT License. Licensed under the Apache License, Version 2.0."), (4, None), (5, ""), (6, "a licence of one's own"), (7, "Released under the MIT License.\n" * 3), (8, "é " * 50_000 + "\nReleased under the MIT License.")]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, rows)).collect()}
    assert (got[1].sentence_ids, got[1].licenses) == ("cc-by-nc-notice", "CC-BY-NC-4.0")
    assert (got[2].sentence_ids, got[2].n_rules, got[2].licenses) == ("mit-grant,mit-keep", 1, "MIT")
    assert (got[3].n_rules, got[3].licenses) == (2, "MIT,Apache-2.0")
    assert all((got[k].n_sentences, got[k].licenses) == (0, "") for k in (4, 5, 6))
    assert (got[7].n_sentences, got[7].n_rules, got[7].licenses) == (3, 3, "MIT") and got[8].licenses == "MIT"
    assert all(any(h in s for h in licenses.HINTS) for s in licenses.SENTENCES.values())
    plan = licenses.scan(frame(spark, rows))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan.split("== Physical Plan ==")[0]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies on this site and so on.</div>
<aside>Side text that is long enough to be seen as text</aside><div class="ad">Buy</div>
%s
<section id="comments"><p>What a fine article this is, I say as a reader.</p></section><form><p>Sign up</p></form><footer>&copy; 2020</footer></body></html>"""


def test_html():
    body = "<h1>Head &amp; more</h1><p>One&nbsp;two\n three<br>four</p><p><b>Five<p>By.</p><ul><li>x<li>y &#233;</ul><table><tr><td>c1<td>c2</table>"
    want = "Head & more\nOne two three four\nFive\nBy.\nx\ny é\nc1\nc2"
    assert html_text.main_text(PAGE % f"<article>{body}<!-- no --></article>") == want
    assert html_text.main_text(PAGE % f"<main><div>{body}</div></main>") == want
    assert html_text.main_text(PAGE % f"<div class=content>{body}</div>") == want
    assert [html_text.main_text(x) for x in (None, "", "<p>", "plain", "<<>><b", "</div></p>x")] == ["", "", "", "plain", html_text.main_text("<<>><b"), "x"]
    assert len(html_text.main_text("<p>" * 50_000 + "deep")) == 4


def test_html_pages(spark):
    rows = [(1, "u", PAGE % "<article><p>Text.</p></article>"), (1, "u", PAGE % "<article><p>Text.</p></article>"), (2, None, None), (None, "v", "<p>x")]
    got = sorted([tuple(r) for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()], key=str)
    assert got == sorted([(1, "u", "Text.", 5), (1, "u", "Text.", 5), (2, None, "", 0), (None, "v", "x", 1)], key=str)


def test_quality(spark):
    rng = random.Random(3)
    good = lambda: " ".join("".join(rng.choice("abdeiorst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(30, 200)))
    bad = lambda: rng.choice([str.upper, lambda t: t.replace(" ", "%%% "), lambda t: (t.split()[0] + " ") * 50])(good())
    rows = [(i, good() if i % 3 else bad()) for i in range(900)] + [(2000, None), (2001, ""), (1, "again"), (None, "x y")]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(900)] + [(2000, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    from pyspark.sql import functions as F

    model = quality.train(docs, labels, queries.in_fold(F.col("doc_id")))
    got = quality.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 900 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum((r.score >= 0.7) == (r.doc_id % 3 > 0) for r in held) >= 0.97 * len(held)
    assert quality.good(docs, model).columns == docs.columns
    assert quality.good(docs, model).count() == sum(r.score >= 0.7 for r in got)
    assert quality.train(docs, labels.limit(0), F.lit(True)).prior == 0.5
    assert quality.train(docs, labels.where("quality = 1"), F.lit(True)).prior == 1.0
    assert quality.score(frame(spark, []), model).count() == 0


def test_html_keeps_whole_articles():
    para = "<p>" + "Long words of an article that goes on for a while, as articles do, without an end. " * 4 + "</p>"
    lead, far = "A lead that stands before the long part of the page and says what it is about.", "A later section of the same article, much shorter than what went before it."
    shell = "<html><head><title>T</title></head><body>%s</body></html>"
    for n in (1, 40):
        text = html_text.main_text(shell % f"<h1>Its title</h1><div><p>{lead}</p></div><div>{para * n}</div><section><h2>More</h2><p>{far}</p></section>")
        assert text.startswith("Its title\n" + lead) and text.endswith("More\n" + far) and text.count("Long words") == 4 * n
    text = html_text.main_text(shell % f"<article>{para * 9}</article><article><p>{lead}</p></article>")
    assert text.count("Long words") == 36 and text.endswith(lead)
    for wrap in ('<div class="no-sidebar">%s</div>', '<div class="layout has-sidebar">%s</div>', '<form id="aspnetForm">%s</form>', '<div class="content-sidebar-wrap">%s</div>'):
        text = html_text.main_text(shell % (wrap % f"<div class='sidebar'>Out</div><h1>Its title</h1>{para * 3}"))
        assert text.startswith("Its title") and text.count("Long words") == 12 and "Out" not in text, wrap
    for name in ("discussion", "related-work"):
        text = html_text.main_text(shell % f'<article>{para * 20}<section id="{name}">{para}</section></article>')
        assert text.count("Long words") == 84, name
    text = html_text.main_text(shell % f'<article><div class="article-header"><h1>Its title</h1><p>{lead}</p></div>{para}<div class="share-bar"><a href="/">Share it</a></div></article>')
    assert text.startswith("Its title\n" + lead) and "Share" not in text
    assert html_text.main_text(f"<head><title>T</title><p>{lead}</p>") == lead
    assert html_text.main_text(f"<head><meta charset=utf-8><body><p>{lead}</p></body>") == lead


def test_secrets_of_many_repositories(spark):
    from pyspark.sql import functions as F

    rows = [(i, "token = sampletoken1") for i in range(12)] + [(100 + i, "token = ownedtoken22") for i in range(9)] + [(200, "ghp_" + "z" * 36), (201, "no")]
    docs = frame(spark, rows)
    got = {r.doc_id: (r.n_live, r.n_shared, r.n_copied, r.n_repos) for r in secrets.scan(docs, F.col("doc_id"), F.col("source")).collect()}
    assert got[0] == (0, 0, 1, 12) and got[100] == (1, 0, 0, 9) and got[200] == (1, 0, 0, 1) and got[201] == (0, 0, 0, 0)
    masked = {r.doc_id: r.text for r in secrets.masked(docs, F.col("doc_id"), F.col("source")).collect()}
    assert masked[5] == "[example]" and masked[105] == "[secret]"


def test_licenses_of_wrapped_texts(spark):
    import textwrap

    mit = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
    apache = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
    wrap = lambda t, mark: "\n".join(mark + x for p in t.split("\n") for x in (textwrap.wrap(p, 60) or [""]))
    rows = [(i, wrap(t, m)) for i, (t, m) in enumerate((t, m) for t in (mit, apache) for m in ("", "# ", " * ", "// "))]
    rows += [(10, "This project is licensed under the MIT License."), (11, "It is not licensed under the MIT License."), (12, "Licensed under the GNU General Public License version 2 or later."), (13, "Unlike the MIT License it binds."), (14, "x\nMIT License\ny"), (15, "SPDX-License-Identifier: MIT-0")]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, rows)).collect()}
    assert all(got[i].sentence_ids == "mit-grant,mit-keep,mit-warranty" and (got[i].n_rules, got[i].licenses) == (1, "MIT") for i in range(4))
    assert all(got[i].sentence_ids == "apache-grant,apache-copy,apache-warranty,apache-see" and (got[i].n_rules, got[i].licenses) == (1, "Apache-2.0") for i in range(4, 8))
    assert [got[i].licenses for i in range(10, 16)] == ["MIT", "", "", "", "MIT", ""]


def test_html_is_linear():
    import time

    def seconds(html):
        began = time.process_time()
        html_text.main_text(html)
        return time.process_time() - began

    for piece in ("<div>x", "</span>", "<div class='advert'>x", "<li><b>x", "<section id=notice><p>y"):
        small, large = seconds(piece * 4000), seconds(piece * 16_000)
        assert large < 9 * max(small, 0.05), piece


def test_html_density_decides(monkeypatch):
    """On a page that marks no article, the smoothed ratios choose the region and the lines."""
    para = "<p>" + "Prose of an article that goes on for a while, as it does, without an end. " * 3 + "</p>"
    links = "".join(f"<div><a href='/{i}'>A link that is long enough to be a line number {i}</a></div>" for i in range(12))
    page = f"<html><body><div>{links}</div><div><h1>Title</h1>{para * 4}<p>Short.</p>{para * 4}</div><div>{links}</div></body></html>"
    text = html_text.main_text(page)
    assert text.startswith("Title") and "Short." in text and "A link" not in text and text.count("Prose of") == 24
    import numpy as np

    monkeypatch.setattr(html_text, "smooth", lambda ratio, sigma: np.ones(len(ratio)))
    assert html_text.main_text(page) != text


def test_html_names_on_any_tag():
    para = "<p>" + "Long words of an article that goes on for a while, as articles do, without an end. " * 4 + "</p>"
    text = html_text.main_text(f'<body><article>{para * 5}<p class="advert">Buy our shoes, which are the best shoes that you can buy today.</p><p class="cookie-notice">We use cookies to make this page better for all of its readers.</p><a class="share" href="/">Share</a><section id="related-work">{para}</section></article>')
    assert text.count("Long words") == 24 and not any(x in text for x in ("shoes", "cookies", "Share"))
    titled = html_text.main_text(f'<body><h1 class="page-header">Its title</h1>{para * 3}<h2 class="comments-title">Comments</h2>')
    assert titled.startswith("Its title") and "Comments" not in titled
    whole = html_text.main_text(f'<body><div id="related-work">{para * 3}</div>')
    assert whole.count("Long words") == 12


def test_html_against_planted_pages(spark):
    """Random pages whose article blocks are known."""
    import html as h

    rng = random.Random(41)
    word = lambda: "".join(rng.choice("abdeiorst&<é") for _ in range(rng.randint(2, 9)))
    sentence = lambda n: " ".join(word() for _ in range(n))
    rows, want = [], {}
    for i in range(60):
        blocks = [sentence(rng.randint(3, 80)) for _ in range(rng.randint(3, 12))]
        inner = "".join(f"<p>{h.escape(b)}</p>" if rng.random() < 0.8 else f"<blockquote>\n  {h.escape(b)}\t</blockquote>" for b in blocks)
        page = PAGE % f"<article>{inner}</article>"
        want[i] = "\n".join(" ".join(b.split()) for b in blocks)
        rows.append((i, f"u{i}", page))
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "'z' as _html")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(docs).collect()}
    assert got == {i: (t, len(t)) for i, t in want.items()}
    assert html_text.extract(docs.limit(0)).count() == 0


def test_more_licenses(spark):
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
    mpl = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"
    lgpl = "# This library is free software; you can redistribute it and/or\n# modify it under the terms of the GNU Lesser General Public\n# License as published by the Free Software Foundation; either\n# version 2.1 of the License, or (at your option) any later version."
    cases = {
        "BSD-2-Clause": bsd,
        "MPL-2.0": mpl,
        "LGPL-2.1-or-later": lgpl,
        "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled\nbinary, for any purpose, commercial or non-commercial, and by any\nmeans.",
        "ISC": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
        "EPL-2.0": "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/",
        "AGPL-3.0-only": "SPDX-License-Identifier: AGPL-3.0-only",
        "CC0-1.0": "// SPDX-License-Identifier: CC0-1.0",
        "Zlib": "Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:",
    }
    rows = list(enumerate(cases.values())) + [(50, "an example of MIT"), (51, None), (51, None), (52, "x " * 200_000 + cases["ISC"])]
    got = sorted((r.doc_id, r.licenses) for r in licenses.scan(frame(spark, rows)).collect())
    assert got == sorted([*enumerate(cases), (50, ""), (51, ""), (51, ""), (52, "ISC")])
    assert licenses.scan(frame(spark, [])).count() == 0
    assert len({n for n, _ in licenses.RULES}) >= 25


def test_word_bpe_on_every_character():
    """Tables of characters differ between libraries: letters, digits, white space, lower case, composition."""
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(WORD), word_bpe.WordBpe(WORD)
    # Beyond these planes no character has been assigned but tags and variants.
    chars = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x13500), *range(0x16800, 0x19000), *range(0x1AFF0, 0x20000), *range(0x2A6D0, 0x32500), *range(0xE0000, 0xE0200)]]
    texts = [f".{c}/a" for c in chars]
    for text, want in zip(texts, lib.encode_batch(texts, add_special_tokens=False)):
        assert list(own.encode(text)) == want.ids, ascii(text)


def test_secrets_in_linear_time():
    """No shape of text makes the scan look at a run over and over."""
    import time

    for unit in ("eyJ", "eyJaaaaaaaa.", "ghp_", "xoxb-", "-----BEGIN ", "-----BEGIN A PRIVATE KEY-----a-----END ", "password ", "AKIA", "a1", "token: "):
        began = time.process_time()
        secrets.candidates(unit * (1_000_000 // len(unit)))
        assert time.process_time() - began < 5, unit


def test_secrets_of_any_length():
    value = "aB3" * 200
    assert secrets.candidates(f"x {value} y") == [(2, secrets.VALUE, 602, value)]
    jwt = "eyJ" + "x" * 500 + ".eyJ" + "y" * 500 + "." + "z" * 500
    assert secrets.candidates(f"eyJshort.{jwt}.d-e") == [(9, 3, 9 + len(jwt), jwt)]
    assert [c[1] for c in secrets.candidates("-----BEGIN " + "A" * 40 + " PRIVATE KEY-----\nabc\n-----END X PRIVATE KEY-----")] == [7]


def test_html_broken_markup_in_linear_time():
    import time

    for unit in ("<a ", "<!--", "<![CDATA[", "</a", "<script></", "<!x", "<?", "<a x='", '<a x="', "<!-->", "&#9", "<style><!--", "<blockquote><footer>"):
        for tail in ("", ">", "-->x"):
            began = time.process_time()
            html_text.main_text(unit * (60_000 // len(unit)) + tail)
            assert time.process_time() - began < 5, (unit, tail)
    assert html_text.main_text("<p>a &#" + "9" * 6000 + "; b &#" + "0" * 6000 + "65;</p>") == "a \ufffd b A"
    assert html_text.main_text("<p>One.</p><!-- open <p>Two.</p>") == "One.\nopen\nTwo."


def test_html_density_decides_in_articles(monkeypatch):
    """Within a marked page too: which articles count, and which lines in them."""
    prose = "One sentence of prose that is long enough to be dense, with a few words more. "
    links = "".join(f"<li><a href=/{i}>Tag {i}</a></li>" for i in range(6))
    page = f"<body><article><h1>Its title</h1><p>{prose * 3}</p><p>Short.</p><p>{prose * 2}</p><ul>{links}</ul></article><article><h2><a href=/x>A teaser</a></h2></article></body>"
    # The first link stands close enough to prose.
    want = "\n".join(["Its title", (prose * 3).strip(), "Short.", (prose * 2).strip(), "Tag 0"])
    assert html_text.main_text(page) == want
    monkeypatch.setattr(html_text, "smooth", lambda ratio, sigma: np.ones(len(ratio)))
    assert html_text.main_text(page) != want


def test_html_formulas_and_quotations():
    prose = "One sentence of prose that is long enough to be dense, with a few words more. "
    page = f"<article><p>{prose}</p><p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi></math> they say.</p><blockquote><p>{prose}</p><footer>Its author</footer></blockquote></article><footer>Imprint</footer>"
    assert html_text.main_text(page) == "\n".join([prose.strip(), "Energy is E=m they say.", prose.strip(), "Its author"])
