"""Each pipeline stage on its own input against brute force, and the whole over small tables."""

from __future__ import annotations

import random
import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from libralake.llm import queries, secrets  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abdeiorstnl") for _ in range(rng.randint(2, 9)))
    clean = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    items = [(i, clean(30)) for i in range(6)]
    rows, junk = [], set()
    for i in range(700):
        t = clean(rng.randint(40, 200))
        if i % 5 == 0:
            t = rng.choice([t.upper() + "!!", t.replace(" ", "%%% "), " ".join([t.split()[0]] * 60)])
            junk.add(i)
        elif i % 23 == 1:
            t += " " + items[i % 6][1] + " " + clean(20)
        elif i % 17 == 2:
            t += f' token = "{rng.randrange(16**40):040x}" ' + clean(5)
        elif i % 19 == 3:
            t += ' password: changeme-example ' + clean(5)
        rows.append((i, t))
    for i in range(0, 60):
        base = rows[(7 * i + 1) % 700][1].split()
        if i % 2:
            base[len(base) // 2] = "changedword"
        rows.append((1000 + i, " ".join(base)))
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(k, t, "en", f"src{k % 9}", len(t)) for k, t in rows], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, int(i not in junk), 0) for i in range(700)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, dict(rows), junk, items


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_stages(spark, tables):
    path, texts, junk, items = tables
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "secret_scan", "bpe_encoding"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, held = docs.columns, dict(texts)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path).cache()
        got = docs.collect()
        now = {r.doc_id: (r.text if "text" in r else None) for r in got}
        assert len(now) == len(got) and set(now) <= set(held)
        if name != "bpe_encoding":
            assert docs.columns == columns
        if name == "quality_classifier":
            gone = set(held) - set(now)
            clean = set(held) - {k for k in held if k in junk or (k >= 1000 and (7 * (k - 1000) + 1) % 700 in junk)}
            assert len(gone & clean) <= 0.02 * len(clean) and len(set(now) - clean) <= 4
        elif name == "ngram_jaccard_join":
            sets = {k: shingles(t) for k, t in held.items()}
            label = {k: k for k in sets}

            def find(x, label=label):
                while label[x] != x:
                    x = label[x]
                return x

            keys = sorted(sets)
            index = {}
            for k in keys:
                for s in sets[k]:
                    index.setdefault(s, []).append(k)
            for k in keys:
                for o in {o for s in sets[k] for o in index[s] if o < k}:
                    if 100 * len(sets[k] & sets[o]) >= 75 * len(sets[k] | sets[o]):
                        a, b = find(k), find(o)
                        label[max(a, b)] = min(a, b)
            assert set(now) == {find(k) for k in keys}
        elif name == "benchmark_decontamination":
            bad = {k for k, t in held.items() if any(len(shingles(x) & shingles(t)) >= 0.75 * len(shingles(x)) for _, x in items)}
            assert bad and set(now) == set(held) - bad
        elif name == "secret_scan":
            owners = {}
            for k, t in held.items():
                for *_, v in secrets.candidates(t):
                    owners.setdefault(v, set()).add(f"src{k % 9}")
            assert set(now) == set(held)
            for k, t in held.items():
                out, at = "", 0
                for s, _, e, v in secrets.candidates(t):
                    if s >= at:
                        out += t[at:s] + ("[example]" if len(owners[v]) >= 3 else "[secret]")
                    at = max(at, e)
                assert now[k] == out + t[at:]
            assert any("[example]" in t for t in now.values()) and any("[secret]" in t for t in now.values())
        else:
            from tokenizers import Tokenizer

            lib = Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json"))
            for r in got:
                assert list(r.ids) == lib.encode(held[r.doc_id], add_special_tokens=False).ids
        held = now
    whole = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, path).collect()}
    assert whole == {r.doc_id: r.n_tokens for r in got}


def test_odd_rows_and_columns(spark, tables, tmp_path):
    """Nulls in any column, empty, long and repeated texts, columns with names that operators use, and empty tables."""
    from pyspark.sql import functions as F

    path, texts, _, items = tables
    good = [k for k in sorted(texts) if k < 700 and k % 5][:3]
    long = " ".join(texts[k] for k in sorted(texts) if k < 700 and k % 5)
    rows = [(1, texts[good[0]]), (1, texts[good[0]]), (2, None), (None, texts[good[1]]), (3, ""), (None, None), (4, long), (4, texts[good[2]]), (5, "one two")]
    names = ["_k", "_h", "_nth", "_at", "_sk", "_sh", "_sp", "seq", "digest", "row", "at", "key", "cls", "n", "text_hash", "body", "found", "marks", "t1", "best", "copy", "id"]
    docs = spark.createDataFrame([(k, t, None if k == 2 else "en", None if k is None else f"s{k}", None) for k, t in rows], SCHEMA)
    docs = docs.withColumns({c: F.concat(F.lit(f"{c}-"), F.coalesce("doc_id", F.lit(0)).cast("string")) for c in names})
    held = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, held, path).cache()
        n = out.count()
        if name == "bpe_encoding":
            assert n == held.count() and out.where("n_tokens = 0 and decoded <> ''").count() == 0
            break
        assert out.schema.names == docs.schema.names and n <= held.count()
        for c in names:
            assert out.where(F.col(c) != F.concat(F.lit(f"{c}-"), F.coalesce("doc_id", F.lit(0)).cast("string"))).count() == 0, (name, c)
        if name == "ngram_jaccard_join":
            assert out.where("doc_id = 1").count() <= 1
        held = out
    kept = {}
    for name, stage in corpus_pipeline.STAGES[1:4]:
        kept[name] = sorted(((r.doc_id, r.text) for r in stage(spark, docs, path).collect()), key=str)
    once = sorted([r for i, r in enumerate(rows) if i != 1], key=str)
    assert kept["ngram_jaccard_join"] == once
    assert [r[0] for r in kept["secret_scan"]] == [r[0] for r in sorted(rows, key=str)]
    clean = lambda t: not any(len(shingles(x) & shingles(t or "")) >= 0.75 * len(shingles(x)) for _, x in items)
    assert kept["benchmark_decontamination"] == sorted([r for r in rows if clean(r[1])], key=str)


def test_empty_tables(spark, tables, tmp_path):
    path, *_ = tables
    for name in ("documents", "labels", "benchmark"):
        other = tmp_path / name
        for t in ("documents", "labels", "benchmark"):
            df = spark.read.parquet(f"{path}/{t}.parquet")
            (df.limit(0) if t == name else df.where("doc_id < 60 or doc_id is null") if "doc_id" in df.columns else df).write.parquet(f"{other}/{t}.parquet")
        n = corpus_pipeline.run(spark, str(other)).count()
        assert n == 0 if name != "benchmark" else n > 0
