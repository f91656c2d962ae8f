"""Page layout on small pages and against plain rules."""

from __future__ import annotations

import random

from libralake.operators import layout


def line(s, x, y, w, size=10.0):
    return (1, s, x, y, w, size / 792, size)


def read(spark, items):
    words = spark.createDataFrame(items, "page int, text string, x double, y double, w double, h double, size double")
    return sorted(((r.place, r.zone, r.text) for r in layout.laid_out(layout.lines(words, ["page"]), ["page"]).collect()))


def test_zones_and_blocks(spark):
    got = read(spark, [line("Vigilar y castigar", 0.35, 0.03, 0.3, 9.0), line("Primera línea del cuerpo de la página.", 0.1, 0.2, 0.8), line("Segunda línea del cuer-", 0.1, 0.2 + 12 / 792, 0.8), line("po, que sigue.", 0.1, 0.2 + 24 / 792, 0.3), line("xiv", 0.48, 0.95, 0.04, 9.0), line("  ", 0.5, 0.5, 0.1)])
    assert got == [(0, "header", "Vigilar y castigar"), (1, "body", "Primera línea del cuerpo de la página. Segunda línea del cuerpo, que sigue."), (2, "footer", "xiv")]


def test_columns(spark):
    items = [line("Un título", 0.3, 0.09, 0.4, 14.0)]
    for i in range(5):
        items += [line(f"derecha {i}", 0.54, 0.15 + i * 0.016, 0.38), line(f"izquierda {i}", 0.08, 0.15 + i * 0.016, 0.38)]
    assert [t for _, _, t in read(spark, items)] == ["Un título", " ".join(f"izquierda {i}" for i in range(5)), " ".join(f"derecha {i}" for i in range(5))]


def test_words_become_lines(spark):
    words = [line(w, 0.1 + i * 0.06, 0.3 + (i % 3) * 0.001, 0.05) for i, w in enumerate(["one", "two", "three", "four"])] + [line("far", 0.7, 0.3, 0.1)]
    df = spark.createDataFrame(words, "page int, text string, x double, y double, w double, h double, size double")
    assert sorted(r.text for r in layout.lines(df, ["page"]).collect()) == ["far", "one two three four"]


def test_order_of_cuts():
    box = lambda x0, y0, x1, y1, n: (x0, y0, x1, y1, n)
    assert [b[4] for b in layout.reading_order([box(0.55, 0.3, 0.9, 0.8, "right"), box(0.1, 0.3, 0.45, 0.8, "left"), box(0.2, 0.1, 0.8, 0.15, "title")])] == ["title", "left", "right"]
    assert layout.joined(["la interpre-", "tación"]) == "la interpretación" and layout.joined(["Jean-", "Paul"]) == "Jean- Paul"
    rng = random.Random(3)
    for _ in range(50):
        boxes = [(x := rng.random(), y := rng.random(), x + rng.random() * 0.2, y + rng.random() * 0.1, i) for i in range(rng.randint(0, 30))]
        assert sorted(layout.reading_order(boxes)) == sorted(boxes)
    assert len(layout.reading_order([(0.1, i * 0.01, 0.2, i * 0.01 + 0.001, i) for i in range(3000)])) == 3000
