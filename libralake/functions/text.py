"""Column expressions over text: folding, terms, keys, estimates, quality measures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accented Latin letters and what each folds to, one for one.
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüýÿçñ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuyycn"
WORD = r"[\p{L}\p{N}]+"

#: Function words left out of queries, of six languages; a parameter wherever it is used.
STOPWORDS = tuple(
    dict.fromkeys(
        (
            "the of and to in is that for it on with as by at from this be are was or not "
            "de la el que en los las del se por con un una para como su al lo "
            "le les des et une du au aux dans pour qui sur est pas ce "
            "der die das und den dem ein eine ist mit von zu im auf nicht "
            "il gli di che per della dei nel sono "
            "ad cum ut quod sed"
        ).split()
    )
)
#: Function words that mark a language; a parameter of ``language``.
MARKS = {
    "en": ("the", "of", "and", "to", "that", "is", "with", "for", "was", "this"),
    "fr": ("le", "les", "des", "et", "est", "une", "dans", "pour", "qui", "pas"),
    "de": ("der", "die", "das", "und", "ist", "nicht", "ein", "mit", "von", "zu"),
    "es": ("el", "los", "las", "del", "que", "por", "para", "con", "una", "se"),
    "it": ("il", "gli", "della", "che", "di", "per", "non", "nel", "sono", "dei"),
    "pt": ("os", "da", "dos", "uma", "não", "para", "com", "ao", "mais", "pelo"),
    "ca": ("els", "amb", "dels", "una", "per", "és", "són", "aquest", "les", "seva"),
    "la": ("et", "est", "non", "ad", "cum", "quod", "sed", "ut", "atque", "sunt"),
}
# Folded words and phrases that tell what a query asks for.
INTENTS = {
    "visual": (
        "show, image, picture, photo, diagram, chart, graph, figure, illustration, look like, video, frame, scene, screenshot, "
        "imagen, foto, diagrama, grafico, mostrar, figura, lamina, ilustracion, esquema, mapa, tabla, grabado, manuscrito, portada, "
        "diagramme, graphique, montrer, immagine, bild, diagramm, grafik, zeigen, abbildung"
    ).split(", "),
    "quote": "quote, said, stated, according to, cited, who said, testimony, cita textual, dijo, quien dijo, frase, literal, citation, qui a dit, chi disse, zitat, sagte, wer sagte".split(", "),
    "temporal": "when, timeline, chronology, cuando, cronologia, en que ano, en que siglo, fecha, epoca, periodo, quand, chronologie, quando, wann, zeitlinie, siglo, century, siecle, secolo, jahrhundert".split(", "),
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def computed(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """``df`` with new columns that later filters and expressions do not compute again: they pass through a generator."""
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select(*keep, made.alias("_made")).select(*keep, *[F.col(f"_made.{n}").alias(n) for n in columns])


def fold(x: Column) -> Column:
    """Lower case without accents, the same length as the text.

    Texts of one byte for each character have no accents: most are done without looking up characters.
    """
    low = F.lower(x)
    return F.when(F.octet_length(x) == F.length(x), low).otherwise(F.translate(low, ACCENTED, PLAIN))


def tokens(x: Column) -> Column:
    """All words of the folded text, in order."""
    return F.regexp_extract_all(fold(x), F.lit(WORD), F.lit(0))


def terms(x: Column, stopwords: tuple[str, ...] = STOPWORDS, least: int = 2) -> Column:
    """Words that matter for a query: long enough, not function words; repeats stay."""
    stop = F.array(*map(F.lit, stopwords))
    return F.filter(tokens(x), lambda t: (F.length(t) >= least) & ~F.array_contains(stop, t))


def key(x: Column) -> Column:
    """Comparison key: folded, other characters than letters and digits as one space, trimmed."""
    return F.trim(F.regexp_replace(fold(x), r"[^\p{L}\p{N}]+", " "))


def key_keeping_ene(x: Column) -> Column:
    """Comparison key in which ñ stays a letter of its own."""
    at, to = ACCENTED.replace("ñ", ""), PLAIN[:-1]
    return F.trim(F.regexp_replace(F.translate(F.lower(x), at, to), r"[^\p{L}\p{N}]+", " "))


#: Opening marks, and the marks that close them.
QUOTES = (("«", "»"), ('"', '"'), ("“", "”"), ("„", "“”"))
QUOTED = "|".join(f"{a}[^{z}]{{2,}}[{z}]" for a, z in QUOTES)


def quoted(x: Column) -> Column:
    """Passages between quotation marks, of two characters or more."""
    found = F.regexp_extract_all(x, F.lit(QUOTED), F.lit(0))
    return F.transform(found, lambda q: F.trim(F.substring(q, F.lit(2), F.length(q) - 2)))


def token_estimate(x: Column) -> Column:
    """Model tokens a text is likely to have: the larger of a quarter of its length and 1.3 for each word."""
    return F.greatest(F.ceil(F.length(x) / 4), F.ceil(F.size(F.regexp_extract_all(x, F.lit(r"\S+"), F.lit(0))) * 1.3)).cast("long")


def garbage_ratio(x: Column) -> Column:
    """Share of odd characters among those that are no white space; 0 for a text without any."""
    seen = F.length(F.regexp_replace(x, r"\s", ""))
    odd = F.length(F.regexp_replace(x, r"[\p{L}\p{N}\s.,;:!?'\"()\-]", ""))
    return F.when(seen > 0, odd / seen).otherwise(F.lit(0.0))


def truncate_words(x: Column, most: int) -> Column:
    """At most ``most`` characters, cut at a word end, with an ellipsis where cut."""
    head = F.regexp_replace(F.substring(x, 1, most), r"\s+\S*\z", "")
    return F.when(F.length(x) <= most, x).otherwise(F.concat(head, F.lit("…")))


def bigrams(x: Column) -> Column:
    """Character pairs of a text, with repeats."""
    n = F.length(x)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(x, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def dice(a: Column, b: Column) -> Column:
    """Dice similarity of the character pairs of two texts, as multisets; equal texts are 1."""
    both = lambda x, y: F.aggregate(F.array_distinct(x), F.lit(0), lambda acc, g: acc + F.least(count_of(x, g), count_of(y, g)))
    share = lambda x, y: F.when(F.size(x) + F.size(y) == 0, F.lit(0.0)).otherwise(2.0 * both(x, y) / (F.size(x) + F.size(y)))
    return F.when(a == b, F.lit(1.0)).otherwise(let(bigrams(a), lambda x: let(bigrams(b), lambda y: share(x, y))))


def title_similarity(a: Column, b: Column) -> Column:
    """Shared words of more than two letters over the larger number of them."""
    x = F.array_distinct(F.filter(tokens(a), lambda t: F.length(t) > 2))
    y = F.array_distinct(F.filter(tokens(b), lambda t: F.length(t) > 2))
    share = lambda x, y: F.when(F.greatest(F.size(x), F.size(y)) > 0, F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y))).otherwise(F.lit(0.0))
    return let(x, lambda p: let(y, lambda q: share(p, q)))


def overlap(a: Column, b: Column) -> Column:
    """Share of the distinct words of one list that another has."""
    x = F.array_distinct(a)
    return F.when(F.size(x) > 0, F.size(F.array_intersect(x, b)) / F.size(x)).otherwise(F.lit(0.0))


def language(x: Column, marks: dict[str, tuple[str, ...]] | None = None, least: int = 2) -> Column:
    """Language with most of its function words, the first in order where equal; null below ``least``."""
    def pick(words: Column) -> Column:
        counts = [F.struct(_count_in(words, F.array(*map(F.lit, ms))).alias("n"), F.lit(lang).alias("lang")) for lang, ms in sorted((marks or MARKS).items())]
        return F.aggregate(F.array(*counts[1:]), counts[0], lambda a, b: F.when(b["n"] > a["n"], b).otherwise(a), lambda b: F.when(b["n"] >= least, b["lang"]))

    return let(F.regexp_extract_all(F.lower(x), F.lit(r"\p{L}+"), F.lit(0)), pick)


def _count_in(words: Column, own: Column) -> Column:
    return F.size(F.filter(words, lambda w: F.array_contains(own, w)))


def count_of(words: Column, word: Column) -> Column:
    """How often a list has a word."""
    return F.size(F.filter(words, lambda w: w == word))


def intent_pattern(kind: str, intents: dict[str, list[str]] | None = None) -> str:
    """Pattern of a folded text that has one of a kind's words."""
    return r"(^|[^\p{L}])(" + "|".join((intents or INTENTS)[kind]) + r")([^\p{L}]|$)"


def intent(x: Column, intents: dict[str, list[str]] | None = None) -> Column:
    """What a query asks for: a quotation, a picture, a time, or a concept."""
    t = fold(x)
    out = F.when(F.size(quoted(x)) > 0, "quote")
    for kind in ("visual", "quote", "temporal"):
        out = out.when(t.rlike(intent_pattern(kind, intents)), kind)
    return out.otherwise("conceptual")


def clock_seconds(x: Column) -> Column:
    """Seconds of ``h:m:s``, ``m:s`` or a number, with a decimal point or comma; null for anything else."""
    parts = F.split(F.replace(x, F.lit(","), F.lit(".")), ":")
    value = F.aggregate(parts, F.lit(0.0), lambda acc, p: acc * 60 + p.cast("double"))
    return F.when(x.rlike(r"^\d+(:\d{1,2}){0,2}([.,]\d+)?$"), value)


def clock(seconds: Column) -> Column:
    """``H:MM:SS`` from an hour on, else ``M:SS``."""
    s = F.floor(seconds).cast("long")
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60)).otherwise(F.format_string("%d:%02d", F.floor(s / 60).cast("long"), s % 60))


def roman(x: Column) -> Column:
    """Value of a strict Roman numeral (either case, 1 to 3999), else null."""
    up = F.upper(x)
    # The numerals' symbols.
    value = F.aggregate(
        F.split(up, ""),
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")),
        lambda acc, ch: F.struct(
            (acc["sum"] + _numeral(ch) - F.when(acc["last"] < _numeral(ch), 2 * acc["last"]).otherwise(0)).alias("sum"), _numeral(ch).alias("last")
        ),
        lambda acc: acc["sum"],
    )
    return F.when(up.rlike("^(?=.)M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"), value)


def _numeral(ch: Column) -> Column:
    out = F.lit(0)
    for s, v in (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000)):
        out = F.when(ch == s, F.lit(v)).otherwise(out)
    return out


def to_roman(n: Column) -> Column:
    """Roman numeral of 1 to 3999 in capitals, else null."""
    digit = lambda d, one, five, ten: F.element_at(F.array(*map(F.lit, ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten])), d + 1)
    place = lambda p: (F.floor(n / p) % 10).cast("int")
    text = F.concat(digit(place(1000), "M", "?", "?"), digit(place(100), "C", "D", "M"), digit(place(10), "X", "L", "C"), digit(place(1), "I", "V", "X"))
    return F.when((n >= 1) & (n <= 3999), text)


def isbn_valid(x: Column) -> Column:
    """Whether the check digit of a 10- or 13-digit book number holds (hyphens and spaces allowed)."""
    d = F.split(F.upper(F.regexp_replace(x, r"[\s-]", "")), "")
    num = lambda c: F.when(c == "X", 10).otherwise(c.cast("int"))
    ten = F.aggregate(F.transform(d, lambda c, i: num(c) * (10 - i)), F.lit(0), lambda a, b: a + b) % 11 == 0
    thirteen = F.aggregate(F.transform(d, lambda c, i: num(c) * F.when(i % 2 == 0, 1).otherwise(3)), F.lit(0), lambda a, b: a + b) % 10 == 0
    plain = F.upper(F.regexp_replace(x, r"[\s-]", ""))
    return F.when(plain.rlike(r"^\d{9}[\dX]$"), ten).when(plain.rlike(r"^97[89]\d{10}$"), thirteen).otherwise(F.lit(False))


def to_isbn13(x: Column) -> Column:
    """13-digit form of a 10-digit book number."""
    core = F.concat(F.lit("978"), F.substring(F.regexp_replace(x, r"[\s-]", ""), 1, 9))
    total = F.aggregate(F.transform(F.split(core, ""), lambda c, i: c.cast("int") * F.when(i % 2 == 0, 1).otherwise(3)), F.lit(0), lambda a, b: a + b)
    return F.concat(core, ((10 - total % 10) % 10).cast("string"))


def author_label(authors: Column, year: Column) -> Column:
    """Short label of a work: one author, two, or the first with «et al.»; «n.d.» without a year."""
    who = F.when(F.size(authors) == 1, authors[0]).when(F.size(authors) == 2, F.concat(authors[0], F.lit(" & "), authors[1])).when(F.size(authors) > 2, F.concat(authors[0], F.lit(" et al.")))
    return F.concat_ws(", ", who, F.coalesce(year.cast("string"), F.lit("n.d.")))


def noisy_or(weights: Column) -> Column:
    """Joint strength of independent pieces of evidence: one less the product of what each leaves."""
    return 1.0 - F.aggregate(weights, F.lit(1.0), lambda acc, w: acc * (1.0 - w))
