"""Keys for historical spelling: equal for the old and the modern form of a word.

Rules run once for each distinct word of the corpus (words follow Zipf's law, so the vocabulary
is small against the text); keys are joined back by word.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Year before which a text of the language is taken as old spelling.
MODERN_FROM = {"es": 1830, "fr": 1800, "it": 1800}


def _pairs(text: str) -> dict[str, str]:
    return dict(x.split(" ", 1) for x in text.replace("\n", " ").split(", "))


# Words that changed more than their spelling, old form and new.
WORDS = {
    "es": _pairs(
        "fee fe, agora ahora, aguora ahora, ansi asi, ansimesmo asimismo, ansimismo asimismo, assimesmo asimismo, asimesmo asimismo, estonces entonces, entonce entonces, vido vio, vee ve, veer ver, seer ser, vees ves, veen ven, "
        "mill mil, ovo hubo, hobo hubo, ovieron hubieron, acetar aceptar, aceto acepto, solene solemne, solenes solemnes, dino digno, dina digna, dinos dignos, dinas dignas, indino indigno, indina indigna, malino maligno, "
        "malina maligna, otubre octubre, fixo fijo, fixa fija, lexos lejos, relox reloj, coxo cojo, coxa coja, oxo ojo, oxos ojos, exe eje, exes ejes, vuessa vuestra, vuesa vuestra, vuessas vuestras, vuesas vuestras, "
        "vuessamerced vuestra merced, vuesamerced vuestra merced, fecho hecho, fechos hechos, fasta hasta, facer hacer, fuyr huir, fuir huir, charidad caridad, chaos caos, choro coro, choros coros, monarcha monarca, monarchas monarcas, "
        "monarchia monarquia, patriarcha patriarca, patriarchas patriarcas, achiles aquiles, achilles aquiles, chimera quimera, chimeras quimeras, machina maquina, machinas maquinas, archangel arcangel, archangeles arcangeles, "
        "character caracter, characteres caracteres, cholera colera, eucharistia eucaristia, anachoreta anacoreta, anachoretas anacoretas, fiempre siempre, fobre sobre, fiendo siendo, fido sido, fus sus, fer ser"
    ),
    "la": _pairs("michi mihi, nichil nihil"),
    "fr": _pairs(
        "estoit etait, estoient etaient, avoit avait, avoient avaient, estre etre, mesme meme, mesmes memes, nostre notre, nostres notres, vostre votre, vostres votres, aussy aussi, ainsy ainsi, cy ci, icy ici, ung un, vng un, "
        "faict fait, faicts faits, faicte faite, dict dit, dicts dits, dicte dite, aultre autre, aultres autres, eust eut, fust fut, nuict nuit, scavoir savoir, scay sais, scait sait, cognoistre connaitre, connoistre connaitre, "
        "paroistre paraitre, francois francais, anglois anglais, foible faible, foiblesse faiblesse, monsr monsieur, mr monsieur, roy roi, loy loi, foy foi, moy moi, toy toi, soy soi, luy lui, celuy celui, ay ai, vray vrai, vraye vraie"
    ),
    "it": _pairs("huomo uomo, huomini uomini, hoggi oggi, hora ora, hore ore, hebbe ebbe, hebbero ebbero, et e, hauere avere, havere avere, haueua aveva, haveva aveva, hauea avea, havea avea, anchora ancora, imperoche imperocche, percioche perciocche, conciosia conciossia"),
}
# Beginnings of words, old and new; the longest that fits counts.
STEMS = {
    "es": _pairs(
        "mesm mism, propri propi, sotil sutil, cobdici codici, cudici codici, cibdad ciudad, dubd dud, licion leccion, quistion cuestion, complir cumplir, complid cumplid, escur oscur, cativ cautiv, cautiuer cautiver, dotor doctor, "
        "dotrin doctrin, concet concept, efet efect, perfet perfect, perfecion perfeccion, perficion perfeccion, precet precept, colun column, sinific signific, manific magnific, truj traj, ferir herir, ferid herid, dix dij, predix predij, "
        "contradix contradij, bendix bendij, maldix maldij, trax traj, trux traj, atrax atraj, retrax retraj, dex dej, abax abaj, debax debaj, bax baj, cax caj, rox roj, quex quej, exerc ejerc, exempl ejempl, alex alej, flox floj, "
        "aflox afloj, embax embaj, quix quij, texer tejer, texid tejid, texed tejed, xabon jabon, xarab jarab, ximen jimen, xerez jerez, oxal ojal, lisonx lisonj, mexor mejor, dibux dibuj, enxut enjut, exido ejido, axen ajen, mux muj, "
        "paxar pajar, tixer tijer, vexez vejez, hixo hijo, hixa hija, mexill mejill, consex consej, luxur lujur, fabl habl, fermos hermos, fiz hiz, foja hoja, fambr hambr, fierr hierr, faz haz, folg holg, fembr hembr, fidalg hidalg, "
        "fuyend huyend, obscur oscur, subst sust, subscri suscri, sancti santi, sanct sant, escript escrit, script escrit, receb recib, rescib recib, resceb recib, escrev escrib, escreu escrib, succed suced, success suces, accept acept, "
        "excell excel, illustr ilustr, intellig intelig, colleg coleg, colloc coloc, assumpt asunt, psych psic, mechan mecan, technic tecnic"
    ),
    "it": _pairs("hau av, hav av, huom uom, histor istor, honor onor, honest onest, human uman, humil umil"),
}
# What de grew together with in Spanish.
JOINED = {"d" + w: "de " + w.replace("ss", "s").replace("estotr", "este otr") for w in "esta este esto estas estos essa esso essas essos esa eso esas esos ella ello ellas ellos aquel aquella aquello aquellos aquellas alli alla aqui estotro estotra".split()}
# Sound changes by language, in order.
SOUNDS = {
    "es": [
        ("ph", "f"), ("th", "t"), ("ch(?=[rl])", "c"), ("qu(?=[ao])", "cu"), ("quen(?=[tc])", "cuen"), ("^quest", "cuest"), ("^sc(?=[ei])", "c"), ("([aeiou])sc(?=[ei])", "\\1c"), ("^s(?=[bcdfgjklmnpqrtvz])", "es"), ("y(?![aeiou])", "i"),
        ("^i(?=[aeou])", "j"), ("^v(?=[^aeiou])", "u"), ("([aeiou])u(?=[aeiou])", "\\1v"), ("v", "b"), ("(?<!c)h", ""), ("g(?=[ei])", "j"), ("c(?=[ei])", "z"), ("(^|[nls])rr", "\\1r"), ("n(?=[pb])", "m"), (r"([sfmptbdgn])\1+", "\\1"),
    ],
    "la": [("ae|oe", "e"), ("y", "i"), ("(?<=[a-z])ci(?=[aeiou])", "ti")],
    "fr": [("^v(?=[^aeiouy])", "u"), ("([aeiou])u(?=[aeiou])", "\\1v"), ("^i(?=[aeou])", "j"), ("(?<=...)oit$", "ait"), ("(?<=..)oient$", "aient"), ("(?<=[aeiou])s(?=[tmlnpcq])", ""), ("(?<=[aeiou])y$", "i")],
    "it": [("^h(?!o$|ai$|a$|anno$)", ""), ("^v(?=[^aeiou])", "u"), ("([aeiou])u(?=[aeiou])", "\\1v"), ("j", "i"), ("ph", "f"), ("th", "t"), ("x", "s"), ("[cp]t", "tt"), ("(?<=[a-rt-z])ti(?=[aeiou])", "zi")],
}
_SOUNDS = {lang: [(re.compile(a), b) for a, b in rules] for lang, rules in SOUNDS.items()}
# French words that end so in modern spelling too.
KEEPS_OIT = frozenset("soit voit doit croit boit toit droit endroit adroit maladroit etroit exploit recoit decoit concoit apercoit percoit soient voient croient envoient".split())
# Letters and signs of old prints, and the conjunction that & stands for.
LETTERS = _pairs("ſ s, ʃ s, ß ss, æ ae, œ oe, ꝑ per, ꝓ pro, ꝗ que, ꝙ quod, ꝯ con, ﬀ ff, ﬁ fi, ﬂ fl, ﬃ ffi, ﬄ ffl, ﬅ st, ﬆ st, ꝛ r, ı i, ȷ j, ø o, đ d, ł l, ħ h")
AND = {"es": "y", "la": "et", "fr": "et", "it": "e"}
_LETTERS = str.maketrans(LETTERS)
_QUE, _NASAL, _CEDILLA = re.compile("q[\u0303\u0304]"), re.compile("([aeiou])[\u0303\u0304]+([pb]?)"), re.compile("c\u0327([ei]?)")
#: Words as old prints write them, marks and the sign for and included.
WORD = r"[\p{L}\p{M}\p{N}]+|[&⁊]"
# Latin nouns' and verbs' endings (Schinke and others, 1996), and words whose end is no enclitic.
_NOUN = "ibus ius ae am as em es ia is nt os ud um us a e i o u".split()
_VERB = _pairs("iuntur i, beris bi, erunt i, untur i, iunt i, mini , ntur , stis , bor bi, ero eri, mur , mus , ris , sti , tis , tur , unt i, bo bi, ns , nt , ri , m , r , s , t ")
WITH_QUE = frozenset(
    "atque quoque neque itaque absque apsque abusque adaeque adusque denique deque susque oblique peraeque plenisque quandoque quisque quaeque cuiusque cuique quemque quamque quaque quique quorumque quarumque quibusque quosque "
    "quasque quotusquisque quousque ubique undique usque uterque utique utroque utribique torque coque concoque contorque detorque decoque excoque extorque obtorque optorque retorque recoque attorque incoque intorque praetorque namque "
    "utrumque utraque utrique utriusque quidque quodque quicumque quaecumque quodcumque quacumque quocumque ubicumque undecumque quantumque plerumque plerique pleraque quinque".split()
)
WITH_NE = frozenset("omne bene sine pone paene pene mane inane immane abstine sustine retine contine pertine obtine detine neue siue seue breue graue leue suaue caue aue saeue".split())
ENCLITICS = frozenset(["que", "ne", "ue"])


def prepare(word: str, lang: str = "es") -> str:
    """Lower case, old letters and abbreviations written out, marks removed but for ñ; in Spanish ç is z, or c before e and i."""
    if word in ("&", "⁊"):
        return AND.get(lang, word)
    w = unicodedata.normalize("NFD", word.lower()).translate(_LETTERS)
    if w.isascii():
        return w
    if lang == "es":
        w = _CEDILLA.sub(lambda m: "c" + m[1] if m[1] else "z", w.replace("n\u0303", "ñ"))
    w = _NASAL.sub(lambda m: m[1] + ("m" if m[2] else "n") + m[2], _QUE.sub("que", w))
    return "".join(c for c in w if not unicodedata.combining(c))


def long_s(word: str) -> str:
    """A Spanish word with an f that was a long s as an s: no f stands before s, m, p, c, q, hardly one before t."""
    w = re.sub("f(?=[smpcq])", "s", word)
    if not re.match("naft|aft[ao]s?$|dift|oftalm|soft|loft|kraft|ft", w):
        w = re.sub("f(?=t)", "s", w)
    return w[:-2] + "se" if len(w) > 4 and w.endswith("rfe") else w


class _Trie:
    """The longest beginning of a word among many, letter by letter."""

    def __init__(self, stems: dict[str, str]):
        self.root: dict = {}
        for old, new in stems.items():
            node = self.root
            for c in old:
                node = node.setdefault(c, {})
            node[""] = (len(old), new)

    def change(self, word: str) -> str:
        node, found = self.root, None
        for c in word:
            node = node.get(c)
            if node is None:
                break
            found = node.get("", found)
        return found[1] + word[found[0] :] if found else word


_TRIES = {lang: _Trie(stems) for lang, stems in STEMS.items()}


def enclitic(word: str) -> tuple[str, str]:
    """A Latin word in u/i spelling and the enclitic at its end, if it has one."""
    if word == "nonne":
        return "non", "ne"
    if len(word) > 4 and word.endswith("que") and word not in WITH_QUE:
        return word[:-3], "que"
    if len(word) > 4 and word not in WITH_NE:
        if re.search("[st]ne$", word):
            return word[:-2], "ne"
        if re.search("[stm]ue$", word):
            return word[:-2], "ue"
    return word, ""


def key_of(word: str, lang: str, irregular: dict[str, dict[str, str]] | None = None) -> str:
    """The key of one word, of several words where it stands for several; languages without rules keep the prepared word."""
    w = prepare(word, lang)
    words = (irregular or WORDS).get(lang, {})
    if lang == "la":
        w, end = enclitic(w.replace("v", "u").replace("j", "i"))
    if lang == "es" and w not in words:
        w = long_s(w)
    whole = words.get(w) or (JOINED.get(w) if lang == "es" else None)
    if whole is None:
        whole = _TRIES[lang].change(w) if lang in _TRIES else w
    if lang in ("fr", "it") and w in words or lang == "fr" and w in KEEPS_OIT:
        return whole
    keys = []
    for k in whole.split(" "):
        for pattern, to in _SOUNDS.get(lang, ()):
            k = pattern.sub(to, k)
        keys.append(k)
    return " ".join([*keys, end] if lang == "la" and end else keys)


def stem(word: str) -> str:
    """Noun stem of a Latin word in u/i spelling, of two letters at least."""
    return next((word[: -len(e)] for e in _NOUN if word.endswith(e) and len(word) - len(e) >= 2), word)


def verb_stem(word: str) -> str:
    """Verb stem of a Latin word in u/i spelling, of two letters at least."""
    for end, new in _VERB.items():
        if word.endswith(end):
            found = word[: -len(end)] + new
            return found if len(found) >= 2 else word
    return word


def stems_of(word: str) -> list[str]:
    """Stems of three letters or more to find a Latin word by, other than the key itself."""
    key = key_of(word, "la").split(" ")[0]
    if len(key) < 3 or key in WITH_QUE:
        return []
    return list(dict.fromkeys(s for s in (stem(key), verb_stem(key)) if s != key and len(s) >= 3))


def vocabulary(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """lang, word, n: distinct words of the corpus by language."""
    return docs.select(lang, F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD), F.lit(0))).alias("word")).groupBy(lang, "word").agg(F.count(F.lit(1)).alias("n"))


def keyed(vocab: DataFrame, lang: str = "lang", word: str = "word") -> DataFrame:
    """Adds spelling_key to a vocabulary, by a vectorised function over distinct words."""

    @F.pandas_udf("string")
    def run(w: pd.Series, g: pd.Series) -> pd.Series:
        return pd.Series([key_of(a, b) if isinstance(a, str) else None for a, b in zip(w, g)])

    return vocab.withColumn("spelling_key", run(word, lang))


# Signs that only old prints have, and words and ends of words.
OLD_SIGNS = {"es": "ſ|q\u0303|[ãẽĩõũ]|[àèìòù]|ç", "fr": "ſ", "it": "ſ"}
OLD_WORDS = {
    "es": "assi ansi quando qual quales quanto quanta quantos quantas quatro dixo dixe dixeron muger mugeres agora aora desta deste destos destas dello della dellos mesmo mesma hazer haze hazen hazia dezir dize dizen dezia vn vna vnos "
    "vnas avia havia avian havian aver haver huvo uvo proprio propria traygo reyno reyna ayre oyr essa esso esse essos essas excesso sucesso exercito exemplo baxo dexar dexo quexa fee vuessa vuesa cuydado cuydar christiano christiana "
    "christo iusticia iuez aqueste aquesta aquesto fazer fizo fasta vido truxo trujo estonces",
    "fr": "estoit estoient avoit avoient faisoit disoit estre mesme mesmes nostre vostre aussy ainsy icy faict dict aultre eust fust nuict sçavoir scavoir cognoistre connoistre roy loy foy moy luy celuy vray maistre teste beste feste isle ung",
    "it": "huomo huomini hoggi hauere havere haueua haveva hauea havea hebbe anchora imperoche percioche et",
}
OLD_ENDS = {"es": r"\p{L}+ss(?:e|en|emos|es)", "fr": r"\p{L}{3,}oient", "it": r"\p{L}+ti(?:a|one)"}


def old_word_pattern(lang: str) -> str:
    """Pattern of a whole word that only old prints have."""
    return f"^(?:{OLD_ENDS[lang]}|{'|'.join(OLD_WORDS[lang].split())})$"


def old_signals(text: Column, lang: str) -> Column:
    """How many signs and words of old spelling a text has."""
    low = F.lower(text)
    words = F.filter(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{M}]+"), F.lit(0)), lambda w: w.rlike(old_word_pattern(lang)))
    return F.size(F.regexp_extract_all(low, F.lit(OLD_SIGNS[lang]), F.lit(0))) + F.size(words)


def is_old(text: Column, lang: Column, year: Column) -> Column:
    """Whether a text is in old spelling: by its year, else by two signs and one in a hundred words, or one in twenty of a short text."""
    words = F.size(T.tokens(text))
    out = lang == "la"
    for g, year_from in MODERN_FROM.items():
        n = old_signals(text, g)
        seen = ((n >= 2) & (n >= words * 0.01)) | ((words < 40) & (n >= 1) & (n * 20 >= words))
        out = out | ((lang == g) & (F.coalesce(year < year_from, F.lit(False)) | seen))
    return out


def variants(query: str, langs: tuple[str, ...] = ("es", "la", "fr", "it")) -> list[str]:
    """What a word or phrase of a query may stand as in the shadow of an old text: its key in every language, stems of a single
    Latin word; not as it stands itself."""
    words = re.findall(r"[^\W_]+(?:[\u0300-\u036f]+[^\W_]*)*", query)
    plain = " ".join("".join(c for c in unicodedata.normalize("NFD", w.lower()) if not unicodedata.combining(c)) for w in words)
    out = []
    for g in langs:
        keys = " ".join(key_of(w, g) for w in words)
        if g == "la" and len(words) == 1:
            keys = " ".join(k for k in keys.split(" ") if k not in ENCLITICS)
            out += [keys, *stems_of(words[0])]
        else:
            out.append(keys)
    return [v for v in dict.fromkeys(out) if v and v != plain]


def shadowed(docs: DataFrame, key: str, text: str, lang: str, year: str) -> DataFrame:
    """key, shadow: the text to search an old-spelling text by, words by their keys in order and Latin stems once each after them; empty where it gains nothing.

    Keys are made for distinct words only and joined to the places of the words.
    """
    src = docs.select(key, F.col(text).alias("_t"), F.col(lang).alias("_g"), F.col(year).alias("_y"))
    old = src.where(F.coalesce(is_old(F.col("_t"), F.col("_g"), F.col("_y")), F.lit(False)))
    words = old.select(key, "_g", F.posexplode(F.regexp_extract_all(F.lower("_t"), F.lit(WORD), F.lit(0))).alias("_p", "word"))
    known = keyed(words.select("_g", "word").distinct(), "_g", "word")

    @F.pandas_udf("array<string>")
    def stems(w: pd.Series, g: pd.Series) -> pd.Series:
        return pd.Series([stems_of(a) if b == "la" and isinstance(a, str) else [] for a, b in zip(w, g)])

    known = known.withColumn("_s", stems("word", "_g"))
    each = words.join(known, ["_g", "word"]).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_p", "spelling_key", "_s", "word"))).alias("_w"))
    main = F.array_join(F.transform("_w", lambda x: x["spelling_key"]), " ")
    plain = F.array_join(F.transform("_w", lambda x: T.fold(x["word"])), " ")
    more = F.array_distinct(F.flatten(F.transform("_w", lambda x: x["_s"])))
    made = each.select(key, F.when((main == plain) & (F.size(more) == 0), "").otherwise(F.concat_ws(" ", main, F.nullif(F.array_join(more, " "), F.lit("")))).alias("shadow"))
    return docs.select(key).join(made, key, "left").select(key, F.coalesce("shadow", F.lit("")).alias("shadow"))
