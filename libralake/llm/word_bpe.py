"""BPE encoding and decoding with a word-level BPE file (lower-casing, word ends).

Input: a table with a key column and a text column (null text: empty).  Every
text is encoded whole.  Empty texts and texts of white space give no ids and the
empty decoded text; repeated rows give repeated results; other columns are not
looked at and may have any name.  Two or more equal keys give one row each.

Text never merges across white space, so a worker remembers what it has encoded
per run of non-space characters (a cache bounded in bytes, dropped at the end of a task) and the prefix table is only
built for new words.  Nothing is shuffled: one scan, Arrow batches, one row out
per row in, so a lost executor only repeats its own input splits.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._arrow import filled, slices
from .bpe_dp import PrefixBpe, Remembered

END = "\0"
#: Ids are packed as unsigned 32-bit numbers.
CODE = "I"
#: Python's ``split`` also parts at these four controls, which are no white space for the tokenizer.
_NOT_SPACE = regex.compile("[\x1c-\x1f]")
_RUNS = regex.compile(r"\S+")
#: Latin, Greek, Cyrillic, kana, Han and Hangul in use for long: all tables of characters agree on them.  Others are parted by the library's own tables.
_SETTLED = regex.compile("[\0-\u036f\u0370-\u052f\u3040-\u30ff\u4e00-\u9fa5\uac00-\ud7a3]*")


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Words(Remembered):
    """Maps a pre-tokenised word to its ids, packed."""

    most_bytes = 8 << 20

    def __init__(self, spec: dict):
        super().__init__()
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        special = {t["content"] for t in spec["added_tokens"]}
        own = lambda t: t[: -len(suffix)] + END if t.endswith(suffix) else t
        vocabulary = {own(t): i for t, i in model["vocab"].items() if t not in special}
        merges = {(own(a), own(b)): r for r, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"])}
        self.dp = PrefixBpe(vocabulary, lambda a, b: merges.get((a, b)), self._symbols)
        self.id = [vocabulary[t] for t in self.dp.names]
        self.shown = [t.replace(END, suffix) for t in self.dp.names]
        self.letters = _byte_letters()

    @staticmethod
    def _symbols(s: str) -> list[str]:
        return [*s[:-2], s[-2:]] if s.endswith(END) else list(s)

    def compute(self, word: str) -> bytes:
        s = word if word.isascii() and word.isprintable() else word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
        return array(CODE, [self.id[t] for t in self.dp.encode(s + END)]).tobytes()


def _lowered(text: str) -> str:
    """NFC and lower case, character by character."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class WordBpe(Remembered):
    """Maps a run of non-space characters to its ids, packed.

    Words of letters are runs too, so they are remembered here alone; ``words`` has the other pieces.
    """

    most_bytes = 64 << 20

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.words = Words(spec)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.name = dict(zip(self.words.id, self.words.shown)) | {i: t for t, i in self.special.items()}
        self.number = {i: str(i) for i in self.name}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(pattern).findall
        self.pattern, self.normalizer = pattern, spec["normalizer"]
        self.library = None
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def forget(self) -> None:
        super().forget()
        if hasattr(self, "words"):
            self.words.forget()

    def _pieces(self, run: str) -> Iterator[bytes]:
        parts = self.at_special.split(run) if self.at_special and any(t in run for t in self.special) else [run]
        for part in parts:
            if part in self.special:
                yield array(CODE, [self.special[part]]).tobytes()
            elif _SETTLED.fullmatch(part):
                yield from map(self.words.__getitem__, self.split(_lowered(part)))
            else:
                yield from map(self.words.__getitem__, self._library_pieces(part))

    def _library_pieces(self, text: str) -> list[str]:
        """The words of a text by the library's own tables, which are loaded without its vocabulary, and only where a text needs them."""
        if self.library is None:
            import tokenizers

            light = {"version": "1.0", "added_tokens": [], "normalizer": self.normalizer, "model": {"type": "BPE", "vocab": {}, "merges": []}}
            split = tokenizers.pre_tokenizers.Split(tokenizers.Regex(self.pattern), "removed", invert=True)
            self.library = (tokenizers.Tokenizer.from_str(json.dumps(light)).normalizer.normalize_str, split.pre_tokenize_str)
        lowered, split = self.library
        return [piece for piece, _ in split(lowered(text))]

    def compute(self, run: str) -> bytes:
        if not _SETTLED.fullmatch(run):
            return b"".join(self._pieces(run))
        low, words = _lowered(run), self.words
        # Letters alone, or with one mark after them, part as the pattern parts them; special tokens are neither.
        if low.isalpha():
            return words.compute(low) if low == run else self[low]
        if low[-1] in ".,;:!?" and low[:-1].isalpha():
            return self[low[:-1]] + words[low[-1]]
        return b"".join(self._pieces(run))

    def runs(self, text: str) -> list[str]:
        return _RUNS.findall(text) if _NOT_SPACE.search(text) else text.split()

    def encode(self, text: str) -> memoryview:
        """The ids of a whole text."""
        return memoryview(b"".join(map(self.__getitem__, self.runs(text)))).cast(CODE)


_held: dict[str, WordBpe] = {}


def held(path: str) -> WordBpe:
    """The encoder of this process; the tables of the vocabulary stay, what it remembers goes with each task."""
    if path not in _held:
        _held[path] = WordBpe(path)
    return _held[path]


def _rows(path: str, key: str, text: str, emit, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = held(path)
        try:
            for batch in slices(batches, text):
                found = [bpe.encode(t) for t in filled(batch.column(text)).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([len(x) for x in found], pa.int64()), *emit(bpe, found)], schema=schema)
        finally:
            bpe.forget()

    return run


def _shown(names: dict[int, str], ids: memoryview) -> str:
    return " ".join(map(names.__getitem__, ids))


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids and decoded text of every row: key, n_tokens, ids array<int>, decoded string."""
    schema = pa.schema([(key, pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def emit(bpe, found):
        flat = np.frombuffer(b"".join(found), CODE).astype(np.int32)
        offs = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(offs), pa.array(flat)), pa.array([_shown(bpe.name, x) for x in found])]

    src = docs.select(docs[key].cast("long").alias(key), docs[text].cast("string").alias(text))
    return src.mapInArrow(_rows(path, key, text, emit, schema), f"{key} long, n_tokens long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``encode``, with SHA-256 digests (hex) of the joined ids and of the decoded text in their place."""
    schema = pa.schema([(key, pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    emit = lambda bpe, found: [pa.array([sha(_shown(names, x)) for x in found]) for names in (bpe.number, bpe.name)]
    src = docs.select(docs[key].cast("long").alias(key), docs[text].cast("string").alias(text))
    return src.mapInArrow(_rows(path, key, text, emit, schema), f"{key} long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode(ids: DataFrame, path: str, key: str = "doc_id", col: str = "ids") -> DataFrame:
    """Text of a column of id lists (null: empty), as the library's decode with special tokens kept."""
    schema = pa.schema([(key, pa.int64()), ("decoded", pa.string())])

    def run(batches):
        name = held(path).name
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array([" ".join(name[i] for i in x or ()) for x in b.column(col).to_pylist()])], schema=schema)

    return ids.select(ids[key].cast("long").alias(key), ids[col].cast("array<int>").alias(col)).mapInArrow(run, f"{key} long, decoded string")
