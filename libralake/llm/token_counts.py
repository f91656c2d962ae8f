"""Token counts with a SentencePiece BPE file, by prefix dynamic programming.

Input: a table with a key column and a text column (null text: empty, no tokens).
Every text is counted whole; repeated rows give repeated results, other columns
are not looked at.

No piece holds a word mark after another character, so a text parts before every
word mark (and at each character outside all pieces, such as a line feed) into
segments that are encoded independently.  The table of a segment holds the count
of each of its prefixes.  Texts are handled a slice of bounded size at a time: the
slice's distinct segments are put in order, and segments that begin alike share the
table of their common prefix.  Nothing is kept from slice to slice but decisions on pairs of pieces.
``prefix_table`` stores the count of every prefix of a text; ``fitting`` and ``counted`` answer
truncation and budget questions from it with SQL functions, without the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._arrow import filled, slices
from .bpe_dp import PrefixBpe

MARK = "▁"
_WORD = re.compile(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*")
#: Bytes of text whose segments are counted together: the more, the more of them begin alike.
TOGETHER = 16 << 20
#: Segments that are Python strings at once.
CHUNK = 1 << 16
#: Pairs of pieces whose decision is remembered: about 40 MB.
MOST_PAIRS = 600_000


def _bytes(ch: str) -> int:
    return len(ch.encode("utf-8", "surrogatepass"))


class PieceCounter:
    """Counts tokens by words: segments with a mark at the front, or a line feed and the segment after it, which has none."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ranks = {}
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
                ranks[sp.id_to_piece(i)] = -sp.get_score(i)
        if any(MARK in p.lstrip(MARK) for p in ranks):
            raise ValueError("pieces reach over word marks")
        self.dp = PrefixBpe(ranks, lambda a, b: ranks.get(a + b), most_pairs=MOST_PAIRS)
        self.known = frozenset(p for p in ranks if len(p) == 1)

    def runs(self, segment: str) -> Iterator[tuple[str, bool]]:
        """The segment parted into runs of known characters and single unknown ones."""
        at = 0
        for i, ch in enumerate(segment):
            if ch not in self.known:
                if i > at:
                    yield segment[at:i], True
                yield ch, False
                at = i + 1
        if at < len(segment):
            yield segment[at:], True

    def prefix_counts(self, segment: str) -> list[int]:
        """Tokens of every prefix of a segment."""
        out = [0]
        for run, known in self.runs(segment):
            base = out[-1]
            out += [base + c for c in self.dp.prefix_counts(run)[1:]] if known else [base + _bytes(run)]
        return out

    @staticmethod
    def words(text: str) -> list[str]:
        return _WORD.findall(MARK + text.replace(" ", MARK)) if text else []

    def split(self, texts: pa.Array) -> tuple[pa.ListArray, np.ndarray]:
        """Words of all texts, without their first mark, and the row that each list of them is for."""
        odd = pc.equal(texts, "")
        for found in (pc.starts_with(texts, " "), pc.match_substring(texts, "  "), pc.match_substring(texts, MARK)):
            odd = pc.or_(odd, found)
        # In other texts every space is a mark of its own.
        plain = pc.split_pattern(pc.replace_substring(texts.filter(pc.invert(odd)), "\n", " \n"), " ")
        lists = pa.array([[w.removeprefix(MARK) for w in self.words(t)] for t in texts.filter(odd).to_pylist()], plain.type)
        odd = odd.to_numpy(zero_copy_only=False)
        return pa.concat_arrays([plain, lists]), np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])

    def totals(self, words: pa.Array) -> np.ndarray:
        """Tokens of each of these distinct words."""
        order = pc.sort_indices(words)
        in_order = (w for i in range(0, len(order), CHUNK) for w in words.take(order[i : i + CHUNK]).to_numpy(zero_copy_only=False))
        out = np.zeros(len(words), np.int64)
        out[order.to_numpy()] = np.fromiter(self.dp.totals(in_order, _bytes), np.int64, len(words))
        return out

    def fitted(self, texts: pa.Array, budget: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each text, and code points of its longest prefix that has at most ``budget`` tokens."""
        lists, rows = self.split(texts)
        coded = lists.flatten().dictionary_encode()
        bare, at = coded.dictionary, coded.indices.to_numpy()
        words = pc.if_else(pc.starts_with(bare, "\n"), bare, pc.binary_join_element_wise(pa.scalar(MARK, bare.type), bare, pa.scalar("", bare.type)))
        before = np.concatenate([[0], np.cumsum(self.totals(words)[at])])
        offs = lists.offsets.to_numpy()
        n, fit = np.zeros(len(texts), np.int64), pc.utf8_length(texts).to_numpy().astype(np.int64)
        n[rows] = before[offs[1:]] - before[offs[:-1]]
        lengths = pc.utf8_length(words).to_numpy()
        for i in np.flatnonzero(n[rows] > budget):
            first, most = offs[i], before[offs[i]] + budget
            # The word in which the budget ends.
            k = int(np.searchsorted(before, most, "right")) - 1
            inner = self.prefix_counts(words[at[k]].as_py())
            best = max(j for j, c in enumerate(inner) if before[k] + c <= most)
            # The first mark stands for no character of the text.
            fit[rows[i]] = max(0, int(lengths[at[first:k]].sum()) + best - 1)
        return n, fit

    def count(self, text: str) -> int:
        return int(self.fitted(pa.array([text]), 0)[0][0])

    def every_prefix(self, text: str) -> list[int]:
        """Tokens of the first 0, 1, 2, ... code points of the text."""
        out, before = [0], 0
        for i, word in enumerate(self.words(text)):
            inner = self.prefix_counts(word)
            # The first mark stands for no character of the text.
            out += [before + c for c in inner[1 if i else 2 :]]
            before += inner[-1]
        return out


_held: dict[str, PieceCounter] = {}


def held(path: str) -> PieceCounter:
    """The counter of this process: its tables of pieces serve all tasks of a worker."""
    if path not in _held:
        _held[path] = PieceCounter(path)
    return _held[path]


def token_counts(docs: DataFrame, path: str, limit: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens, over_limit, fit_chars (length of the longest prefix within the limit, in code points)."""
    schema = pa.schema([(key, pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("fit_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = held(path)
        for batch in slices(batches, text, TOGETHER):
            texts = filled(batch.column(text))
            n, fit = counter.fitted(texts, limit)
            yield pa.RecordBatch.from_arrays([batch.column(key), pc.binary_length(texts).cast(pa.int64()), pa.array(n), pa.array(n > limit), pa.array(fit)], schema=schema)

    src = docs.select(docs[key].cast("long").alias(key), docs[text].cast("string").alias(text))
    return src.mapInArrow(run, f"{key} long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def prefix_table(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, counts: entry i has the tokens of the text's first i code points (null and empty texts: one entry, 0)."""
    schema = pa.schema([(key, pa.int64()), ("counts", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = held(path)
        for batch in slices(batches, text, 1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(map(counter.every_prefix, filled(batch.column(text)).to_pylist()), schema.field(1).type)], schema=schema)

    src = docs.select(docs[key].cast("long").alias(key), docs[text].cast("string").alias(text))
    return src.mapInArrow(run, f"{key} long, counts array<int>")


def counted(n_chars, counts: str = "counts") -> Column:
    """Tokens of the first ``n_chars`` code points (all of them where the text is shorter)."""
    return F.element_at(counts, F.least(F.lit(n_chars), F.size(counts) - 1) + 1)


def fitting(budget, counts: str = "counts") -> Column:
    """Code points of the longest prefix that has at most ``budget`` tokens."""
    return F.array_max(F.transform(counts, lambda c, i: F.when(c <= F.lit(budget), i)))
