"""Standing queries over a stream of documents: alerts for what is new, with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def matches(docs: DataFrame, watches: dict[str, list[str]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """watch, key: documents with all terms of a watch; each text is read once for all watches."""
    toks = T.tokens(F.col(text))
    hits = F.filter(F.array(*[F.when(_all_in(F.col("_t"), terms), F.lit(name)) for name, terms in sorted(watches.items())]), lambda w: w.isNotNull())
    return docs.select(key, toks.alias("_t")).select(F.explode(hits).alias("watch"), key)


def _all_in(toks: Column, terms: list[str]) -> Column:
    out = F.lit(True)
    for t in terms:
        out = out & F.array_contains(toks, t)
    return out


def alerts(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """watch, n_new, total: for a stream of matches, what each batch adds to a watch.  The first batch of a watch is its baseline and silent.

    State holds the matched keys of a watch, so that a document that comes again is not new.
    """

    def step(watch, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen = set(state.get[0]) if state.exists else set()
        first = not state.exists
        keys = {int(k) for pdf in batches for k in pdf[key]}
        new = keys - seen
        state.update((sorted(seen | keys),))
        if new and not first:
            yield pd.DataFrame({"watch": [watch[0]], "n_new": [len(new)], "total": [len(seen | keys)]})

    return found.groupBy("watch").applyInPandasWithState(step, "watch string, n_new long, total long", "seen array<long>", "append", "NoTimeout")


def ingest(stream: DataFrame, write, name: str, checkpoint: str, available_now: bool = True):
    """Runs ``write(batch, epoch)`` for every micro-batch; writes must be repeatable, as a batch may come twice."""
    w = stream.writeStream.foreachBatch(write).queryName(name).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()
