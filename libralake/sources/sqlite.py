"""Library files: an SQLite database, gzip-compressed or not, read table by table on the executors."""

from __future__ import annotations

import gzip
import json
import os
import sqlite3
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def open_bytes(data: bytes) -> sqlite3.Connection:
    """A read-only connection to a database given as bytes."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    con = sqlite3.connect(":memory:")
    con.deserialize(data)
    return con


def read_table(spark: SparkSession, path: str, table: str, columns: list[str]) -> DataFrame:
    """path and the given columns (as text; blobs in base 16) of one table of every file under a path."""
    quoted = ", ".join('"' + c.replace('"', '""') + '"' for c in columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, data in zip(pdf["path"], pdf["content"]):
                con = open_bytes(bytes(data))
                rows = con.execute(f'SELECT {quoted} FROM "{table}"').fetchall()
                con.close()
                text = [[p, *(v.hex() if isinstance(v, bytes) else None if v is None else str(v) for v in r)] for r in rows]
                if text:
                    yield pd.DataFrame(text, columns=["path", *columns])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, ", ".join(["path string", *(f"`{c}` string" for c in columns)]))


def floats(blob_hex: F.Column) -> F.Column:
    """Vector of a blob of little-endian 32-bit floats, given in base 16."""

    @F.pandas_udf("array<float>")
    def decode(s: pd.Series) -> pd.Series:
        import numpy as np

        return s.map(lambda h: None if h is None else np.frombuffer(bytes.fromhex(h), "<f4").tolist())

    return decode(blob_hex)


def write(tables: dict[str, pd.DataFrame]) -> bytes:
    """A compressed database of bounded tables; the same tables give the same bytes."""
    with tempfile.TemporaryDirectory() as d:
        con = sqlite3.connect(os.path.join(d, "x"))
        for name, df in sorted(tables.items()):
            cols = ", ".join(f'"{c}"' for c in df.columns)
            con.execute(f'CREATE TABLE "{name}" ({cols})')
            con.executemany(f'INSERT INTO "{name}" VALUES ({", ".join("?" * len(df.columns))})', [[json.dumps(v) if isinstance(v, (list, dict)) else v for v in r] for r in df.astype(object).where(df.notna(), None).values.tolist()])
        con.commit()
        con.execute("VACUUM")
        con.close()
        with open(os.path.join(d, "x"), "rb") as f:
            return gzip.compress(f.read(), 6, mtime=0)
