"""Helpers that several operators of this package share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import shared_dir
from ..sources.storage import stored as materialize

__all__ = ["GAP", "WORD", "given_back", "lean", "materialize", "pieces", "shared_dir", "table", "texts"]

#: Words as maximal runs of ASCII letters and digits and of any non-ASCII characters.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: What stands between two words.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), with null texts as empty ones; further columns of whatever name are left out."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def given_back() -> None:
    """What Arrow and NumPy have freed goes back to the system; workers are reused, and would hold the most that any task took."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


Batches = Iterator[pd.DataFrame] | Iterator[pa.RecordBatch]


def lean(f: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A function for mapInPandas or mapInArrow whose task gives its memory back at the end."""

    def run(batches: Batches) -> Batches:
        yield from f(batches)
        given_back()

    return run


def pieces(values: Iterable[str | bytes], size: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """Ranges of texts of about ``size`` bytes together: (from, to, their bytes)."""
    at, held, own = 0, 0, []
    for k, t in enumerate(values):
        own.append(t if isinstance(t, bytes) else t.encode())
        held += len(own[-1])
        if held >= size:
            yield at, k + 1, own
            at, held, own = k + 1, 0, []
    if own:
        yield at, at + len(own), own
