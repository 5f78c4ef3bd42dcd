"""Fill-in-the-middle rewriting by content-defined chunk memoization.

A text is cut into chunks where a rolling hash of its last bytes says so, so that a passage that many texts share falls into the
same chunks wherever it stands. A task remembers a chunk's summary under the chunk's own bytes, which an equal chunk is verified
by: its number of code points, whether it holds a marker, and its first and last bytes, by which markers across a boundary are
found. A text's length is the sum of its chunks' counts; a cut is located by these sums, and only the chunk that it falls into is
looked at again.

A text becomes ``<P>`` prefix ``<S>`` suffix ``<M>`` middle (psm) or ``<S>`` suffix ``<P>`` prefix ``<M>`` middle (spm), or stays
as it is (plain). Which of them and where it is cut follows from a hash of a seed and the row's id alone.

Defined cases: a null text is an empty one and plain; texts that hold a marker are plain; a null id is hashed as an empty
number; repeated rows come out equal, row by row; very long texts are cut whole; an empty table gives an empty result; further
columns are ignored, whatever their names. No shuffle; a task remembers at most ``CACHED`` chunks.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, texts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes that the rolling hash sees, bits of it that are zero at a chunk's end (512 bytes apart on average), and the least and most bytes of a chunk.
SEEN, BITS, LEAST, MOST = 16, 9, 64, 4096
#: Chunks that a task remembers, some 15 MB; it starts afresh when that many are held.
CACHED = 20_000
#: Bytes of text that are hashed at once.
PIECE = 1 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


class Summary(NamedTuple):
    """What is remembered of a chunk."""

    units: int
    marked: bool
    head: bytes
    tail: bytes


class Summaries(dict):
    """Chunk to summary, filled on demand and bounded in size."""

    def __init__(self, markers: list[bytes]):
        super().__init__()
        self.find = re.compile(b"|".join(map(re.escape, markers))).search
        self.edge = max(map(len, markers)) - 1

    def __missing__(self, chunk: bytes) -> Summary:
        if len(self) >= CACHED:
            self.clear()
        self[chunk] = own = Summary(units_of(chunk), self.find(chunk) is not None, chunk[: self.edge], chunk[-self.edge :])
        return own


def _starts(chunk: bytes) -> np.ndarray:
    """Where its code points begin: at all bytes but those that go on with one."""
    return np.flatnonzero((np.frombuffer(chunk, np.uint8) & 0xC0) != 0x80)


def units_of(chunk: bytes) -> int:
    return len(chunk) if chunk.isascii() else len(_starts(chunk))


def _ends(text: bytes) -> np.ndarray:
    """Places after bytes at which the rolling hash asks for a boundary."""
    found, at = [], 0
    while at < len(text):
        begin = max(0, at - SEEN + 1)
        h = np.frombuffer(text, np.uint8, min(len(text), at + PIECE) - begin, begin).astype(np.uint64) + np.uint64(1)
        size, power = 1, _MULTIPLIER
        while size < SEEN:
            h[size:] += h[:-size].copy() * np.uint64(power)
            size, power = size * 2, power * power & _MASK
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        hit = np.flatnonzero(h >> np.uint64(64 - BITS) == 0) + begin + 1
        found.append(hit[hit > at])
        at += PIECE
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def chunks(text: bytes) -> list[bytes]:
    """The text's chunks, LEAST to MOST bytes each but for the last one; each boundary follows from the bytes since the one before."""
    if not text:
        return []
    out, at = [], 0
    for end in [*_ends(text).tolist(), len(text)]:
        while end - at > MOST:
            out.append(text[at : at + MOST])
            at += MOST
        if end - at >= LEAST or end == len(text) and end > at:
            out.append(text[at:end])
            at = end
    return out


class Located(NamedTuple):
    """A text by its chunks: units in it, whether it holds a marker, the chunks, and units and bytes up to each."""

    units: int
    marked: bool
    parts: list[bytes]
    units_to: list[int]
    bytes_to: list[int]

    def byte_of(self, unit: int) -> int:
        """The byte at which the unit begins; the text's end for the one after the last."""
        if unit >= self.units:
            return self.bytes_to[-1]
        k = bisect_right(self.units_to, unit) - 1
        inside, part = unit - self.units_to[k], self.parts[k]
        return self.bytes_to[k] + (inside if part.isascii() else int(_starts(part)[inside]))


def located(text: bytes, known: Summaries) -> Located:
    parts = chunks(text)
    own = [known[p] for p in parts]
    marked, tail = any(s.marked for s in own), b""
    for s in own:
        if marked:
            break
        marked = known.find(tail + s.head) is not None
        tail = (tail + s.tail)[-known.edge :]
    return Located(sum(s.units for s in own), marked, parts, [0, *accumulate(s.units for s in own)], [0, *accumulate(map(len, parts))])


def draws(id_col: Column, seed: int = 1) -> list[Column]:
    """h1 to h4: the first four groups of 8 hexadecimal digits of the SHA-256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"


def fill_in_middle(docs: DataFrame, seed: int = 1, rate: int = 90, spm_rate: int = 20) -> DataFrame:
    """doc_id, n (code points), form, prefix_chars, middle_chars and output of every row of ``docs``.

    ``rate`` of 100 texts are rewritten, ``spm_rate`` of 100 of these with the suffix first.
    """
    rows = texts(docs).select("doc_id", F.col("text").cast("binary").alias("text"), *draws(F.col("doc_id"), seed))
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Summaries([p, s, m])
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("n", "form", "prefix_chars", "middle_chars", "output")}
            for text, *h in zip(*(batch[c].to_pylist() for c in ("text", "h1", "h2", "h3", "h4")), strict=True):
                own = located(text, known)
                row = (own.units, "plain", None, None, text)
                if own.units and not own.marked and h[2] % 100 < rate:
                    low, high = sorted((h[0] % (own.units + 1), h[1] % (own.units + 1)))
                    a, b = own.byte_of(low), own.byte_of(high)
                    form, parts = ("spm", (s, text[b:], p, text[:a], m, text[a:b])) if h[3] % 100 < spm_rate else ("psm", (p, text[:a], s, text[b:], m, text[a:b]))
                    row = (own.units, form, low, high - low, b"".join(parts))
                for values, value in zip(out.values(), row, strict=True):
                    values.append(value)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
            made = [pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *made], names=["doc_id", *out])

    # as bytes up to here: what isn't UTF-8 in a text isn't altered on the way
    return rows.mapInArrow(lean(rewrite), SCHEMA).withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)
