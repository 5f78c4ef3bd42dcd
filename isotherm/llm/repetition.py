"""Quality rules over a suffix array: maximal repeated substrings of a text, in words.

The texts of a piece of a batch are laid end to end as numbers of words and their suffixes are ordered by prefix doubling; a
suffix's first key is its document and word together, so that texts never meet and a suffix ends with its text. What is alone in
its group is done, and only groups that are still equal are ordered by twice as many words. The longest common prefix of
neighbours follows from the ranks of each round. An interval of the array whose neighbours share ``RUN`` words or more is a
maximal repeated substring; each suffix lies in its longest one, and the union of these spans is what repeats. A text fails if
repeats cover more than ``COVERED`` of its words' characters or if the longest has more than ``LONGEST`` words.

Before that the base rules hold: at least ``WORDS`` words, and at most ``REPEATED`` percent of the words in repeated runs.

Defined cases: null and empty texts have no words and fail; repeated rows and null ids are judged row by row; very long texts are
judged whole, in a piece of their own, at some 60 bytes a word and round of doubling; an empty table gives an empty result;
further columns are ignored, whatever their names. No shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, pieces, texts

#: Words of a run, least words of a text, and percent of words that may lie in repeated runs.
RUN, WORDS, REPEATED = 5, 10, 20
#: Share of characters that repeats may cover, and words that the longest may have.
COVERED, LONGEST = 0.25, 100
SYMBOLS = "#*$%&|<>"
#: Bytes of text that are ordered at once.
PIECE = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS.encode())] = True


def _numbered(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A number for each of the strings that lie end to end in ``data``, equal for equal ones."""
    offsets = np.zeros(len(sizes) + 1, dtype=np.int64)
    np.cumsum(sizes, out=offsets[1:])
    array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return array.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def suffix_array(symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order and the symbols that each shares with the one before it.

    ``ends``: for each symbol where its text ends; symbols of different texts must differ.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    new = np.r_[True, symbols[order[1:]] != symbols[order[:-1]]] if n else np.zeros(0, bool)
    start = np.flatnonzero(new)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.repeat(start, np.diff(np.r_[start, n]))
    rounds, k = [rank.astype(np.int32)], 1
    while True:
        size = np.diff(np.r_[start, n])
        alive = np.flatnonzero(np.repeat(size > 1, size))  # places in the array
        if not len(alive):
            break
        own = order[alive]
        second = np.where(own + k < ends[own], rank[np.minimum(own + k, n - 1)] + 1, 0)
        key = rank[own] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        order[alive], key = own[by], key[by]
        new[alive] = np.r_[True, key[1:] != key[:-1]]
        start = np.flatnonzero(new)
        rank[order] = np.repeat(start, np.diff(np.r_[start, n]))
        k *= 2
        rounds.append(rank.astype(np.int32))
    a, b = order[1:].copy(), order[:-1].copy()
    shared, left = np.zeros(n, dtype=np.int64), np.arange(1, n)
    same = rounds[0][a] == rounds[0][b]
    a, b, left = a[same], b[same], left[same]
    for j in range(len(rounds) - 1, -1, -1):
        inside = (a < ends[order[left]]) & (b < ends[order[left - 1]])
        x, y = np.minimum(a, n - 1), np.minimum(b, n - 1)
        step = np.where(inside & (rounds[j][x] == rounds[j][y]), 1 << j, 0)
        a, b = a + step, b + step
        shared[left] += step
    return order, shared


def longest_shared(order: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """For each suffix how many of its symbols stand elsewhere, too."""
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.maximum(shared, np.r_[shared[1:], 0]) if len(order) else 0
    return out


def covered(lengths: np.ndarray) -> np.ndarray:
    """Whether a place lies in a span that begins at some place and has its length."""
    begin = np.flatnonzero(lengths)
    change = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.add.at(change, begin, 1)
    np.add.at(change, begin + lengths[begin], -1)
    return np.cumsum(change[:-1]) > 0


def measured(own: list[bytes]) -> dict[str, np.ndarray | list]:
    """Counts of each text, and the spans (from, to in words) that repeat."""
    sizes = np.array([len(t) for t in own], dtype=np.int64)
    n_docs, data = len(own), np.frombuffer(b"".join(own), np.uint8)
    doc = np.repeat(np.arange(n_docs), sizes)
    count = lambda d, w=None: np.bincount(d, weights=w, minlength=n_docs).astype(np.int64)
    begins = np.cumsum(sizes) - sizes
    # words: runs of bytes that aren't space, cut between texts
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    first[begins[sizes > 0]] = word[begins[sizes > 0]]
    letters = word & ((data & 0xC0) != 0x80)
    at = np.flatnonzero(first)
    in_word = np.cumsum(first)[word] - 1  # of each byte of a word
    bytes_of = np.bincount(in_word, minlength=len(at)).astype(np.int64)
    chars_of = np.bincount(in_word, weights=letters[word], minlength=len(at)).astype(np.int64)
    number, owner = _numbered(np.ascontiguousarray(data[word]), bytes_of), doc[at]
    n_words = count(owner)
    # lines: what stands between line feeds and the ends of texts
    feed = data == 0x0A
    line, of = (np.cumsum(feed) + doc)[~feed], doc[~feed]
    head = np.flatnonzero(np.diff(line, prepend=-1))
    length = np.diff(np.r_[head, len(line)])
    with_word = np.add.reduceat(word[~feed], head, dtype=np.int64) > 0 if len(head) else np.zeros(0, bool)
    same, of = _numbered(np.ascontiguousarray(data[~feed]), length)[with_word], of[head][with_word]
    n_dup = count(of) - count(np.unique(of * (len(head) + 1) + same) // (len(head) + 1))
    # suffixes
    ends = np.repeat(np.cumsum(n_words), n_words)
    shares = longest_shared(*suffix_array(owner * (number.max(initial=0) + 1) + number, ends))
    shares[shares < RUN] = 0
    inside = covered(shares)
    longest = np.zeros(n_docs, dtype=np.int64)
    np.maximum.at(longest, owner, shares)
    edge = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)) | np.r_[False, inside[1:] & inside[:-1] & (owner[1:] != owner[:-1]), False]) if len(inside) else np.zeros(0, np.int64)
    spans: list[list[dict[str, int]]] = [[] for _ in own]
    base = np.cumsum(n_words) - n_words
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True) if len(edge) else ():
        if inside[a]:
            k = owner[a]
            spans[k].append({"start": int(a - base[k]), "end": int(b - base[k])})
    return {
        "n_words": n_words, "word_chars": count(owner, chars_of), "n_symbols": count(doc, _SYMBOL[data]), "n_dup_lines": n_dup, "n_repeat_words": count(owner, inside),
        "covered_chars": count(owner[inside], chars_of[inside]), "longest_repeat": longest, "spans": spans,
    }


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_chars long, longest_repeat long, spans array<struct<start:long,end:long>>, base_failed boolean, kept boolean"


def quality_rules(docs: DataFrame, most_covered: float = COVERED, longest: int = LONGEST) -> DataFrame:
    """Counts, repeated spans (in words) and verdict of every row of ``docs``.

    ``n_repeat_words`` are the words in repeated spans, ``covered_chars`` their characters, ``longest_repeat`` the words of the longest.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, own in pieces(batch["text"].to_pylist(), PIECE):
                out = measured(own)
                failed = (out["n_words"] < WORDS) | (100 * out["n_repeat_words"] > REPEATED * out["n_words"])
                kept = ~failed & (out["covered_chars"] <= most_covered * out["word_chars"]) & (out["longest_repeat"] <= longest)
                out |= {"base_failed": failed, "kept": kept}
                yield pa.RecordBatch.from_arrays([batch["doc_id"][a:b], *(pa.array(v, SPANS if c == "spans" else None) for c, v in out.items())], names=["doc_id", *out])

    rows = texts(docs).withColumn("text", F.col("text").cast("binary"))
    return rows.mapInArrow(lean(judge), SCHEMA)
