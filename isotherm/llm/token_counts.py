"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut into pieces by the tokenizer's pattern; within a piece the adjacent pair of lowest rank is popped from a
heap and joined in a doubly linked list until no pair is left. The count of a piece is its bytes less its merges, so no
token identifiers are made. Special strings inside texts count as one token each, as the library has it by default.

Defined cases: null or empty text has 0 tokens; null and repeated ids are kept row by row; an empty table gives an
empty result; very long texts and pieces are merged in O(n log n); further columns are ignored.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame

from .common import lean, texts

#: The pattern of byte-level tokenizers (fixed value; a property of the vocabulary file's format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
SCHEMA = "doc_id long, n_bytes long, n_tokens long"
#: Pieces that a task keeps in its cache; it starts afresh when that many are held.
CACHED = 300_000


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable ones stand for themselves, the rest follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def load_ranks(path: str) -> tuple[list[int], dict[tuple[int, int], tuple[int, int]], list[str]]:
    """Of a byte-level BPE file: the symbol of each byte, (left, right) to (rank, joined symbol), and the special strings."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab = spec["model"]["vocab"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    ranks = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(pairs)}
    return [vocab[c] for _, c in sorted(byte_alphabet().items())], ranks, [t["content"] for t in spec["added_tokens"]]


def count_merged(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> int:
    """Symbols left once the lowest-rank adjacent pair, leftmost among equals, has been merged again and again."""
    n = len(symbols)
    if n < 2:
        return n
    sym = list(symbols)
    nxt = list(range(1, n + 1))
    prv = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        found = ranks.get((sym[i], sym[i + 1]))
        if found:
            heap.append((found[0], i, sym[i], sym[i + 1], found[1]))
    heapq.heapify(heap)
    left = n
    while heap:
        _, i, a, b, joined = heapq.heappop(heap)
        j = nxt[i]
        if sym[i] != a or j >= n or sym[j] != b:
            continue  # one of the two has been merged since
        sym[i], sym[j] = joined, -1
        nxt[i] = k = nxt[j]
        left -= 1
        if k < n:
            prv[k] = i
            if found := ranks.get((joined, sym[k])):
                heapq.heappush(heap, (found[0], i, joined, sym[k], found[1]))
        if (h := prv[i]) >= 0 and (found := ranks.get((sym[h], joined))):
            heapq.heappush(heap, (found[0], h, sym[h], joined, found[1]))
    return left


class PieceCounts(dict):
    """Piece to token count, filled on demand and bounded in size."""

    def __init__(self, byte_symbols, ranks):
        super().__init__()
        self.byte_symbols, self.ranks = byte_symbols, ranks

    def __missing__(self, piece: str) -> int:
        own = self.byte_symbols
        n = count_merged([own[b] for b in piece.encode()], self.ranks)
        if len(piece) <= 48:
            if len(self) >= CACHED:
                self.clear()
            self[piece] = n
        return n


def counter(byte_symbols, ranks, specials):
    """A function from a text to its token count."""
    find = regex.compile(PATTERN).findall
    counts = PieceCounts(byte_symbols, ranks)
    special = regex.compile("|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True))) if specials else None

    def count(text: str) -> int:
        if special is not None and special.search(text):
            parts = special.split(text)
            return len(parts) - 1 + sum(sum(map(counts.__getitem__, find(p))) for p in parts)
        return sum(map(counts.__getitem__, find(text)))

    return count


def token_counts(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row of ``docs``, by the byte-level BPE file at ``tokenizer_path``.

    The rank table is bounded by the vocabulary and is broadcast; there is no shuffle.
    """
    loaded = docs.sparkSession.sparkContext.broadcast(load_ranks(tokenizer_path))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = counter(*loaded.value)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": [len(t.encode()) for t in batch["text"]], "n_tokens": [of(t) for t in batch["text"]]})

    return texts(docs).mapInPandas(lean(count), SCHEMA)
