"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens; it accepts exactly the token sequences that byte-pair merging would give. It starts as one
state that loops over the base symbols. Each merge (a, b) -> c, in rank order, adds a gadget: the arc b leaves the state
reached by a, an arc c is added wherever a was possible, and c leads to a copy of the state that b leads to at that
moment. All arcs of one label lead to one state, so a state is named by the last token and an arc by a token pair. The
gadgets are kept in factored form: ``cut`` has the arcs taken away, ``left`` tells where an arc's label got its places
from, ``right`` tells which state a state was copied from; an arc is worked out from them when it is first tried and
then kept in the transition table.

A word is encoded left to right: from each prefix, whose last token is the automaton's state, the trie of token
spellings gives the arcs' labels that fit the next symbols, and the transition table the ones allowed. Each prefix is
reached by exactly one of them, as the automaton is deterministic and byte-pair merging a function.

Decoding starts in the same state, follows the arc of each id and emits its label; a label that ends a word leads back to
the start. The file has no decoder, so that labels are joined by blanks. Ids that no encoding gives (no such arc) are
decoded label by label.

Defined cases: null or empty text has no tokens and decodes to an empty text; null and repeated ids stay row by row; an
empty table gives an empty result; long words take time in proportion to their length; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame

from .common import lean, texts
from .token_counts import byte_alphabet

#: How such files cut a normalised text into words (fixed value; a property of the vocabulary file's format).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
CODES = "doc_id long, ids array<int>, decoded string"
#: Words that a task keeps in its cache; it starts afresh when that many are held.
CACHED = 250_000


class Automaton:
    """States and arcs compiled from a vocabulary with end-of-word symbols; small enough to broadcast."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        alphabet = byte_alphabet()
        self.labels = {i: t for t, i in vocab.items()}
        self.inner = [vocab[alphabet[b]] for b in range(256)]
        self.final = [vocab[alphabet[b] + suffix] for b in range(256)]
        spelling: dict[int, tuple[int, ...]] = {s: (s,) for s in (*self.inner, *self.final)}
        self.born: dict[int, int] = dict.fromkeys(spelling, -1)
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.cut: dict[int, int] = {}
        for rank, (x, y) in enumerate(merges):
            a, b, c = vocab[x], vocab[y], vocab[x + y]
            if c in self.born:
                raise ValueError(f"two merges make {x + y!r}; the gadgets count on one for each label")
            self.cut[a << 20 | b] = rank
            self.left[c], self.right[c], self.born[c] = a, b, rank
            spelling[c] = spelling[a] + spelling[b]
        last = set(self.final)
        self.ending = {label for label, symbols in spelling.items() if symbols[-1] in last}
        self.arcs: dict[int, bool] = {}
        self.trie: list[dict[int, int]] = [{}]
        self.label_at: list[int] = [-1]
        for label, symbols in spelling.items():
            at = 0
            for s in symbols:
                to = self.trie[at].get(s)
                if to is None:
                    to = self.trie[at][s] = len(self.trie)
                    self.trie.append({})
                    self.label_at.append(-1)
                at = to
            self.label_at[at] = label

    @classmethod
    def of(cls, tables: dict) -> Automaton:
        """From the tables of a compiled one (its ``vars``), as tasks get them."""
        new = cls.__new__(cls)
        vars(new).update(tables)
        return new

    def had(self, state: int, label: int, time: int) -> bool:
        """Whether the arc was there just before the merge of rank ``time`` was compiled."""
        while True:
            own, other = self.born[state], self.born[label]
            when = self.cut.get(state << 20 | label)
            if when is not None and when < time:
                return False
            if own < 0 and other < 0:
                return True
            if own >= other:
                if own == other:  # a label after itself: made at one moment, as its left part was possible after its right one
                    state, label, time = self.right[state], self.left[label], own
                    continue
                state, time = self.right[state], own
            elif self.left[label] == self.right[label] == state:
                return False  # a label doubled: the left one is taken first
            else:
                label, time = self.left[label], other

    def arc(self, key: int) -> bool:
        found = self.arcs.get(key)
        if found is None:
            if len(self.arcs) >= 2_000_000:
                self.arcs.clear()
            found = self.arcs[key] = self.had(key >> 20, key & 0xFFFFF, 1 << 30)
        return found

    def encode_word(self, word: bytes) -> list[int]:
        symbols = [self.inner[b] for b in word]
        symbols[-1] = self.final[word[-1]]
        n = len(symbols)
        last = [-1] * (n + 1)
        trie, label_at, arcs = self.trie, self.label_at, self.arcs
        came = [0] * (n + 1)
        for p in range(n):
            state = last[p]
            at, i = 0, p
            while i < n and (at := trie[at].get(symbols[i], -1)) >= 0:
                i += 1
                label = label_at[at]
                if label >= 0 and last[i] < 0:
                    if state < 0:
                        last[i], came[i] = label, p
                    else:
                        key = state << 20 | label
                        ok = arcs.get(key)
                        if ok or ok is None and self.arc(key):
                            last[i], came[i] = label, p
        out = []
        i = n
        while i > 0:
            out.append(last[i])
            i = came[i]
        return out[::-1]


    def decode(self, ids: list[int]) -> list[str]:
        """The labels of the arcs that the ids take, from the start state on."""
        out, state = [], -1
        for label in ids:
            if state >= 0 and not self.arc(state << 20 | label):
                state = -1
            out.append(self.labels[label])
            state = -1 if label in self.ending else label
        return out


def load_automaton(path: str) -> tuple[Automaton, dict[str, int]]:
    """The automaton of the BPE file at ``path`` and its special strings with their ids."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    return Automaton(spec["model"]["vocab"], merges, spec["model"]["end_of_word_suffix"]), {t["content"]: t["id"] for t in spec["added_tokens"]}


class Codec:
    """Encodes whole texts with a bounded cache of words."""

    def __init__(self, automaton: Automaton, specials: dict[str, int]):
        self.automaton, self.specials = automaton, specials
        self.find = regex.compile(WORDS).findall
        self.special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True)) + ")") if specials else None
        self.ids: dict[str, str] = {}
        self.out: dict[str, str] = {}

    def learn(self, words: list[str]) -> None:
        if len(self.ids) >= CACHED:
            self.ids, self.out = {}, {}
        for w in words:
            if w not in self.ids:
                own = self.automaton.encode_word(w.encode())
                self.ids[w] = " ".join(map(str, own))
                self.out[w] = " ".join(self.automaton.decode(own))

    def words(self, text: str) -> list[str]:
        # each character is lower-cased by itself, so a final capital sigma isn't special
        return self.find(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def of_words(self, words: list[str]) -> tuple[str, str]:
        try:
            return " ".join(map(self.ids.__getitem__, words)), " ".join(map(self.out.__getitem__, words))
        except KeyError:
            self.learn(words)
            return " ".join(map(self.ids.__getitem__, words)), " ".join(map(self.out.__getitem__, words))

    def encode(self, text: str) -> tuple[str, str]:
        """Ids in decimal and decoded text, each joined by single blanks."""
        if self.special is None or not self.special.search(text):
            return self.of_words(self.words(text))
        got = []
        for part in self.special.split(text):
            if part in self.specials:
                got.append((str(self.specials[part]), part))
            elif words := self.words(part):
                got.append(self.of_words(words))
        return " ".join(i for i, _ in got), " ".join(t for _, t in got)


def _encoded(docs: DataFrame, tokenizer_path: str, schema: str, row) -> DataFrame:
    automaton, specials = load_automaton(tokenizer_path)
    loaded = docs.sparkSession.sparkContext.broadcast((vars(automaton), specials))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec(Automaton.of(loaded.value[0]), loaded.value[1])
        names = [c.split(" ")[0] for c in schema.split(", ")]
        for batch in batches:
            got = [row(*codec.encode(t)) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"]} | {c: [g[k] for g in got] for k, c in enumerate(names[1:])})

    return texts(docs).mapInPandas(lean(encode), schema)


def bpe_encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ids and decoded text of every row of ``docs``. No shuffle; the automaton is bounded by the vocabulary and is broadcast."""
    return _encoded(docs, tokenizer_path, CODES, lambda ids, out: ([int(i) for i in ids.split()], out))


def bpe_decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and decoded text of every row of ``encoded`` (doc_id, ids); null ids are an empty text, unknown ones are passed over."""
    automaton, specials = load_automaton(tokenizer_path)
    loaded = encoded.sparkSession.sparkContext.broadcast((vars(automaton), specials))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Automaton.of(loaded.value[0])
        known = own.labels | {i: t for t, i in loaded.value[1].items()}
        own.labels = known
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "decoded": [" ".join(own.decode([i for i in ([] if ids is None else ids) if i in known])) for ids in batch["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(lean(decode), "doc_id long, decoded string")


def bpe_digest(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids and of decoded text, without shipping either."""

    def digest(ids: str, out: str) -> tuple[int, str, str]:
        return ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(out.encode()).hexdigest()

    return _encoded(docs, tokenizer_path, DIGEST, digest)
