"""Toxicity by a weighted lexicon matched with Aho-Corasick.

Texts are folded first: lower case, look-alike letters of other scripts and digits or signs inside words to the letters
they stand for, everything else to blanks. One Aho-Corasick automaton holds whole words, word beginnings and exception
phrases; a hit inside an exception phrase doesn't count, and of hits that overlap the leftmost counts, of those that begin
together the longest. The hits' weights are summed and divided by the square root of the number of words; the score is that
density over itself plus a cutoff, so 0.5 lies at the cutoff.

The lexicon is learned from labelled rows: counts of whole words and of word beginnings of at least five letters in toxic
rows and in other rows give log-odds as weights; a list of general English insults is there from the start. At most ``MAX_LABELLED`` labelled rows, chosen by a hash of their id, are
taken (a documented bound of the fit; what is scored has none). Entries have to tell more than chance, over all rows and in
each of ``FOLDS`` parts of them; of these those are chosen one by one that most of the rows hold which aren't explained yet.
The cutoff is the middle, on a log scale, between the densities of both classes where these part, else the best balanced
accuracy.

Defined cases: null or empty text scores 0; an absent or one-sided label table leaves the seed lexicon with its cutoff;
null and repeated ids stay row by row (a label holds for each row of its id; contradicting labels: toxic); an empty
table gives an empty result; whole texts are scored; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, materialize, texts

MAX_LABELLED = 20_000
#: Lengths of the word beginnings that may become entries.
STEMS = (5, 6, 7)
#: Parts of the labelled rows, by a hash of their id, in more than half of which an entry has to occur in toxic rows.
FOLDS = 3
#: An entry needs this many toxic rows, or this share of them.
LEAST_ROWS, LEAST_SHARE = 4, 0.004
#: Entries that should explain a toxic row.
DEPTH = 2
LEAST_WEIGHT = 2.5
SEED_CUTOFF = 0.05
#: General English insults: entries from the start, unless one in a hundred of the other rows holds them.
SEED_WEIGHT = 4.0
SEED = """asshole bastard bitch cretin creep dimwit dipshit disgusting douchebag dumbass dunce filth freak halfwit idiot idiotic imbecile
jackass jerk liar loser lowlife maggot moron moronic nitwit parasite pathetic pig prick scum scumbag scumbags sleazebag stupid swine tosser trash
twat vermin wanker weasel worthless wretch""".split()
#: Phrases in which a lexicon word isn't an insult.
EXCEPTIONS = (
    "trash can", "trash cans", "trash bin", "trash bag", "trash collection", "trash talk", "clown fish", "class clown", "loser bracket", "loser bracket final", "sore loser",
    "pond scum", "soap scum", "scum line", "idiot proof", "idiot light", "guinea pig", "guinea pigs", "pig iron", "pig farm", "circus freak", "freak accident", "freak storm",
    "control freak", "jerk chicken", "knee jerk", "jerk seasoning", "creep rate", "creep test", "scope creep", "feature creep", "liar paradox", "parasite host", "weasel words",
)
#: Letters of other scripts by the Latin ones they look like.
LOOKALIKES = {"a": "аα", "b": "вβ", "c": "сϲ", "d": "ԁ", "e": "еε", "g": "ɡ", "h": "һн", "i": "іιı", "j": "ј", "k": "кκ", "l": "ӏ", "m": "м", "n": "ո", "o": "оοσ", "p": "рρ", "r": "г", "s": "ѕ", "t": "тτ", "u": "υ", "v": "ν", "w": "ԝ", "x": "хχ", "y": "уγ"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
_FOLD = str.maketrans({c: " " for c in map(chr, range(128)) if not c.isalnum()} | DIGITS | {c: k for k, v in LOOKALIKES.items() for c in v} | {chr(c): None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0xFEFF)})
_SIGNS = re.compile(r"(?<=[^\W_])[@$!|](?=[^\W_])")
_AS = {"@": "a", "$": "s", "!": "i", "|": "l"}


def fold(text: str) -> str:
    """Words of small letters between single blanks or more."""
    text = text.lower()
    if not text.isalnum() and _SIGNS.search(text):
        text = _SIGNS.sub(lambda m: _AS[m[0]], text)
    return text.translate(_FOLD)


@dataclass(frozen=True)
class Lexicon:
    """Entries are ' word ' or ' stem', each of which explains some of at most MAX_LABELLED rows, so that it may be broadcast."""

    weights: dict[str, float]
    cutoff: float

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for phrase in EXCEPTIONS:
            found.add_word(f" {phrase} ", (len(phrase) + 2, None))
        for entry, weight in self.weights.items():
            found.add_word(entry, (len(entry), weight))
        found.make_automaton()
        return found


def density(text: str, automaton: ahocorasick.Automaton) -> float:
    """Weight of the hits that count, by the square root of the number of words."""
    words = fold(text).split()
    if not words:
        return 0.0
    total, end, best = 0.0, -1, 0.0
    hits = [(stop - size + 1, -size, weight) for stop, (size, weight) in automaton.iter(" " + " ".join(words) + " ")]
    for start, size, weight in sorted(hits, key=lambda h: h[:2]):
        if start < end - 1:  # inside the hit before, but for the blank that both share
            continue
        end = start - size
        total += weight or 0.0
    return total / math.sqrt(len(words))


def entries_of(text: str) -> set[str]:
    words = set(fold(text).split())
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in STEMS if len(w) > n}


def _counts(rows: DataFrame) -> DataFrame:
    """(entry, n, folds): rows that hold each entry, and folds of them. Batches are counted in their task before anything is shuffled."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[tuple[str, int]] = Counter()
        for batch in batches:
            for text, fold_ in zip(batch["text"], batch["fold"], strict=True):
                seen.update((e, fold_) for e in entries_of(text))
        yield pd.DataFrame({"entry": [e for e, _ in seen], "fold": [k for _, k in seen], "n": list(seen.values())}).astype({"entry": "str", "fold": "int32", "n": "int64"})

    fold_of = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(FOLDS)).cast("int").alias("fold")
    counted = rows.select("text", fold_of).mapInPandas(lean(count), "entry string, fold int, n long")
    return counted.groupBy("entry").agg(F.sum("n").alias("n"), F.countDistinct("fold").alias("folds"))


def _held(toxic: DataFrame, entries: set[str]) -> list[set[str]]:
    """Which of ``entries`` each labelled toxic row holds; at most MAX_LABELLED rows."""
    shared = toxic.sparkSession.sparkContext.broadcast(entries)

    def hold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"entries": [sorted(entries_of(t) & shared.value) for t in batch["text"]]})

    return [set(r["entries"]) for r in toxic.select("text").mapInPandas(lean(hold), "entries array<string>").collect()]


def _significant(hits: int, n1: int, n0: int, tried: int) -> bool:
    """Whether that many toxic rows and no other ones hold an entry by more than chance, after ``tried`` entries."""
    return hits >= LEAST_ROWS and hits * math.log((n1 + n0) / n1) > math.log(20 * max(tried, 1))


def _covering(held: list[set[str]], weights: dict[str, float], n1: int, n0: int) -> dict[str, float]:
    """Entries one by one, each the one that most toxic rows hold which lack ``DEPTH`` of those chosen so far.

    Rows that copy each other have their common words explained by the first entries, so chance words aren't chosen.
    """
    lacking = [DEPTH] * len(held)
    chosen: dict[str, float] = {}
    while len(chosen) < len(weights):
        gain = Counter(e for own, k in zip(held, lacking, strict=True) if k > 0 for e in own if e not in chosen)
        if not gain:
            break
        entry = max(gain, key=lambda e: (gain[e] * weights[e], -len(e), e))
        if not _significant(gain[entry], n1, n0, len(weights)):
            break
        chosen[entry] = weights[entry]
        for k, own in enumerate(held):
            if entry in own:
                lacking[k] -= 1
                # what overlaps the entry says nothing new
                held[k] = {e for e in own if not e.startswith(entry.rstrip()) and not entry.startswith(e.rstrip())}
    return chosen


def fit(docs: DataFrame, labels: DataFrame, train: Column) -> Lexicon:
    """The lexicon and cutoff from the rows of ``labels`` (doc_id, toxic) for which ``train``, a condition on doc_id, holds."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & train)
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = marked.count()
    if total > MAX_LABELLED:
        marked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(MAX_LABELLED / total * (1 << 20)))
    # at most MAX_LABELLED short rows, about 16 bytes each
    rows = texts(docs).join(F.broadcast(marked), "doc_id")
    # copies of a text are one row of the fit: they say the same
    rows = materialize(rows.groupBy("text").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id")), "labelled")
    toxic, other = rows.where("toxic = 1"), rows.where("toxic = 0")
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Lexicon({f" {w} ": SEED_WEIGHT for w in SEED}, SEED_CUTOFF)
    least = max(LEAST_ROWS, LEAST_SHARE * n1)
    in_toxic = materialize(_counts(toxic).where(F.col("n") >= least), "entries")
    tried = in_toxic.count()
    in_other = _counts(other).select("entry", F.col("n").alias("m"))
    told = in_toxic.where((F.col("folds") * 2 > FOLDS) & (F.col("n") * math.log((n1 + n0) / n1) > math.log(20 * max(tried, 1))))
    told = told.join(in_other, "entry", "left").na.fill(0, ["m"])
    told = told.withColumn("weight", F.log((F.col("n") + 0.5) / (n1 + 1)) - F.log((F.col("m") + 0.5) / (n0 + 1)))
    # an entry may be wrong now and then, but few other rows may hold it
    weights = {r["entry"]: r["weight"] for r in told.where((F.col("weight") >= LEAST_WEIGHT) & (F.col("m") <= 0.1 * F.col("n"))).collect()}
    lexicon = _covering(_held(toxic, set(weights)), weights, n1, n0)
    seeds = {f" {w} " for w in SEED}
    often = {r["entry"] for r in in_other.where(F.col("entry").isin(*seeds) & (F.col("m") > 0.01 * n0)).collect()}
    lexicon = {e: SEED_WEIGHT for e in seeds - often} | lexicon
    found = _densities(rows.select("doc_id", "text", "toxic"), Lexicon(lexicon, 1.0)).select("toxic", "density").collect()
    return Lexicon(lexicon, _cutoff([(r["density"], r["toxic"]) for r in found]))


def _cutoff(found: list[tuple[float, int]]) -> float:
    """The density that parts the labelled rows best; at most MAX_LABELLED of them."""
    found = sorted(found)
    n1 = sum(t for _, t in found)
    n0 = len(found) - n1
    best, at, below1, below0 = -1.0, SEED_CUTOFF, 0, 0
    for k, (d, t) in enumerate(found):
        if d > 0 and (not k or d > found[k - 1][0]):
            good = (n1 - below1) / n1 + below0 / n0
            if good > best:
                under = found[k - 1][0] if k else 0.0
                best, at = good, math.sqrt(d * under) if under > 0 else d / 4
        below1, below0 = below1 + t, below0 + 1 - t
    return at


def _densities(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows without their text, with their density."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon.weights)
    kept = [c for c in rows.columns if c != "text"]
    cutoff = lexicon.cutoff
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept) + ", density double"

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = Lexicon(shared.value, cutoff).automaton()
        for batch in batches:
            yield batch[kept].assign(density=[density(t, automaton) for t in batch["text"]])

    return rows.mapInPandas(lean(score), schema)


def scored(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``rows`` (doc_id, text) as doc_id, score and predicted. No shuffle."""
    d = F.col("density")
    out = _densities(rows.select("doc_id", "text"), lexicon).withColumn("score", d / (d + F.lit(lexicon.cutoff)))
    return out.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def kept_rows(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The whole rows of ``docs`` that aren't toxic. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon.weights)
    cutoff = lexicon.cutoff

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Lexicon(shared.value, cutoff).automaton()
        for batch in batches:
            yield batch.filter(pa.array([density(t or "", automaton) < cutoff for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from (null ids: not held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    lexicon = fit(docs, labels, ~held_out(F.col("doc_id")))
    out = scored(texts(docs), lexicon)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
