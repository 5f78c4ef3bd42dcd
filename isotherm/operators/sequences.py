"""Sequential patterns with any gaps: sequences of sets of items, and patterns that many of them contain.

A sequence contains a pattern if its sets lie, in order, within sets of the sequence. A pattern grows by a step: a sequence step
appends a set of one item, an itemset step adds a larger item to the last set; so each pattern has one parent. Both miners go level
by level and find every frequent pattern whatever its length. A level is counted before anything of it is kept: counts of steps are
summed where they arise, and only what is frequent is written. Equal sequences are one row with their number, and items are numbers
in their order. The sequences that contain a pattern are listed only where they are asked for.

- ``prefixspan``: projected databases as rows. A pattern and a sequence have what of the sequence is left from the first place where
  the pattern can end, and all such places; what follows the first of them, or lies beside them, are the steps. No row is shuffled.
- ``spam``: vertical bitmaps. A pattern has a bit for each place of each sequence of a block; a sequence step sets all bits after the
  first one and meets the item's, an itemset step meets the item's as they are. A task makes the bits of its patterns from the items'
  and returns counts alone, so that no bits are written and a city's sequences are never held as a whole.
- ``clospan``: patterns that no larger one of the same support contains. One with an item more would do, so that it is enough to
  take away each item of each frequent pattern in turn and to drop what is left where its support is the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import pattern_string
from ..sources.storage import numbered, stored

#: Sequences of a block of bitmaps, patterns that a task extends in a block, and words of bitmaps that it holds at once.
BLOCK, HELD, WORDS = 4096, 256, 2**20
PATTERN = "array<array<string>>"


def merged(sequences: DataFrame) -> DataFrame:
    """(city, seq, sets) of (city, seq, itemsets), a row for each sequence: sorted distinct items, sets without any left out."""
    own = sequences.where(F.col("city").isNotNull() & F.col("seq").isNotNull()).groupBy("city", "seq").agg(F.collect_list("itemsets").alias("many"))
    given = lambda s: F.coalesce(s, F.array().cast("array<string>"))
    both = F.reduce("many", F.array().cast(PATTERN), lambda a, b: F.zip_with(a, b, lambda x, y: F.concat(given(x), given(y))))
    return own.select("city", "seq", F.filter(F.transform(both, lambda s: F.array_sort(F.array_distinct(F.filter(s, lambda i: i.isNotNull())))), lambda s: F.size(s) > 0).alias("sets"))


class _Ground:
    """What both miners start from, each table written once.

    ``needed`` (city, needed): sequences that have to contain a pattern; ``codes`` (city, item, code): frequent items, numbered in
    order; ``classes`` (city, cls, n, sets): equal sequences and their number, sets of codes; ``root``: the pattern without items.
    """

    def __init__(self, sequences: DataFrame, min_rows: int, min_share: float, subjects: bool):
        rows = merged(sequences)
        self.rows = rows = stored(rows, "sequences") if subjects else rows
        every = rows.groupBy("city", "sets").agg(F.count("*").alias("n")).withColumn("cls", F.monotonically_increasing_id())
        self.every = every = stored(every, "classes")
        enough = F.greatest(F.lit(min_rows), F.ceil(F.sum("n") * min_share - 1e-9)).cast("int")
        self.needed = stored(every.groupBy("city").agg(enough.alias("needed")), "needed")
        flat = every.select("city", "cls", "n", F.posexplode("sets").alias("pos", "items")).select("city", "cls", "n", "pos", F.explode("items").alias("item"))
        held = flat.select("city", "cls", "n", "item").distinct().groupBy("city", "item").agg(F.sum("n").alias("__n"))
        kept = held.join(self.needed, "city").where(F.col("__n") >= F.col("needed")).select("city", "item")
        self.codes = stored(numbered(kept, ["city"], ["item"], "code").withColumn("code", F.col("code").cast("int")), "codes")
        sets = flat.join(self.codes, ["city", "item"]).groupBy("city", "cls", "n", "pos").agg(F.array_sort(F.collect_list("code")).alias("items"))
        sets = sets.groupBy("city", "cls", "n").agg(F.array_sort(F.collect_list(F.struct("pos", "items"))).alias("sets"))
        self.classes = stored(sets.withColumn("sets", F.transform("sets", lambda s: s["items"])), "classes")
        self.root = self.needed.select("city", F.lit(0).cast("long").alias("id"), F.array().cast("array<int>").alias("steps"), F.array().cast(PATTERN).alias("pattern"))

    def grown(self, counts: DataFrame, known: DataFrame) -> DataFrame:
        """(city, id, step, kid, steps, pattern, support) of the frequent ones among the steps of ``known`` patterns: (city, id, step, n), step 2 * code, and 1 more for itemset steps."""
        total = counts.groupBy("city", "id", "step").agg(F.sum("n").alias("support")).join(self.needed, "city").where(F.col("support") >= F.col("needed"))
        both = total.join(known.select("city", "id", "steps", "pattern"), ["city", "id"]).withColumn("code", F.shiftright("step", 1)).join(self.codes, ["city", "code"])
        one, last = F.array("item"), F.try_element_at("pattern", F.lit(-1))
        pattern = F.when(F.col("step") % 2 == 0, F.concat("pattern", F.array(one))).otherwise(F.concat(F.slice("pattern", 1, F.greatest(F.size("pattern") - 1, F.lit(0))), F.array(F.concat(last, one))))
        return stored(both.select("city", "id", "step", F.monotonically_increasing_id().alias("kid"), F.concat("steps", F.array("step")).alias("steps"), pattern.alias("pattern"), F.col("support").cast("int").alias("support")), "grown")

    def told(self, levels: list[DataFrame], held: list[DataFrame] | None) -> DataFrame:
        """(city, itemsets, support) of all levels' patterns, with ``held`` (city, pattern, cls) also subject_ids."""
        out = _union(levels).select("city", F.col("pattern").alias("itemsets"), "support")
        if held is None:
            return out
        seqs = self.rows.join(self.every, ["city", "sets"]).select("city", "cls", "seq")
        ids = _union(held).join(seqs, ["city", "cls"]).groupBy("city", F.col("pattern").alias("itemsets")).agg(F.array_sort(F.collect_list("seq")).alias("subject_ids"))
        return out.join(ids, ["city", "itemsets"])


def _union(parts: list[DataFrame]) -> DataFrame:
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionByName(x)
    return rows


def _known(grown: DataFrame) -> DataFrame:
    return grown.select("city", F.col("kid").alias("id"), "steps", "pattern", "support")


def prefixspan(sequences: DataFrame, min_rows: int, min_share: float = 0.0, subjects: bool = True) -> DataFrame:
    """(city, itemsets, support, subject_ids) of every frequent pattern of (city, seq, itemsets); without ``subjects`` the ids are left out."""
    ground = _Ground(sequences, min_rows, min_share, subjects)
    # all of a sequence follows an empty set, where the pattern without items ends
    before = F.array(F.array().cast("array<int>"))
    level = ground.classes.select("city", F.lit(0).cast("long").alias("id"), F.lit(None).cast("int").alias("last"), "cls", "n", F.concat(before, "sets").alias("sets"), F.array(F.lit(0)).alias("ends"))
    follow = F.array_distinct(F.flatten(F.slice("sets", 2, F.size("sets"))))
    beside = F.array_distinct(F.flatten(F.transform("ends", lambda j: F.filter(F.col("sets")[j], lambda i: i > F.col("last")))))
    steps = F.concat(F.transform(follow, lambda i: i * 2), F.transform(beside, lambda i: i * 2 + 1))
    code = F.shiftright("step", 1)
    where = F.when(F.col("step") % 2 == 0, F.sequence(F.lit(1), F.greatest(F.size("sets") - 1, F.lit(1)))).otherwise(F.col("ends"))
    hits = F.filter(where, lambda j: F.array_contains(F.col("sets")[j], F.col("last")))
    known, levels, held = ground.root, [], []
    while True:
        grown = ground.grown(level.select("city", "id", "n", F.explode(steps).alias("step")), known)
        if grown.isEmpty():
            break
        known = _known(grown)
        wide = level.withColumn("step", F.explode(steps)).join(grown.select("city", "id", "step", "kid"), ["city", "id", "step"])
        wide = wide.withColumn("last", code).withColumn("hits", hits).withColumn("first", F.col("hits")[0])
        level = stored(wide.select("city", F.col("kid").alias("id"), "last", "cls", "n", F.slice("sets", F.col("first") + 1, F.size("sets")).alias("sets"), F.transform("hits", lambda j: j - F.col("first")).alias("ends")), "level")
        levels.append(known)
        held.append(level.select("city", "id", "cls").join(known.select("city", "id", "pattern"), ["city", "id"]).select("city", "pattern", "cls"))
    return ground.told(levels, held if subjects else None) if levels else _none(sequences, subjects)


def clospan(sequences: DataFrame, min_rows: int, min_share: float = 0.0, subjects: bool = True) -> DataFrame:
    """The frequent patterns that no larger one of the same support contains."""
    found = stored(prefixspan(sequences, min_rows, min_share, subjects), "patterns")
    return found.join(_without_one(found), ["city", "itemsets", "support"], "left_anti")


def _without_one(found: DataFrame) -> DataFrame:
    """(city, itemsets, support) of what is left of each pattern when one of its items is taken away."""
    at = found.select("city", "support", "itemsets", F.posexplode("itemsets").alias("set", "items")).select("city", "support", "itemsets", "set", F.explode("items").alias("item"))
    less = F.transform("itemsets", lambda s, i: F.when(i == F.col("set"), F.filter(s, lambda v: v != F.col("item"))).otherwise(s))
    return at.select("city", F.filter(less, lambda s: F.size(s) > 0).alias("itemsets"), "support").where(F.size("itemsets") > 0).distinct()


def _none(sequences: DataFrame, subjects: bool) -> DataFrame:
    kinds = dict(sequences.dtypes)
    ids = f", subject_ids array<{kinds['seq']}>" if subjects else ""
    return sequences.sparkSession.createDataFrame([], f"city {kinds['city']}, itemsets {PATTERN}, support int{ids}")


def spam(sequences: DataFrame, min_rows: int, min_share: float = 0.0, subjects: bool = True) -> DataFrame:
    """The same patterns as ``prefixspan`` by vertical bitmaps over blocks of sequences."""
    ground = _Ground(sequences, min_rows, min_share, subjects)
    city = dict(sequences.dtypes)["city"]
    placed = numbered(ground.classes, ["city"], ["cls"], "at").withColumn("block", F.floor(F.col("at") / BLOCK)).withColumn("at", (F.col("at") % BLOCK).cast("int"))
    flat = placed.select("city", "block", "at", "n", F.posexplode("sets").alias("pos", "items")).select("city", "block", "at", "n", "pos", F.explode("items").alias("code"))
    board = flat.groupBy("city", "block", "code").agg(F.collect_list(F.struct("at", "pos", "n")).alias("cells"))
    board = stored(board.select("city", "block", "code", *(F.col("cells")[k].alias(k) for k in ("at", "pos", "n"))), "bitmaps")
    blocks = stored(placed.select("city", "block").distinct(), "blocks")

    def dealt(known: DataFrame):
        """Some patterns and a block's items, for each group of them."""
        parts = known.groupBy("city").agg(F.ceil(F.count("*") / HELD).alias("parts"))
        work = known.join(parts, "city").withColumn("part", F.pmod(F.xxhash64("steps"), F.col("parts"))).join(blocks, "city").select("city", "block", "part", "id", "steps")
        given = board.join(parts, "city").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
        return work.groupBy("city", "block", "part").cogroup(given.groupBy("city", "block", "part"))

    def count(work: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        weights = np.zeros(BLOCK)
        for own in given.itertuples():
            weights[own.at] = own.n
        for rows, bits in _bits(work, given):
            later = np.stack([after_first(b) if len(s) else np.full_like(b, ~np.uint64(0)) for b, s in zip(bits, rows["steps"], strict=True)])
            last = np.array([s[-1] >> 1 if len(s) else np.iinfo(np.int32).max for s in rows["steps"]])
            for own in given.itertuples():
                of = bitmap(own.at, own.pos, bits.shape[2])
                for kind, start in ((0, later), (1, bits)):
                    n = np.bitwise_or.reduce(start & of, axis=2).astype(bool) @ weights
                    some = (n > 0) & ((kind == 0) | (own.code > last))
                    out.append(pd.DataFrame({"city": work["city"].iloc[0], "id": rows["id"][some], "step": 2 * own.code + kind, "n": n[some].astype(np.int64)}))
        return pd.concat(out)

    def members(work: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        found = [(i, np.flatnonzero(b.any(axis=1))) for rows, bits in _bits(work, given) for i, b in zip(rows["id"], bits, strict=True)]
        found = [(work["city"].iloc[0], work["block"].iloc[0], i, at) for i, at in found if len(at)]
        return pd.DataFrame(found, columns=["city", "block", "id", "at"])

    known, levels, held = ground.root, [], []
    while True:
        grown = ground.grown(dealt(known).applyInPandas(count, f"city {city}, id long, step int, n long"), known)
        if grown.isEmpty():
            break
        known = _known(grown)
        levels.append(known)
        if subjects:
            at = dealt(known).applyInPandas(members, f"city {city}, block long, id long, at array<int>").withColumn("at", F.explode("at"))
            held.append(at.join(placed.select("city", "block", "at", "cls"), ["city", "block", "at"]).join(known, ["city", "id"]).select("city", "pattern", "cls"))
    return ground.told(levels, held if subjects else None) if levels else _none(sequences, subjects)


def bitmap(at: np.ndarray, pos: np.ndarray, words: int) -> np.ndarray:
    """For each sequence of a block, in words from the lowest on, a bit for each place."""
    out = np.zeros((BLOCK, words), dtype=np.uint64)
    np.bitwise_or.at(out, (at, pos // 64), np.uint64(1) << (pos % 64).astype(np.uint64))
    return out


def _bits(work: pd.DataFrame, given: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Some patterns at a time with their bits, step by step from those of their items."""
    words = max(int(own.pos.max()) for own in given.itertuples()) // 64 + 1
    cells = {own.code: (own.at, own.pos) for own in given.itertuples()}
    size = max(1, WORDS // (BLOCK * words))
    item = lru_cache(maxsize=size)(lambda code: bitmap(*cells[code], words))
    for k in range(0, len(work), size):
        rows, made = work.iloc[k : k + size], []
        for steps in rows["steps"]:
            # the pattern without items ends before every sequence
            bits = np.zeros((BLOCK, words), dtype=np.uint64)
            for j, step in enumerate(steps):
                start = (after_first(bits) if step % 2 == 0 else bits) if j else ~bits
                bits = start & item(step >> 1) if step >> 1 in cells else np.zeros_like(bits)
            made.append(bits)
        yield rows, np.stack(made)


def after_first(bits: np.ndarray) -> np.ndarray:
    """For each row of bits, in words from the lowest on: all bits above the lowest that is set."""
    out = np.zeros_like(bits)
    met = np.zeros(len(bits), dtype=bool)
    whole = ~np.uint64(0)
    for k in range(bits.shape[1]):
        word = bits[:, k]
        lowest = word & (~word + np.uint64(1))
        # above the lowest bit: everything but it and what is below it
        out[:, k] = np.where(met, whole, np.where(word > 0, ~(lowest | (lowest - np.uint64(1))), np.uint64(0)))
        met |= word > 0
    return out


MINERS = {"prefixspan": prefixspan, "spam": spam, "clospan": clospan}


def patterns(sequences: DataFrame, min_rows: int, miner: str = "prefixspan", min_offsets: int = 1, min_share: float = 0.0, subjects: bool = True) -> DataFrame:
    """(city, pattern_id, pattern_string, itemsets, support, subject_ids) by one of ``MINERS``, as ``mining.patterns`` has them; without ``subjects`` the ids are left out."""
    if miner not in MINERS:
        raise ValueError(f"unknown miner: {miner}")
    found = MINERS[miner](sequences, min_rows, min_share, subjects).where(F.size("itemsets") >= min_offsets)
    rows = numbered(found, ["city"], ["itemsets"], "pattern_id")
    return rows.select("city", F.col("pattern_id").cast("int").alias("pattern_id"), pattern_string(F.col("itemsets")).alias("pattern_string"), "itemsets", "support", *(["subject_ids"] if subjects else []))
