"""From patterns to triclusters: shape, coherence, duplicates, overlap and order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import feature_of, offset_of
from ..schemas import NUMERIC, SYMBOLIC
from ..sources.storage import stored

FEATURES = [*NUMERIC, *SYMBOLIC]


def from_patterns(found: DataFrame, min_rows: int, min_features: int, min_offsets: int) -> DataFrame:
    """Rows (windows), cols (features) and contexts (offsets) of patterns that are large enough."""
    tokens = F.flatten("itemsets")
    distinct = lambda f: F.array_sort(F.array_distinct(F.filter(F.transform(tokens, f), lambda v: v.isNotNull())))
    out = found.select("city", F.col("pattern_id").alias("id"), "pattern_string", "support", F.col("subject_ids").alias("rows"), distinct(feature_of).alias("cols"), distinct(offset_of).alias("contexts"))
    return out.where((F.size("rows") >= min_rows) & (F.size("cols") >= min_features) & (F.size("contexts") >= min_offsets))


def block_cells(blocks: DataFrame, cube: DataFrame) -> DataFrame:
    """The cube's cells in each block (city, id, rows, cols, contexts): one equi-join on the three exploded sides."""
    keys = blocks.select("city", "id", "contexts", "cols", F.explode("rows").alias("window_id")).select("city", "id", "cols", "window_id", F.explode("contexts").alias("context_idx")).select("city", "id", "window_id", "context_idx", F.explode("cols").alias("feature_idx"))
    return keys.join(cube, ["city", "window_id", "context_idx", "feature_idx"])


def variation(cells: DataFrame) -> DataFrame:
    """(city, id, cv): mean over offsets and numeric features of population deviation by |mean|, 0 where the mean is about 0."""
    each = cells.where(F.col("feature_idx") < len(NUMERIC)).groupBy("city", "id", "context_idx", "feature_idx").agg(F.avg("num").alias("m"), F.stddev_pop("num").alias("s"))
    ratio = F.when(F.abs("m") < 1e-12, 0.0).otherwise(F.col("s") / F.abs("m"))
    return each.groupBy("city", "id").agg(F.avg(F.coalesce(ratio, F.lit(0.0))).alias("cv"))


def impurity(cells: DataFrame) -> DataFrame:
    """(city, id, gini): mean over offsets and symbolic features of 1 less the sum of squared shares."""
    counted = cells.where(F.col("feature_idx") >= len(NUMERIC)).groupBy("city", "id", "context_idx", "feature_idx", "sym").agg(F.count("sym").cast("double").alias("n"))
    each = counted.groupBy("city", "id", "context_idx", "feature_idx").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    gini = F.when(F.col("total") > 0, 1 - F.col("squares") / (F.col("total") * F.col("total"))).otherwise(0.0)
    return each.groupBy("city", "id").agg(F.avg(gini).alias("gini"))


def coherence(blocks: DataFrame, cube: DataFrame) -> DataFrame:
    """``blocks`` with hvar3: variation and impurity, each by the size of its part of the block, and the share of missing cells."""
    cells = block_cells(blocks, cube)
    numeric = F.size(F.filter("cols", lambda c: c < len(NUMERIC)))
    symbolic = F.size("cols") - numeric
    area = F.size("rows") * F.size("contexts")
    gone = cells.groupBy("city", "id").agg(F.avg((F.col("num").isNull() & F.col("sym").isNull()).cast("int")).alias("gap"))
    parts = blocks.join(variation(cells), ["city", "id"], "left").join(impurity(cells), ["city", "id"], "left").join(gone, ["city", "id"], "left")
    term = lambda v, n: F.when(n > 0, F.coalesce(v, F.lit(0.0)) / (area * n)).otherwise(0.0)
    return parts.withColumn("hvar3", term(F.col("cv"), numeric) + term(F.col("gini"), symbolic) + F.coalesce("gap", F.lit(0.0))).drop("cv", "gini", "gap")


def described(blocks: DataFrame) -> DataFrame:
    """Type, feature names by kind, and shape."""
    names = F.array(*map(F.lit, FEATURES))
    named = lambda keep: F.transform(F.filter("cols", keep), lambda c: F.when(c < len(FEATURES), F.get(names, c)).otherwise(F.concat(F.lit("feature_"), c.cast("string"))))
    numeric, symbolic = named(lambda c: c < len(NUMERIC)), named(lambda c: c >= len(NUMERIC))
    kind = F.when(F.size(numeric) == 0, "symbolic").when(F.size(symbolic) == 0, "numeric").otherwise("mixed")
    shape = F.struct(F.size("rows").alias("rows"), F.size("cols").alias("features"), F.size("contexts").alias("contexts"), (F.size("rows") * F.size("cols") * F.size("contexts")).alias("volume"))
    return blocks.withColumns({"feature_names": named(lambda c: F.lit(True)), "feature_groups": F.struct(numeric.alias("numeric"), symbolic.alias("symbolic")), "type": kind, "shape": shape})


def deduplicated(blocks: DataFrame) -> DataFrame:
    """The first of blocks of equal rows, cols and contexts."""
    rank = F.row_number().over(Window.partitionBy("city", "rows", "cols", "contexts").orderBy("id"))
    return blocks.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def _common(a: str, b: str) -> Column:
    return F.size(F.array_intersect(a, b)).cast("long")


def overlaps(blocks: DataFrame, least: float = 0.0) -> DataFrame:
    """(city, a, b, jaccard) of the pairs a < b that have a cell in common and overlap by ``least`` or more.

    A pair's overlap is at most that of its windows alone, so that windows overlap by ``least``, too, and a pair shares one
    of the first windows of each, rarest first: it is found by an equi-join on these rather than among all pairs.
    """
    one = blocks.select("city", F.col("id").alias("a"), F.col("rows").alias("ra"), F.col("cols").alias("ca"), F.col("contexts").alias("ka"))
    two = blocks.select("city", F.col("id").alias("b"), F.col("rows").alias("rb"), F.col("cols").alias("cb"), F.col("contexts").alias("kb"))
    flat = blocks.select("city", "id", F.size("rows").alias("n"), F.size("cols").alias("c"), F.size("contexts").alias("k"), F.explode("rows").alias("w"))
    if least > 0:
        common = flat.groupBy("city", "w").agg(F.count("*").alias("times"))
        rank = F.row_number().over(Window.partitionBy("city", "id").orderBy("times", "w"))
        flat = flat.join(common, ["city", "w"]).withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).drop("times", "rank")
    other = flat.select("city", "w", F.col("id").alias("b"), *(F.col(x).alias(f"{x}2") for x in "nck"))
    near = [F.least(x, f"{x}2") >= F.greatest(x, f"{x}2") * least - 1e-9 for x in "nck"]
    pairs = flat.withColumnRenamed("id", "a").join(other, ["city", "w"]).where((F.col("a") < F.col("b")) & near[0] & near[1] & near[2]).select("city", "a", "b").distinct()
    both = pairs.join(one, ["city", "a"]).join(two, ["city", "b"])
    volume = lambda r, c, k: F.size(r).cast("long") * F.size(c) * F.size(k)
    inter = _common("ra", "rb") * _common("ca", "cb") * _common("ka", "kb")
    union = volume("ra", "ca", "ka") + volume("rb", "cb", "kb") - inter
    return both.select("city", "a", "b", F.when(union > 0, inter / union).otherwise(0.0).alias("jaccard")).where(F.col("jaccard") >= least)


#: Blocks of a city that are judged in a round, and blocks that a task holds against a round's chosen ones.
CHUNK, HELD = 20_000, 20_000


def overlap_filtered(blocks: DataFrame, limit: float | None) -> DataFrame:
    """Blocks in order of hvar3 and size, each kept unless it overlaps a kept one by ``limit`` or more; None keeps all."""
    if limit is None:
        return blocks
    kinds = dict(blocks.dtypes)
    lists = ["rows", "cols", "contexts"]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{c: [np.packbits(np.bincount(v, minlength=8) > 0).tobytes() for v in batch[c]] for c in lists})

    narrow = blocks.select("city", "id", F.col("hvar3").cast("double").alias("hvar3"), F.col("shape.volume").cast("long").alias("volume"), *lists)
    marked = narrow.mapInPandas(pack, f"city string, id {kinds['id']}, hvar3 double, volume long, rows binary, cols binary, contexts binary").withColumnRenamed("rows", "windows")
    return blocks.join(apart(marked, ["id"], limit), ["city", "id"], "left_semi")


def apart(marked: DataFrame, key: list[str], limit: float) -> DataFrame:
    """(city, *key) of the blocks that the greedy choice keeps.

    ``marked`` has city, ``key``, hvar3, volume and, as bits, windows, cols and contexts. The choice goes by rounds: of each city the
    first ``CHUNK`` blocks in order are judged among themselves, and what overlaps a chosen one leaves the others, which are held
    against the chosen ones in parts of about ``HELD``. What is chosen is the same as one by one: no block is judged before all that
    precede it have been.
    """
    left = stored(marked, "blocks")
    order = [F.col("hvar3"), F.desc("volume"), *map(F.col, key)]
    schema = left.schema
    sort, way = ["hvar3", "volume", *key], [True, False, *(True for _ in key)]

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(sort, ascending=way)
        own, open_, kept = _Bits(frame), np.ones(len(frame), dtype=bool), []
        for i in range(len(frame)):
            if open_[i]:
                kept.append(i)
                later = np.flatnonzero(open_[i + 1 :]) + i + 1
                open_[later[own.over(np.array([i]), own, later, limit)[0]]] = False
        return frame.iloc[kept]

    def leave(frame: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
        frame = frame[names]
        if not len(frame) or not len(chosen):
            return frame
        own, other = _Bits(frame), _Bits(chosen)
        gone = np.zeros(len(frame), dtype=bool)
        for one in own.alike():
            near = other.near(own, one[0], limit)
            for a in range(0, len(one), step := max(1, 2_000_000 // max(1, len(near) * own.words))):
                part = one[a : a + step]
                gone[part] = own.over(part, other, near, limit).any(axis=1)
        return frame[~gone]

    names, found = left.columns, None
    while not left.isEmpty():
        first = left.withColumn("__place", F.row_number().over(Window.partitionBy("city").orderBy(*order))).where(F.col("__place") <= CHUNK)
        chosen = stored(first.drop("__place").groupBy("city").applyInPandas(choose, schema), "chosen")
        found = chosen.select("city", *key) if found is None else found.unionByName(chosen.select("city", *key))
        # what precedes the last chosen one has been judged
        last = first.groupBy("city").agg(F.max(F.struct(F.col("hvar3"), (-F.col("volume")).alias("v"), *key)).alias("__last"), F.max("__place").alias("__n"))
        rest = left.join(last.where(F.col("__n") == CHUNK), "city").where(F.struct(F.col("hvar3"), (-F.col("volume")).alias("v"), *key) > F.col("__last")).select(*names)
        counts = rest.groupBy("city").agg(F.ceil(F.count("*") / HELD).alias("__parts"))
        dealt = rest.join(counts, "city").withColumn("__part", F.pmod(F.xxhash64(*key), F.col("__parts"))).drop("__parts")
        sent = chosen.join(counts, "city").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__parts") - 1))).drop("__parts")
        left = stored(dealt.groupBy("city", "__part").cogroup(sent.groupBy("city", "__part")).applyInPandas(leave, schema), "blocks")
    return found if found is not None else left.select("city", *key)


class _Bits:
    """Windows, features and offsets of blocks as bits, for their overlaps."""

    def __init__(self, frame: pd.DataFrame):
        self.sides = [self._read(frame[c]) for c in ("windows", "cols", "contexts")]
        self.sizes = [np.bitwise_count(s).sum(axis=1, dtype=np.int64) for s in self.sides]
        self.volume = self.sizes[0] * self.sizes[1] * self.sizes[2]
        self.words = self.sides[0].shape[1]

    @staticmethod
    def _read(values: pd.Series) -> np.ndarray:
        width = -(-max(map(len, values), default=8) // 8) * 8
        return np.frombuffer(b"".join(v.ljust(width, b"\0") for v in values), np.uint64).reshape(len(values), -1)

    def alike(self) -> list[np.ndarray]:
        """Places of blocks of the same features and offsets."""
        key = np.hstack([self.sides[1], self.sides[2]])
        order = np.lexsort(key.T)
        new = np.flatnonzero((key[order[1:]] != key[order[:-1]]).any(axis=1)) + 1
        return np.split(order, new)

    def common(self, side: int, i: np.ndarray, other: _Bits, j: np.ndarray) -> np.ndarray:
        a, b = self.sides[side][i], other.sides[side][j]
        width = min(a.shape[1], b.shape[1])
        return np.bitwise_count(a[:, None, :width] & b[None, :, :width]).sum(axis=2, dtype=np.int64)

    def near(self, own: _Bits, i: int, limit: float) -> np.ndarray:
        """Places of blocks whose features and whose offsets overlap those of block ``i`` of ``own`` by the limit."""
        out = np.ones(len(self.volume), dtype=bool)
        for side in (1, 2):
            both = own.common(side, np.array([i]), self, np.arange(len(out)))[0]
            out &= both >= limit * (own.sizes[side][i] + self.sizes[side] - both) - 1e-9
        return np.flatnonzero(out)

    def over(self, i: np.ndarray, other: _Bits, j: np.ndarray, limit: float) -> np.ndarray:
        """Whether blocks ``i`` overlap blocks ``j`` of ``other`` by the limit, as rows for ``i``."""
        both = self.common(0, i, other, j) * self.common(1, i, other, j) * self.common(2, i, other, j)
        return both / (self.volume[i][:, None] + other.volume[j] - both) >= limit


def ordered(blocks: DataFrame) -> DataFrame:
    """With ``place`` in the engine's order: hvar3, then volume, rows, contexts and features, larger first."""
    keys = [F.col("hvar3"), F.desc("shape.volume"), F.desc("shape.rows"), F.desc("shape.contexts"), F.desc("shape.features"), F.col("id")]
    return blocks.withColumn("place", F.row_number().over(Window.partitionBy("city").orderBy(*keys)))
