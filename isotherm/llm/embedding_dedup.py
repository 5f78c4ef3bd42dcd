"""Embedding near-dedup by Euclidean p-stable hashing.

Vectors are normalised; in each of several tables ``width``-quantised random (Gaussian) projections make a bucket. Normalised
vectors of cosine c lie sqrt(2 - 2c) apart, which gives the chance that a pair at the threshold shares a bucket; the number
of projections grows with the logarithm of the table's size, so that buckets stay small, and the number of tables is taken
so that such a pair is missed by at most ``MISS`` (closer pairs far less).

Buckets hold row numbers and the signs of ``SIGNS`` further projections (16 bytes), not vectors. Rows of a bucket whose signs
agree as those of a pair at the threshold would (but for a chance of about 1e-7) are united (``nodes``): candidates leave a
bucket as a forest or a star. Within each candidate component vectors are then compared by exact cosine in double precision,
all with all, in blocks; each vector is fetched once for a row of blocks, and out of a block come a count and a link for
each vector, not its pairs. Equal vectors of a label are one row here, with a count. Components of the exact links follow.

Defined cases: null labels, null or empty vectors, zero vectors and vectors with null or non-finite components link with
nothing; vectors of unlike length don't link; repeated rows are vectors of their own, linked with each other; null ids
count as vectors, too, and a component without any id has a null one; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialize
from .components import components
from .nodes import Links, blocked, forest

MISS, BLOCK, SEED = 1e-4, 1024, 20_240_611
#: Far vectors that a bucket should hold at most, about.
MATES = 128
#: Sign projections that candidates are told by.
SIGNS = 128


def _share(width: float, distance: float) -> float:
    """The chance that one quantised projection is the same for vectors that far apart (Datar et al. 2004)."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan_tables(rows: int, threshold: float, width: float) -> tuple[int, int]:
    """Projections to a bucket and tables, for that many vectors of a label."""
    near, far = _share(width, math.sqrt(2 - 2 * threshold)), _share(width, 1.2)
    k = max(2, math.ceil(math.log(max(rows, 2) / MATES) / -math.log(far)))
    return k, math.ceil(math.log(MISS) / math.log1p(-(near**k)))


def differing_signs(threshold: float) -> int:
    """Signs that a pair at the threshold differs in at most, but for a chance of about 1e-7."""
    p = math.acos(min(threshold, 1.0)) / math.pi
    return math.ceil(SIGNS * p + 6 * math.sqrt(SIGNS * p * (1 - p)) + 1)


def _buckets(x: np.ndarray, k: int, tables: int, width: float) -> np.ndarray:
    """A 64-bit bucket key for each vector and table."""
    out = np.empty((len(x), tables), dtype=np.int64)
    for t in range(tables):
        rng = np.random.default_rng([SEED, t])
        a, b, mix = rng.standard_normal((x.shape[1], k)), rng.uniform(0, width, k), rng.integers(1, 2**62, k) | 1
        cells = np.floor((x @ a + b) / width).astype(np.int64)
        key = np.full(len(x), t, dtype=np.int64)
        for j in range(k):
            key = (key ^ cells[:, j]) * mix[j]
            key ^= key >> 29
        out[:, t] = key
    return out


def _unit(vectors) -> np.ndarray:
    v = np.stack(vectors).astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def near_vectors(vectors: DataFrame, threshold: float = 0.98, width: float = 2.0) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding, label)."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    zero = ~F.exists(x, lambda v: v != 0)
    usable = F.coalesce(F.col("label").isNotNull() & (F.size(x) > 0) & ~bad & ~zero, F.lit(False))
    named = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").alias("x"), usable.alias("usable"))
    # equal vectors have the same digest, in any order of rows
    digest = F.md5(F.concat_ws(" ", "label", F.array_join(F.transform("x", lambda v: (v.cast("double") + 0.0).cast("string")), ",")))
    rows = materialize(named.select("vec_id", "label", "x", F.when(F.col("usable"), F.unhex(digest)).alias("digest")), "vectors")
    once = rows.where("digest is not null").groupBy("digest").agg(F.first("label").alias("label"), F.first("x").alias("x"), F.count("*").alias("copies"))
    once = materialize(once, "distinct-vectors")
    largest = once.groupBy("label", F.size("x").alias("size")).count().agg(F.max("count")).first()[0] or 0
    k, tables = plan_tables(largest, threshold, width)
    most = differing_signs(threshold)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["x"].map(len).to_numpy()
            for size in np.unique(sizes):
                part = batch[sizes == size]
                v = _unit(part["x"].to_numpy())
                signs = np.packbits(v @ np.random.default_rng([SEED, 1 << 20]).standard_normal((size, SIGNS)) > 0, axis=1)
                yield pd.DataFrame({"key": part["digest"], "label": part["label"], "size": size, "buckets": list(_buckets(v, k, tables, width)), "brief": [s.tobytes() for s in signs]})

    signed = materialize(once.select("digest", "label", "x").mapInPandas(lean(hashed), "key binary, label string, size int, buckets array<long>, brief binary"), "vector-buckets")
    flat = signed.select(F.explode("buckets").alias("bucket"), "key", "label", "size")
    entries = flat.select(F.xxhash64("label", "size", "bucket").alias("node"), "key")

    def differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.bitwise_count(x.view(np.uint64)[:, None] ^ y.view(np.uint64)[None, :]).sum(axis=2, dtype=np.int64)

    links = Links(
        signed.select("key", "brief"),
        lambda x, y: differ(x, y) <= most,
        lambda x, y: np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)).sum(axis=1, dtype=np.int64) <= most,
        BLOCK,
    )
    counts = entries.groupBy("node").agg(F.count("*").alias("size"), F.min("key").alias("least"))
    hot = materialize(counts.where(F.col("size") > BLOCK), "hot-buckets")
    if not hot.isEmpty():
        mixed = materialize(links.stars(entries.join(hot, "node")), "mixed-buckets")
        if not mixed.isEmpty():
            links.check_large(mixed)
    links.check_small(entries.join(hot, "node", "left_anti"))

    rooted = components(links.found)
    sizes = rooted.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = rooted.join(sizes, "root").join(once.withColumnRenamed("digest", "key"), "key")
    dealt = blocked(members, F.col("blocks")).drop("blocks")

    def checked(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Links and the smallest row reached, of each vector of a component or of a pair of its blocks."""
        n, count, root = len(frame), np.zeros(len(frame), dtype=np.int64), np.arange(len(frame))
        own, first, second, copies = frame["own"].to_numpy(), frame["i"].iat[0], frame["j"].iat[0], frame["copies"].to_numpy()
        size, label = frame["x"].map(len).to_numpy(), frame["label"].to_numpy()
        for kind in set(zip(size.tolist(), label, strict=True)):
            alike = (size == kind[0]) & (label == kind[1])
            left, right = np.flatnonzero(alike & (own == first)), np.flatnonzero(alike & (own == second))
            if len(left) and len(right):
                u, w = _unit(frame["x"].to_numpy()[left]), _unit(frame["x"].to_numpy()[right])
                linked = u @ w.T >= threshold
                if first == second:
                    np.fill_diagonal(linked, False)
                count[left] += linked @ copies[right]
                if first != second:
                    count[right] += copies[left] @ linked
                a, b = np.nonzero(linked)
                root = np.minimum(root, forest(n, left[a], right[b]))
        return count, root

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        """Many small components in one call."""
        out = [(frame["key"].to_numpy()[:0],) * 2 + (np.zeros(0, dtype=np.int64),)]
        for _, part in frame.groupby(["root", "i", "j"], sort=False):
            if len(part) > 1:
                n, root = checked(part)
                key, some = part["key"].to_numpy(), n > 0
                out.append((key[some], key[root[some]], n[some]))
        return pd.DataFrame({c: np.concatenate([o[k] for o in out]) for k, c in enumerate(("key", "root", "n"))})

    parts = max(64, once.count() // 1024)
    found = materialize(dealt.withColumn("part", F.pmod(F.xxhash64("root", "i", "j"), F.lit(parts))).groupBy("part").applyInPandas(packed, "key binary, root binary, n long"), "vector-links")
    counted = found.groupBy("key").agg(F.sum("n").alias("n"))
    classes = components(found.select(F.col("key").alias("a"), F.col("root").alias("b"))).withColumnRenamed("key", "digest")
    classes = once.select("digest", "copies").join(counted.withColumnRenamed("key", "digest"), "digest", "left").join(classes, "digest", "left")
    classes = classes.select("digest", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "digest").alias("root"))
    out = rows.select("vec_id", "digest").join(classes, "digest", "left")
    smallest = out.groupBy("root").agg(F.min("vec_id").alias("least"))
    out = out.join(smallest.where(F.col("root").isNotNull()), "root", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("root").isNull(), F.col("vec_id")).otherwise(F.col("least")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
