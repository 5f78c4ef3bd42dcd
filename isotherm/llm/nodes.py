"""Links among the members of nodes, as what comes out of hashing: (node, key) rows, in which near keys share some node.

A key has a brief (a few bytes), by which near pairs are told. What leaves is never pairs: a forest over a small node, or a
star around a large node's smallest key. Large nodes are hot for one reason mostly, a large group of near copies; its
members are one component once the stars are drawn, and members of one component needn't be compared again. Only members
of a large node outside its most frequent component are compared, with each other and with the rest, in blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, materialize
from .components import components

#: Near, of the rows of two arrays of briefs, each with each; and of their rows at the same place.
Near = Callable[[np.ndarray, np.ndarray], np.ndarray]
PAIR = "a binary, b binary"


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that the links a-b reach, for each of n items."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def blocked(rows: DataFrame, blocks: Column, key: str = "key") -> DataFrame:
    """Rows of groups of ``blocks`` blocks, copied to the pairs of blocks (i, j) that they are checked in."""
    own = F.pmod(F.xxhash64(key), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    return rows.select(*rows.columns, own.alias("own"), F.explode(pairs).alias("p")).select(*rows.columns, "own", "p.i", "p.j")


def _briefs(values) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1)


class Links:
    """Links found so far, and the component of each key by them."""

    def __init__(self, briefs: DataFrame, near: Near, paired: Near, small: int):
        self.briefs, self.near, self.paired, self.small = briefs, near, paired, small
        self.found: DataFrame | None = None
        #: (key, brief, root): the component of each key by the stars so far.
        self.rooted = briefs.select("key", "brief", F.col("key").alias("root"))

    def add(self, links: DataFrame, name: str) -> None:
        links = materialize(links.distinct(), name)
        self.found = links if self.found is None else self.found.unionByName(links)

    def stars(self, large: DataFrame) -> DataFrame:
        """Links each key of large nodes (node, key, least, size) with the node's least if near.

        Returns the nodes whose keys aren't one component then: (node, key, root, head, n_in, n_out), head being the most
        frequent component, n_in and n_out the keys inside and outside of it.
        """
        paired = self.paired

        def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    yield batch.loc[paired(_briefs(batch["brief"]), _briefs(batch["to"])), ["a", "b"]]

        spokes = large.where(F.col("key") != F.col("least")).select(F.col("key").alias("a"), F.col("least").alias("b")).distinct()
        to = self.briefs.select(F.col("key").alias("b"), F.col("brief").alias("to"))
        spokes = spokes.join(self.briefs.select(F.col("key").alias("a"), "brief"), "a").join(to, "b")
        self.add(spokes.mapInPandas(lean(close), PAIR), "stars")
        roots = components(self.found)
        rooted = self.briefs.select("key", "brief").join(roots, "key", "left").select("key", "brief", F.coalesce("root", "key").alias("root"))
        self.rooted = materialize(rooted, "rooted")
        own = materialize(large.select("node", "key").join(self.rooted.select("key", "root"), "key"), "large-nodes")
        kinds = own.groupBy("node", "root").agg(F.count("*").alias("n"))
        most = F.max(F.struct("n", "root"))
        mixed = kinds.groupBy("node").agg(most.alias("most"), F.sum("n").alias("n"), F.count("*").alias("kinds")).where("kinds > 1")
        return own.join(mixed.select("node", F.col("most.root").alias("head"), F.col("most.n").alias("n_in"), (F.col("n") - F.col("most.n")).alias("n_out")), "node")

    def check(self, dealt: DataFrame, parts: int, name: str) -> None:
        """Links within nodes or pairs of blocks (node, i, j), as a forest for each; ``own`` is the block of a row (node, key, own, i, j)."""
        near, paired = self.near, self.paired

        def packed(frame: pd.DataFrame) -> pd.DataFrame:
            """Many small nodes in one call; those of two keys, most of them, all at once."""
            node, i, j, own, key = (frame[c].to_numpy() for c in ("node", "i", "j", "own", "key"))
            order = np.lexsort((j, i, node))
            node, i, j, own, key = node[order], i[order], j[order], own[order], key[order]
            root, sig = pd.factorize(frame["root"])[0][order], _briefs(frame["brief"].to_numpy()[order])
            start = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
            size = np.diff(np.r_[start, len(node)])
            two = start[(size == 2) & (own[start] + own[np.minimum(start + 1, len(own) - 1)] == i[start] + j[start])]
            two = two[root[two] != root[two + 1]]
            two = two[paired(sig[two], sig[two + 1])]
            a, b = [two + 1], [two]
            for at, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                part = slice(at, at + n)
                if (root[part] == root[at]).all():
                    continue
                left, right = np.flatnonzero(own[part] == i[at]), np.flatnonzero(own[part] == j[at])
                x, y = np.nonzero(near(sig[at + left], sig[at + right]))
                least = forest(n, left[x], right[y])
                moved = np.flatnonzero((least != np.arange(n)) & (root[part] != root[at + least]))
                a.append(at + moved)
                b.append(at + least[moved])
            return pd.DataFrame({"a": key[np.concatenate(a)], "b": key[np.concatenate(b)]})

        joined = dealt.join(self.rooted, "key").withColumn("part", F.pmod(F.xxhash64("node", "i", "j"), F.lit(parts)))
        self.add(joined.groupBy("part").applyInPandas(packed, PAIR), name)

    def check_small(self, small: DataFrame) -> None:
        rows = small.select("node", "key", F.lit(0).alias("own"), F.lit(0).alias("i"), F.lit(0).alias("j"))
        self.check(rows, max(64, small.count() // 4096), "candidates")

    def check_large(self, mixed: DataFrame) -> None:
        """Keys outside the most frequent component of their node, in blocks with each other and with those inside."""
        sides = mixed.withColumns({"out": F.col("root") != F.col("head"), "b_out": F.ceil(F.col("n_out") / self.small).cast("int"), "b_in": F.ceil(F.col("n_in") / self.small).cast("int")})
        own = F.when(F.col("out"), F.pmod(F.xxhash64("key"), "b_out")).otherwise(F.col("b_out") + F.pmod(F.xxhash64("key"), "b_in")).cast("int")
        # an outer key meets all blocks, an inner one the outer blocks
        others = F.sequence(F.lit(0), F.when(F.col("out"), F.col("b_out") + F.col("b_in")).otherwise(F.col("b_out")) - 1)
        dealt = sides.select("node", "key", own.alias("own"), F.explode(F.transform(others, lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))).alias("p"))
        dealt = materialize(dealt.select("node", "key", "own", "p.i", "p.j"), "blocks")
        self.check(dealt, max(64, dealt.count() // 4096), "large-candidates")
