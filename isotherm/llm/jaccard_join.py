"""N-gram Jaccard join by chosen paths (Christiani, Pagh, Sivertsen).

A document is the set of its runs of ``N`` words; equal sets are one row with a count. Sets are embedded as ``T`` minimum
hashes, so that a place agrees with a chance of the Jaccard similarity. A run of the join starts with one node for all
sets; each node draws a few places (one or two on average) and splits its sets by their values there, level by level. A
node of one set ends; one of at most ``SMALL`` sets is checked by brute force, and so are larger ones once at most as many
of their sets lie outside one component; others split on, and what is left at ``DEPTH`` is checked in pairs of blocks. Runs are repeated as often as it takes for a pair at the threshold to be
missed with a chance of at most ``MISS``. Draws, runs and the agreement asked for in a check follow from the threshold.

In a node, sets whose signatures agree in enough places are united (``nodes``): large nodes by a star around one of their
sets first, small ones by a forest, so that rows grow with the sets of a node and not with its pairs. Within each candidate
component sets are then compared exactly, all with all, in blocks of bounded bytes: the texts of candidates are fetched
once, and out of a block come a count and a forest for its sets. Classes are the components of the exact links.

Defined cases: null texts and texts without words have no set and link with nothing; texts of fewer than N words are one
run; equal sets link (a copy's links count each other copy); null ids count as documents, and a class without any id has
a null one; an empty table gives an empty result; whole texts are compared; further columns are ignored. The threshold is
at least ``LEAST``: below it signatures of ``T`` places don't tell near from far.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, lean, materialize, texts
from .components import components
from .nodes import Links, blocked, forest

N, T = 5, 96
SMALL, DEPTH, MISS, LEAST = 256, 4, 1e-3, 0.3
#: Levels that a document works out by itself before nodes are counted.
AT_ONCE = 2
#: Sets, and runs of words in them, in a block of an exact comparison.
BLOCK, BLOCK_RUNS = 512, 1 << 19
_SEED = 7_919
_LETTERS = {i: i + 32 for i in range(65, 91)}
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Texts to sorted arrays of distinct 64-bit run hashes; word hashes are cached, in bounded number."""

    def __init__(self) -> None:
        self.words = re.compile(WORD).findall
        self.known: dict[str, int] = {}

    def hashes(self, words: list[str]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) > 400_000:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def __call__(self, text: str) -> np.ndarray:
        h = self.hashes(self.words(text.translate(_LETTERS) if not text.islower() else text))
        if not len(h):
            return h
        n = min(N, len(h))
        out = np.full(len(h) - n + 1, n, dtype=np.uint64)
        for j in range(n):
            out = _mix(out ^ h[j : len(h) - n + 1 + j]) + np.uint64(0x9E3779B97F4A7C15)
        return np.unique(out)


def _signature(sets: list[np.ndarray]) -> np.ndarray:
    """T minimum hashes of 32 bits for each set."""
    rng = np.random.default_rng(_SEED)
    a, b = rng.integers(1, 2**32, T, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, T, dtype=np.uint32)
    out = np.empty((len(sets), T), dtype=np.uint32)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    joined = np.concatenate(sets)
    low, high = joined.astype(np.uint32), (joined >> np.uint64(32)).astype(np.uint32)
    h = np.empty_like(low)
    for t in range(T):
        np.multiply(low, a[t], out=h)
        h += b[t]
        h ^= high
        h *= a[T - 1 - t]
        out[:, t] = np.minimum.reduceat(h, starts)
    return out


def split_rate(threshold: float) -> float:
    """One over the places that a node draws on average: near sets stay together somewhere a little more often than not."""
    return 0.875 * threshold


def agreement(threshold: float) -> int:
    """Places that a pair at the threshold agrees in, but for a chance of about 1e-6."""
    return math.floor(T * (threshold - 4.9 * math.sqrt(threshold * (1 - threshold) / T)))


def runs_needed(depth: int, threshold: float = 0.8) -> int:
    """How many runs miss a pair that agrees in a sixteenth less of the places than the threshold with a chance of MISS."""
    q = 1.0
    for _ in range(depth):
        q = 1 - math.exp(-0.9375 * threshold / split_rate(threshold) * q)
    return math.ceil(math.log(MISS) / math.log1p(-q))


def _children(nodes: np.ndarray, owner: np.ndarray, sig: np.ndarray, split: float) -> tuple[np.ndarray, np.ndarray]:
    """One level of paths: each node's places are drawn by a hash of the node, the same for all its sets."""
    limit = np.uint64(int(2**64 / (split * T)))
    found, whose = [], []
    for t in range(T):
        drawn = np.flatnonzero(_mix(nodes + np.uint64((t * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) & (2**64 - 1))) < limit)
        if len(drawn):
            found.append(_mix(_mix(nodes[drawn] ^ np.uint64((t + 1) * 0x8CB92BA72F3D8DD7 & (2**64 - 1))) + sig[owner[drawn], t].astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))
            whose.append(owner[drawn])
    return (np.concatenate(found), np.concatenate(whose)) if found else (nodes[:0], owner[:0])


def _sets(docs: DataFrame) -> DataFrame:
    """(doc_id, h, key, runs, signature) of each row; key is a digest of the set, h a hash of the text."""

    def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler()
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                sets = [shingle(t) for t in part["text"]]
                some = [s for s in sets if len(s)]
                sig = iter(_signature(some)) if some else iter(())
                yield pd.DataFrame({"doc_id": part["doc_id"], "h": part["h"], "key": [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets], "runs": [len(s) for s in sets], "signature": [next(sig).tobytes() if len(s) else None for s in sets]})

    return texts(docs).withColumn("h", F.xxhash64("text")).mapInPandas(lean(embed), "doc_id long, h long, key binary, runs int, signature binary")


def _paths(once: DataFrame, runs: int, split: float) -> DataFrame:
    """(node, key) after AT_ONCE levels of every run."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.iloc[at : at + 2000]
                sig = np.frombuffer(b"".join(part["signature"]), np.uint32).reshape(-1, T)
                owner = np.tile(np.arange(len(part)), runs)
                nodes = _mix(np.repeat(np.arange(runs, dtype=np.uint64) + np.uint64(_SEED), len(part)))
                for _ in range(AT_ONCE):
                    nodes, owner = _children(nodes, owner, sig, split)
                yield pd.DataFrame({"node": nodes.view(np.int64), "key": part["key"].to_numpy()[owner]})

    return once.select("key", "signature").mapInPandas(lean(walk), "node long, key binary")


def _split(rows: DataFrame, split: float) -> DataFrame:
    """One more level of (node, key, signature)."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch["signature"]), np.uint32).reshape(-1, T)
            nodes, owner = _children(batch["node"].to_numpy().view(np.uint64), np.arange(len(batch)), sig, split)
            yield pd.DataFrame({"node": nodes.view(np.int64), "key": batch["key"].to_numpy()[owner]})

    return rows.select("node", "key", "signature").mapInPandas(lean(walk), "node long, key binary")


def _candidates(once: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that span sets whose signatures agree in enough places, found in nodes."""
    split, enough = split_rate(threshold), agreement(threshold)

    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.stack([np.count_nonzero(y == one, axis=1) >= enough for one in x]) if len(x) else np.zeros((0, len(y)), dtype=bool)

    def paired(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.count_nonzero(x == y, axis=1) >= enough

    links = Links(once.select("key", "brief"), near, paired, SMALL)
    entries = _paths(once, runs_needed(DEPTH, threshold), split)
    for depth in range(AT_ONCE, DEPTH + 1):
        entries = materialize(entries, "paths")
        counts = entries.groupBy("node").agg(F.count("*").alias("size"), F.min("key").alias("least")).where("size > 1")
        sized = materialize(entries.join(counts, "node"), "nodes")
        large = sized.where(F.col("size") > SMALL)
        some = not large.isEmpty()
        if some:
            large = materialize(links.stars(large), "mixed-nodes")
            # nodes with few sets outside their main component are checked at once, others split on
            done = large if depth == DEPTH else large.where(F.col("n_out") <= SMALL)
            if not done.isEmpty():
                links.check_large(done)
            large = large.where(F.col("n_out") > SMALL)
            some = depth < DEPTH and not large.isEmpty()
        links.check_small(sized.where(F.col("size") <= SMALL))
        if not some:
            break
        entries = _split(large.join(once.select("key", "signature"), "key"), split)
    return links.found


def _exact(docs: DataFrame, once: DataFrame, rooted: DataFrame, threshold: float) -> DataFrame:
    """(key, root, n): links of each set, counting copies, and a forest over them, from an exact comparison within components."""
    wanted = rooted.join(once.select("key", "h", F.col("first_id").alias("id"), "copies", "runs"), "key")
    sizes = wanted.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("runs") / BLOCK_RUNS)).cast("int").alias("blocks"))
    wanted = wanted.join(sizes, "root").drop("runs")
    own = texts(docs).withColumn("h", F.xxhash64("text"))
    # the first id's row with that text; should rows repeat, one of them
    fetched = own.join(wanted, (own["h"] == wanted["h"]) & own["doc_id"].eqNullSafe(wanted["id"])).select("key", "root", "blocks", "copies", "text")
    fetched = fetched.groupBy("key").agg(F.first("root").alias("root"), F.first("blocks").alias("blocks"), F.first("copies").alias("copies"), F.first("text").alias("text"))

    def shingled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler()
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                yield part.drop(columns="text").assign(runs=[shingle(t).tobytes() for t in part["text"]])

    sets = fetched.mapInPandas(lean(shingled), "key binary, root binary, blocks int, copies long, runs binary")
    dealt = blocked(sets, F.col("blocks")).drop("blocks")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        key, own, copies = frame["key"].to_numpy(), frame["own"].to_numpy(), frame["copies"].to_numpy()
        left, right = np.flatnonzero(own == frame["i"].iat[0]), np.flatnonzero(own == frame["j"].iat[0])
        size = frame["runs"].map(len).to_numpy() // 8
        inter = intersections([np.frombuffer(r, np.uint64) for r in frame["runs"]])[np.ix_(left, right)]
        near = inter >= threshold * (size[left][:, None] + size[right][None, :] - inter) - 1e-9
        if frame["i"].iat[0] == frame["j"].iat[0]:
            np.fill_diagonal(near, False)
        a, b = np.nonzero(near)
        a, b = left[a], right[b]
        n = np.bincount(a, weights=copies[b], minlength=len(frame))
        if frame["i"].iat[0] != frame["j"].iat[0]:
            n += np.bincount(b, weights=copies[a], minlength=len(frame))
        root = forest(len(frame), a, b)
        some = n > 0
        return pd.DataFrame({"key": key[some], "root": key[root[some]], "n": n[some].astype(np.int64)})

    return materialize(dealt.groupBy("root", "i", "j").applyInPandas(compare, "key binary, root binary, n long"), "near-links")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets; runs that the same sets hold are one column with a weight."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    run = np.concatenate(sets)
    order = np.argsort(run, kind="stable")
    run, owner = run[order], owner[order]
    start = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    held = np.diff(np.r_[start, len(run)])
    mark = np.random.default_rng(_SEED).integers(1, 2**63, (n, 2), dtype=np.uint64)
    who = np.add.reduceat(mark[owner], start, axis=0)
    several = np.flatnonzero(held > 1)
    out = np.zeros((n, n), dtype=np.float64)
    np.fill_diagonal(out, [len(s) for s in sets])
    if not len(several):
        return out
    _, first, times = np.unique(who[several].view([("a", np.uint64), ("b", np.uint64)]).ravel(), return_index=True, return_counts=True)
    columns = several[first]
    for at in range(0, len(columns), 4096):
        part = columns[at : at + 4096]
        m = np.zeros((n, len(part)), dtype=np.float32)
        rows = np.concatenate([owner[start[c] : start[c] + held[c]] for c in part])
        m[rows, np.repeat(np.arange(len(part)), held[part])] = 1
        out += (m * times[at : at + 4096].astype(np.float32)) @ m.T
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def jaccard_join(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, class_id (the smallest id of its class), n_links (documents linked directly) and kept of every row of ``docs``."""
    if not LEAST <= threshold <= 1:
        raise ValueError(f"the threshold has to lie in {LEAST} to 1")
    rows = materialize(_sets(docs), "sets")
    some = rows.where(F.col("key").isNotNull())
    firsts = some.groupBy("key").agg(F.min_by(F.struct("doc_id", "h"), F.coalesce("doc_id", F.lit(2**63 - 1))).alias("m"), F.count("*").alias("copies"), F.first("runs").alias("runs"), F.first("signature").alias("signature"))
    once = firsts.select("key", F.col("m.doc_id").alias("first_id"), F.col("m.h").alias("h"), "copies", "runs", "signature")

    def brief(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A byte for each place, to compare signatures by."""
        for batch in batches:
            yield batch.assign(brief=[np.frombuffer(s, np.uint32).astype(np.uint8).tobytes() for s in batch["signature"]])

    once = materialize(once.mapInPandas(lean(brief), "key binary, first_id long, h long, copies long, runs int, signature binary, brief binary"), "distinct-sets")
    rooted = components(_candidates(once, threshold))
    found = _exact(docs, once, rooted, threshold)
    counted = found.groupBy("key").agg(F.sum("n").alias("n"))
    counted = counted.join(components(found.select(F.col("key").alias("a"), F.col("root").alias("b"))), "key", "left")
    classes = once.select("key", "copies", "first_id").join(counted, "key", "left")
    classes = classes.select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "key").alias("root"), "first_id")
    least = classes.groupBy("root").agg(F.min("first_id").alias("class_id"))
    classes = classes.join(least, "root").select("key", "n_links", "class_id")
    out = rows.select("doc_id", "key").join(classes, "key", "left")
    class_id = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce(class_id == F.col("doc_id"), F.lit(False)).alias("kept"))
