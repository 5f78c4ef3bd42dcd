"""Exact top-k inner products by a three-phase uniform threshold.

A vector's components are split into ``LISTS`` runs; the score of a vector for a query is the sum of its partial scores
over the runs, and each task's vectors make one score list for each query and run. Phase 1 gathers the k best entries of
every list, scores these exactly and takes each query's k-th best score as its cutoff: k vectors reach it, so it is
safe. Phase 2 sends the cutoffs out; whatever reaches a cutoff in total has a partial score of at least cutoff / LISTS
in some run, so each task returns the entries that do so. Phase 3 bounds each from above, the parts not returned lying
under cutoff / LISTS; what can still reach the cutoff has its remaining scores resolved, and the k best stay.

Queries go out in blocks of at most ``SENT`` bytes, so that what is broadcast is bounded; each block runs against all rows,
its answers are written, and its broadcasts are freed before the next, so that neither the plan nor what is held grows with
the queries. Tasks work on ``QUERIES`` queries and ``ROWS`` vectors at a time. Scores are integers: float products where
these are exact, else integer ones.

Defined cases: null or empty vectors and those with null or non-finite components take no part; vectors of unlike length
aren't compared; each row that the condition holds for is a query, and only that row is none of its candidates, so that
repeated rows are queries each and candidates of one another; null ids take no part; with fewer candidates than k all are
returned; components so large that a score would leave 64 bits are held at its ends; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import noted
from .common import lean, materialize, shared_dir

#: Runs of components; bytes of a block of queries; queries and vectors multiplied at once.
LISTS, SENT = 4, 8 << 20
QUERIES, ROWS = 512, 2048
_END = 2**63 - 1
RESULT = "query_id long, rank int, vec_id long, score long"


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows of q and x (whole numbers as float64), exactly."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if top < 2**53:
        return (q @ x.T).astype(np.int64)
    if top < 2**63:
        return q.astype(np.int64) @ x.astype(np.int64).T
    exact = np.array([[sum(int(a) * int(b) for a, b in zip(r, s, strict=True)) for s in x] for r in q], dtype=object).reshape(len(q), len(x))
    return np.clip(exact, -_END, _END).astype(np.int64)


def _runs(size: int) -> list[slice]:
    edges = np.linspace(0, size, min(LISTS, size) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _tiles(batches: Iterator[pd.DataFrame], queries: dict) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Vectors and queries of one length, a few at a time: (length, place of the queries, their rows, they, the vectors' ids, rows, they)."""
    for batch in batches:
        sizes = batch["x"].map(len).to_numpy()
        for size, (qrows, q) in queries.items():
            part = np.flatnonzero(sizes == size)
            for at in range(0, len(part), ROWS):
                own = part[at : at + ROWS]
                v = np.stack(batch["x"].to_numpy()[own])
                for k in range(0, len(q), QUERIES):
                    place = slice(k, min(k + QUERIES, len(q)))
                    yield size, place, qrows[place], q[place], batch["vec_id"].to_numpy()[own], batch["row"].to_numpy()[own], v


def top_k(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score: each query's k best rows of ``vectors`` (vec_id, embedding); ``is_query`` is a condition on vec_id."""
    spark = vectors.sparkSession
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = F.transform(x, lambda v: F.greatest(F.least(v, F.lit(1e300)), F.lit(-1e300)) * 256)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("x")).where(F.coalesce(F.col("vec_id").isNotNull() & (F.size(x) > 0) & ~bad, F.lit(False)))
    # floor() in SQL gives a decimal or a long that large components don't fit
    rows = rows.mapInPandas(lambda batches: (b.assign(x=[np.floor(v) for v in b["x"]]) for b in batches), "vec_id long, x array<double>")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")  # written once, so that a row keeps its number
    asked = materialize(rows.where(is_query), "queries")
    n, size = asked.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(1))).first()
    block = max(1, SENT // (8 * size + 8))
    parts = max(1, -(-n // max(1, block // 2)))  # by hash: half a block each on average
    path = f"{shared_dir(spark)}/answers-{uuid.uuid4().hex}"
    noted("", path)
    spark.createDataFrame([], RESULT).write.parquet(path)
    for part in range(parts):
        own = asked.where(F.pmod(F.xxhash64("row", F.lit(5)), F.lit(parts)) == part).orderBy("vec_id", "row").collect()
        for at in range(0, len(own), block):
            _answer(rows, own[at : at + block], k, path)
    return spark.read.schema(RESULT).parquet(path)


def _answer(rows: DataFrame, block: list, k: int, path: str) -> None:
    """Appends the answers of a block of queries to ``path``."""
    context = rows.sparkSession.sparkContext
    queries: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size in {len(r["x"]) for r in block}:
        own = [r for r in block if len(r["x"]) == size]
        queries[size] = (np.array([r["row"] for r in own], dtype=np.int64), np.array([r["x"] for r in own], dtype=np.float64))
    sent = context.broadcast(queries)

    def lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Phase 1: the k best of each list of the task, scored in full."""
        held = {size: np.full((3, min(LISTS, size), len(q), k), -_END) for size, (_, q) in sent.value.items()}  # partial and whole score, row
        for size, place, qrows, q, _, vrows, v in _tiles(batches, sent.value):
            own = qrows[:, None] == vrows[None, :]
            total = _products(q, v)
            for at, r in enumerate(_runs(size)):
                p = np.where(own, -_END, _products(q[:, r], v[:, r]) if size > 1 else total)
                best = np.argpartition(-p, min(k, p.shape[1]) - 1, axis=1)[:, :k]
                new = np.stack([np.take_along_axis(p, best, 1), np.take_along_axis(total, best, 1), np.broadcast_to(vrows, p.shape)[np.arange(len(q))[:, None], best]])
                both = np.concatenate([held[size][:, at, place], new], axis=2)
                first = np.argpartition(-both[0], k - 1, axis=1)[:, :k]
                held[size][:, at, place] = np.take_along_axis(both, first[None], 2)
        for size, (qrows, _) in sent.value.items():
            partial, total, vrow = (c.transpose(1, 0, 2).reshape(len(qrows), -1) for c in held[size])
            qi, at = np.nonzero(partial > -_END)
            some = pd.DataFrame({"query": qrows[qi], "row": vrow[qi, at], "score": total[qi, at]})
            yield some.drop_duplicates(["query", "row"])[["query", "score"]]

    gathered = rows.mapInPandas(lean(lists), "query long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
    cutoffs = {r["query"]: r["score"] for r in gathered.withColumn("rank", rank).where(F.col("rank") == k).collect()}  # one for each query of the block
    limits = context.broadcast(cutoffs)
    names = context.broadcast({r["row"]: r["vec_id"] for r in block})

    def sufficient(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Phases 2 and 3: entries with a partial score of cutoff / LISTS, bounded, then resolved."""
        for size, _, qrows, q, ids, vrows, v in _tiles(batches, sent.value):
            cut = np.array([limits.value.get(i, -_END) for i in qrows.tolist()], dtype=np.float64)[:, None]
            share = cut / len(_runs(size))
            known, missing, any_ = 0.0, 0, False
            for r in _runs(size):
                p = _products(q[:, r], v[:, r])
                got = p >= share
                known = known + np.where(got, p, 0)
                missing = missing + ~got
                any_ = any_ | got
            may = any_ & (known + missing * share >= cut - 1) & (qrows[:, None] != vrows[None, :])
            qi, vi = np.nonzero(may)
            score = np.empty(len(qi), dtype=np.int64)
            for a in range(0, len(qi), 65_536):
                b = slice(a, a + 65_536)
                score[b] = _paired(q[qi[b]], v[vi[b]])
            keep = score >= cut[qi, 0]
            yield pd.DataFrame({"query": qrows[qi[keep]], "query_id": [names.value[i] for i in qrows[qi[keep]].tolist()], "vec_id": ids[vi[keep]], "score": score[keep]}).astype({"query_id": "int64"})

    found = rows.mapInPandas(lean(sufficient), "query long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
    for shared in (sent, limits, names):
        shared.destroy()


def _paired(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of the rows of q with those of x at the same place, exactly."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if top < 2**53:
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    if top < 2**63:
        return np.einsum("ij,ij->i", q.astype(np.int64), x.astype(np.int64))
    return np.array([_products(a[None], b[None])[0, 0] for a, b in zip(q, x, strict=True)], dtype=np.int64)
