"""Mixing sources to target weights by soft membership.

A labelled table (doc_id, domain) trains a naive Bayes classifier over hashed byte trigrams, whose posteriors are
tempered by the labelled rows' own log loss. Document rates r >= 0 are then fitted by distributed projected-gradient
least squares, in which no rate falls under the least that is asked for: the expected tokens of each domain, the sum over documents of rate x tokens x posterior, shall be its
target share of ``budget`` x all tokens. Rates start at 1; a step moves each document along its posterior times the
residual (one number for each domain), in the metric of its tokens, and cuts at the least rate. An iteration is one pass over a narrow table that brings a
residual to the driver; rates themselves are worked out from the residuals wherever they are needed and never collected.

The fit takes at most ``MAX_LABELLED`` labelled rows, chosen by a hash of their id (a documented bound); scoring, totals
and rates cover all rows and whole texts.

Defined cases: null or empty texts have 0 tokens and the domains' prior; without labels of the targets' domains, or
where these tell nothing, all posteriors are alike and all rates 1; a target that no document can reach leaves the nearest fit; null and repeated ids stay row by row, labels of
one id that contradict each other count as the first domain by name (copies are drawn by a hash of id and text); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import given_back, lean, materialize, pieces, texts

MAX_LABELLED, FEATURES, STEPS, TOLERANCE = 20_000, 4096, 480, 1e-4
TEMPERATURES = (0.0, 1.0, 3.0, 10.0, 30.0, 100.0, 300.0, 1000.0)
#: Bytes of text that are worked on at once.
_CHUNK = 1 << 20


def _chunks(values: pd.Series) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of texts of about _CHUNK bytes: (from, to, their bytes end to end, sizes)."""
    for a, b, raw in pieces(values, _CHUNK):
        yield a, b, np.frombuffer(b"".join(raw), np.uint8), np.array([len(t) for t in raw])


def _trigrams(text: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The feature of each byte trigram and the number of them in each document."""
    if len(text) < 3:
        return np.zeros(0, np.uint32), np.zeros(len(sizes), np.int64)
    t = text.astype(np.uint32)
    code = ((t[:-2] * 0x9E3779B1 + t[1:-1] * 0x85EBCA6B + t[2:] * 0xC2B2AE35) >> np.uint32(7)) % np.uint32(FEATURES)
    inside = np.ones(len(code) + 2, dtype=bool)
    ends = np.cumsum(sizes)
    for back in (1, 2):
        last = ends - back
        inside[last[(sizes >= back) & (last >= 0)]] = False
    return code[inside[:-2]], np.maximum(sizes - 2, 0)


def _tokens(text: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Runs of bytes other than ASCII white space, by document."""
    solid = (text > 32) | ((text < 9) | (text > 13)) & (text != 32)
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    starts = np.cumsum(sizes) - sizes
    full = sizes > 0
    begins[starts[full]] = solid[starts[full]]
    total = np.r_[0, np.cumsum(begins)]
    return total[starts + sizes] - total[starts]


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over runs of ``counts`` of them; runs may be empty."""
    out = np.zeros(len(counts))
    full = counts > 0
    if full.any():
        out[full] = np.add.reduceat(values, (np.cumsum(counts) - counts)[full], dtype=np.float64)
    return out


class Model:
    """Domains, log priors, log likelihoods of features by domain, and the temperature; FEATURES x domains numbers."""

    def __init__(self, domains: list[str], prior: np.ndarray, table: np.ndarray, temperature: float):
        self.domains, self.prior, self.table, self.temperature = domains, prior, table.astype(np.float32), temperature

    def means(self, text: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        code, n = _trigrams(text, sizes)
        # a domain at a time: one number for each trigram is held
        return np.stack([_sums(column[code], n) for column in self.table.T.copy()], axis=1) / np.maximum(n, 1)[:, None]

    def posteriors(self, means: np.ndarray, temperature: float | None = None) -> np.ndarray:
        z = self.prior + (self.temperature if temperature is None else temperature) * means
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit(docs: DataFrame, labelled: DataFrame, domains: list[str]) -> Model:
    """The classifier, from the rows of ``labelled`` (doc_id, domain) whose domain is one of ``domains``."""
    d = len(domains)
    rows = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), "domain").where(F.col("domain").isin(domains)).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    total = rows.count()
    if total > MAX_LABELLED:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(MAX_LABELLED / total * (1 << 20)))
    known = texts(docs).join(F.broadcast(rows), "doc_id").select("text", "domain")  # at most MAX_LABELLED short rows are broadcast
    place = {name: k for k, name in enumerate(domains)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, n = np.zeros((d, FEATURES)), np.zeros(d)
        for batch in batches:
            domain = batch["domain"].map(place).to_numpy()
            for a, b, text, sizes in _chunks(batch["text"]):
                code, m = _trigrams(text, sizes)
                sums += np.bincount(np.repeat(domain[a:b], m) * FEATURES + code.astype(np.int64), minlength=d * FEATURES).reshape(d, FEATURES)
            n += np.bincount(domain, minlength=d)
        yield pd.DataFrame({"domain": np.arange(d, dtype=np.int32), "n": n, "sums": list(sums)})

    each = known.mapInPandas(lean(count), "domain int, n double, sums array<double>")
    summed = each.select("domain", "n", F.posexplode("sums").alias("k", "v")).groupBy("domain", "k").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    sums, n = np.zeros((d, FEATURES)), np.zeros(d)
    for r in summed.collect():  # domains x FEATURES numbers
        sums[r["domain"], r["k"]], n[r["domain"]] = r["v"], r["n"]
    share = (sums + 1) / (sums + 1).sum(axis=1, keepdims=True)
    model = Model(domains, np.log((n + 1) / (n + 1).sum()), np.log(share).T, 0.0)
    if not n.sum():
        return model
    shared = docs.sparkSession.sparkContext.broadcast((domains, model.prior, model.table, 0.0))

    def losses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Model(*shared.value)
        loss = np.zeros(len(TEMPERATURES))
        for batch in batches:
            domain = batch["domain"].map(place).to_numpy()
            for a, b, text, sizes in _chunks(batch["text"]):
                means = own.means(text, sizes)
                loss -= [np.log(np.maximum(own.posteriors(means, t)[np.arange(b - a), domain[a:b]], 1e-12)).sum() for t in TEMPERATURES]
        yield pd.DataFrame({"k": np.arange(len(TEMPERATURES)), "loss": loss})

    found = {r["k"]: r["loss"] for r in known.mapInPandas(lean(losses), "k long, loss double").groupBy("k").agg(F.sum("loss").alias("loss")).collect()}
    model.temperature = TEMPERATURES[min(found, key=lambda k: (found[k], k))]
    return model


def _rates(p: np.ndarray, steps: list[np.ndarray], least: float) -> np.ndarray:
    """Rates after the projected steps, each a number for each domain, with Nesterov's momentum."""
    return _point(p, steps, least)[0]


def _point(p: np.ndarray, steps: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rates, the point ahead of them that the next gradient is taken at, and how far the last step went."""
    r = ahead = np.ones(len(p))
    moved = np.zeros(len(p))
    t = 1.0
    for step in steps:
        new, after = np.maximum(least, ahead - p @ step), (1 + math.sqrt(1 + 4 * t * t)) / 2
        moved = np.abs(new - ahead)
        ahead, r, t = new + (t - 1) / after * (new - r), new, after
    return r, ahead, moved


def solve(members: DataFrame, targets: np.ndarray, budget: float | None, least: float) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Steps of the fit over ``members`` (tokens, p), expected domain shares at rate 1, and those of the fitted rates less the targets.

    ``budget`` None: 1 or, where rates have a ``least``, fitted along with them, from the smallest at which no domain as a whole is thinned out.
    The fit ends when the shares are met, or the projected gradient is 0, within TOLERANCE, or after STEPS.
    """
    d = len(targets)

    def total(steps: list[np.ndarray]) -> list[np.ndarray]:
        """Expected tokens of the domains by the rates and at the point ahead, the last step's length, and the second moments of the posteriors."""

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tokens, beyond, length, moments = np.zeros(d), np.zeros(d), 0.0, np.zeros((d, d))
            for batch in batches:
                if len(batch):
                    p, w = np.stack(batch["p"].to_numpy()), batch["tokens"].to_numpy().astype(float)
                    rate, ahead, moved = _point(p, steps, least)
                    tokens, beyond, length = tokens + (w * rate) @ p, beyond + (w * ahead) @ p, length + w @ moved
                    moments += (p * w[:, None]).T @ p
            yield pd.DataFrame({"v": [np.r_[tokens, beyond, length, moments.ravel()]]})

        sums = members.select("tokens", "p").mapInPandas(lean(part), "v array<double>").select(F.posexplode("v").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v"))
        v = np.zeros(2 * d + 1 + d * d)
        for r in sums.collect():  # as many numbers as domains and pairs of them
            v[r["k"]] = r["v"]
        return np.split(v, [d, 2 * d, 2 * d + 1])

    at, ahead, _, moments = total([])
    everything = max(at.sum(), 1.0)
    share = at / everything
    free = budget is None and least > 0
    if budget is None:
        budget = float(np.max(np.where(targets > 0, share / np.where(targets > 0, targets, 1), 0))) if free else 1.0

    def wanted(tokens: np.ndarray) -> np.ndarray:
        """By domain: the targets' share of the budget, in which a free budget is the one nearest to ``tokens``."""
        size = max(budget, float(tokens @ targets) / everything / max(float(targets @ targets), 1e-12)) if free else budget
        return targets * max(size, 1e-9)

    def gap(tokens: np.ndarray) -> np.ndarray:
        return tokens / everything - wanted(tokens)

    size = 1 / max(np.linalg.eigvalsh(moments.reshape(d, d) / everything)[-1], 1e-9)  # the gradient's Lipschitz constant, inverted
    steps: list[np.ndarray] = []
    while len(steps) < STEPS and np.abs(gap(at)).max() > TOLERANCE:
        steps.append(size * gap(ahead))
        at, ahead, moved, _ = total(steps)
        if moved[0] / everything <= TOLERANCE / 10 * size:
            break
    return steps, share, at / max(at.sum(), 1e-12) - targets


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], budget: float | None = 1.0, keep_all: bool = False) -> tuple[DataFrame, DataFrame]:
    """Of ``docs``: (doc_id, n_tokens, posterior, rate, copies, residual) of every row; and its rows, each as often as its copies.

    ``targets`` are domain shares and are scaled to 1. With ``keep_all`` every rate is at least 1, and a budget of
    None is fitted, too. ``residual`` is the largest difference of the fitted shares from their targets; a warning tells how far the fitted shares are from targets that aren't met. Copies are the rate rounded up or down by a hash of the
    row, so that their expectation is the rate.
    """
    domains = sorted(targets)
    goal = np.array([max(targets[k], 0.0) for k in domains])
    goal = goal / max(goal.sum(), 1e-12)
    model = fit(docs, labelled, domains)
    shared = docs.sparkSession.sparkContext.broadcast((domains, model.prior, model.table, model.temperature))

    def memberships(values: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        own = Model(*shared.value)
        p, tokens = np.empty((len(values), len(domains))), np.empty(len(values), dtype=np.int64)
        for a, b, text, sizes in _chunks(values):
            p[a:b], tokens[a:b] = own.posteriors(own.means(text, sizes)), _tokens(text, sizes)
        return p, tokens

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            p, tokens = memberships(batch["text"])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "u": batch["u"], "tokens": tokens, "p": list(p)})

    drawn: Column = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    narrow = materialize(texts(docs).withColumn("u", drawn).mapInPandas(lean(members), "doc_id long, u double, tokens long, p array<double>"), "memberships")
    least = 1.0 if keep_all else 0.0
    # where posteriors don't hang on the text no rate brings shares nearer to the targets: all stay 1
    steps, _, off = solve(narrow, goal, budget, least) if model.temperature else ([], None, np.exp(model.prior) - goal)
    if np.abs(off).max(initial=0) > 10 * TOLERANCE:
        warnings.warn(f"shares less targets after {len(steps)} steps: {dict(zip(domains, off.round(4).tolist(), strict=True))}", stacklevel=2)

    def rated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                rate = _rates(np.stack(batch["p"].to_numpy()), steps, least)
                copies = np.floor(rate + batch["u"].to_numpy()).astype(np.int64)
                yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": batch["tokens"], "posterior": batch["p"], "rate": rate, "copies": copies})

    weights = narrow.mapInPandas(lean(rated), "doc_id long, n_tokens long, posterior array<double>, rate double, copies long")
    weights = weights.withColumn("residual", F.lit(float(np.abs(off).max(initial=0))))

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rates again from the texts, so that texts needn't be joined to them. Rows leave some MB at a time, however many copies they have."""
        for batch in batches:
            own = pd.Series([t or "" for t in batch.column("text").to_pylist()], dtype=object)
            sizes = own.map(len).to_numpy()
            p, _ = memberships(own)
            del own
            copies = np.floor(_rates(p, steps, least) + batch.column("__u").to_numpy()).astype(np.int64)
            rows = batch.select(columns)
            taken = np.repeat(np.arange(len(copies)), copies)
            held = np.cumsum(sizes[taken]) // (4 * _CHUNK)
            for part in np.unique(held):
                yield rows.take(pa.array(taken[held == part]))
        given_back()

    columns = docs.columns
    text = F.coalesce(F.col("text"), F.lit(""))
    u = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), text), F.lit(1 << 30)) / float(1 << 30)
    rows = docs.withColumn("__u", u).mapInArrow(repeated, docs.schema)
    return weights, rows
