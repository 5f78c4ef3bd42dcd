"""Search for closed runs: frequent sets of items at successive offsets, each with all windows that hold it.

A run is closed if no other item of its offsets, or of the two offsets next to them, is common to its windows. Items are in order of
offset and token. Every run has one parent, the closure of its items before the one that first makes it up (its core), so that the
runs form a tree, and a search that extends runs by items after their core alone, and drops an extension that brings in an earlier
item, meets each run once and needs no memory of what it has seen. Branches are bound: an extension that is too rare, reaches to the
offset before the run, or brings in an item before the branch's core can't become a run anywhere below, and isn't tried there again.

Work is rows: a task goes through the subtrees of its rows until it has met ``BUDGET`` runs; what is open then comes back as rows and
is dealt out anew, so that one large subtree spreads over all tasks. What a city's runs are made of is one row, its board (a bit for
each item and window, and the cells for scores); it is sent once to each part of the city's work.

Where cells are given, coherence is worked out in the search from sums over a run's windows, and runs over the limit aren't emitted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import NUMERIC, SYMBOLIC
from ..sources.storage import stored

#: Runs that a task meets before it hands back what is open, runs that are extended at once, and that are scored at once.
BUDGET, BATCH, SCORED = 30_000, 64, 1024


class Board:
    """A city's items and windows as arrays; ``score`` gives hvar3 of runs where cells are known."""

    def __init__(self, row):
        self.offsets, self.features, self.needed = np.asarray(row.offsets), np.asarray(row.features), int(row.needed)
        self.windows = int(row.windows)
        self.bits = np.frombuffer(row.bits, np.uint64).reshape(len(self.offsets), -1)
        self.others = ~self.bits
        self.begins = np.flatnonzero(np.r_[True, self.offsets[1:] != self.offsets[:-1]])
        self.held_by = np.arange(len(self.offsets))
        self.cells = len(row.numbers) > 0
        self.by_feature = (self.features[:, None] == np.arange(max(len(NUMERIC) + len(SYMBOLIC), self.features.max() + 1))).astype(np.float32)
        self.by_offset = (self.offsets[:, None] == np.arange(self.offsets[-1] + 1)).astype(np.float32)
        if self.cells:
            self._cells(np.frombuffer(row.numbers, np.float64).reshape(self.windows, -1), np.frombuffer(row.codes, np.int16).reshape(self.windows, -1))

    def _cells(self, numbers: np.ndarray, codes: np.ndarray) -> None:
        known = ~np.isnan(numbers)
        self.middle = np.where(known, numbers, 0).sum(axis=0) / np.maximum(known.sum(axis=0), 1)
        x = np.where(known, numbers - self.middle, 0.0)
        place, symbol = np.meshgrid(np.arange(codes.shape[1]), np.arange(codes.max(initial=-1) + 1), indexing="ij")
        marks = codes[:, place.ravel()] == symbol.ravel()
        used = marks.any(axis=0)
        self.numbers, self.squares = x, x * x
        self.marks, places = marks[:, used].astype(np.float64), place.ravel()[used]
        self.mark_from = np.flatnonzero(np.diff(places, prepend=-1))
        self.marked = places[self.mark_from]
        self.known = None if known.all() else known.astype(np.float64)
        gone = np.hstack([~known, codes < 0])
        self.gone = gone.astype(np.float64) if gone.any() else None
        self.shape = (numbers.shape[1] // len(NUMERIC), len(NUMERIC), len(SYMBOLIC))

    def closed(self, windows: np.ndarray, lo: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For sets of windows: items in common from offset ``lo`` on without a break, the last such offset, whether offset lo - 1 has some."""
        outside = windows[:, :1] & self.others[:, 0]
        for word in range(1, windows.shape[1]):
            outside |= windows[:, word, None] & self.others[:, word]
        held = outside == 0
        present = np.zeros((len(windows), int(self.offsets[-1]) + 2), dtype=bool)
        present[:, self.offsets[self.begins]] = np.logical_or.reduceat(held, self.begins, axis=1)
        last = lo + present[:, lo:].argmin(axis=1) - 1
        held &= (self.offsets >= lo) & (self.offsets <= last[:, None])
        return held, last, present[:, lo - 1] if lo else np.zeros(len(windows), dtype=bool)

    def shapes(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which features and which offsets runs have, as rows of booleans."""
        own = inside.astype(np.float32)
        return own @ self.by_feature > 0, own @ self.by_offset > 0

    def score(self, windows: np.ndarray, cols: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """hvar3 of each run: variation, impurity, each by its part's cells, and the share of missing cells."""
        rows = np.unpackbits(windows.view(np.uint8), axis=1)[:, : self.windows].astype(np.float64)
        n, (k, jn, js) = rows.sum(axis=1, keepdims=True), self.shape
        contexts = np.pad(contexts, ((0, 0), (0, k - contexts.shape[1])))
        count = n if self.known is None else rows @ self.known
        with np.errstate(divide="ignore", invalid="ignore"):
            part = rows @ self.numbers / count
            mean = part + self.middle
            spread = np.sqrt(np.maximum(rows @ self.squares / count - part * part, 0))
            varied = np.where((np.abs(mean) < 1e-12) | (count == 0), 0, spread / np.abs(mean)).reshape(-1, k, jn)
            each = rows @ self.marks
            total, squares = np.zeros((2, len(rows), k * js))
            if len(self.marked):
                total[:, self.marked] = np.add.reduceat(each, self.mark_from, axis=1)
                squares[:, self.marked] = np.add.reduceat(each * each, self.mark_from, axis=1)
            impure = np.where(total > 0, 1 - squares / (total * total), 0).reshape(-1, k, js)
        ks, numeric, symbolic = contexts.sum(axis=1), cols[:, :jn].sum(axis=1), cols[:, jn:].sum(axis=1)
        area = n[:, 0] * ks
        mean_of = lambda v, own, m: np.where(m > 0, np.einsum("rkj,rk,rj->r", v, contexts * 1.0, own * 1.0) / np.maximum(ks * m, 1) / np.maximum(area * m, 1), 0)
        out = mean_of(varied, cols[:, :jn], numeric) + mean_of(impure, cols[:, jn:], symbolic)
        if self.gone is not None:
            missing = rows @ self.gone
            both = np.einsum("rkj,rk,rj->r", missing[:, : k * jn].reshape(-1, k, jn), contexts * 1.0, cols[:, :jn] * 1.0) + np.einsum("rkj,rk,rj->r", missing[:, k * jn :].reshape(-1, k, js), contexts * 1.0, cols[:, jn:] * 1.0)
            out += both / (area * cols.sum(axis=1))
        return out


@dataclass
class Open:
    """Runs of one first item that are still to be extended, and which items may extend each."""

    windows: np.ndarray
    inside: np.ndarray
    last: np.ndarray
    core: np.ndarray
    alive: np.ndarray

    def parts(self) -> list[Open]:
        cut = range(0, len(self.core), BATCH)
        return [Open(*(v[a : a + BATCH] for v in (self.windows, self.inside, self.last, self.core, self.alive))) for a in cut]


def begun(board: Board, first: int, core: int, windows: np.ndarray) -> Open | None:
    """The run of ``windows`` that begins with item ``first``, or None if it isn't one of that item."""
    inside, last, left = board.closed(windows[None], int(board.offsets[first]))
    if left[0] or inside[0, :first].any():
        return None
    return Open(windows[None], inside, last, np.array([core]), np.ones_like(inside))


def extended(board: Board, own: Open, lo: int) -> Open | None:
    """The children of all runs of ``own``."""
    item = board.held_by
    g, e = np.nonzero(own.alive & ~own.inside & (item > own.core[:, None]) & (board.offsets <= own.last[:, None] + 1))
    if not len(g):
        return None
    # the earliest item that keeps an extension from being a run; -1 where nothing below can be one, len(item) where nothing does
    bar = np.where(own.alive, len(item), -1)
    both = own.windows[g] & board.bits[e]
    rare = np.bitwise_count(both) @ np.ones(both.shape[1], dtype=np.int64) < board.needed
    bar[g[rare], e[rare]] = -1
    g, e, both = g[~rare], e[~rare], both[~rare]
    if not len(g):
        return None
    inside, last, left = board.closed(both, lo)
    early = inside & ~own.inside[g] & (item < e[:, None])
    barred = early.any(axis=1)
    bar[g, e] = np.where(left, -1, np.where(barred, early.argmax(axis=1), len(item)))
    good = np.flatnonzero(~left & ~barred)
    if not len(good):
        return None
    g, e = g[good], e[good]
    return Open(both[good], inside[good], last[good], e, bar[g] >= e[:, None])


def met(board: Board, first: int, core: int, windows: np.ndarray, budget: int) -> tuple[list[Open], list[Open]]:
    """Runs of the subtree, as far as the budget goes, and those among them that haven't been extended yet."""
    start = begun(board, first, core, windows)
    todo, seen = [start] if start else [], []
    while todo and budget > 0:
        own = todo.pop()
        seen.append(own)
        budget -= len(own.core)
        if (more := extended(board, own, int(board.offsets[first]))) is not None:
            todo += more.parts()
    return seen, todo


def gathered(seen: list[Open]) -> Iterator[Open]:
    """The same runs, about SCORED at a time."""
    own: list[Open] = []
    for k, x in enumerate(seen):
        own.append(x)
        if k == len(seen) - 1 or sum(len(o.core) for o in own) >= SCORED:
            yield Open(*(np.concatenate([getattr(o, f.name) for o in own]) for f in fields(Open)))
            own = []


def boards(frequent: DataFrame, cube: DataFrame | None = None) -> DataFrame:
    """(city, needed, windows, tids, offsets, features, tokens, bits, numbers, codes): a row for each city.

    ``frequent`` as from ``mining.supports``. Of the cube a row for each window meets, not one for each cell.
    """
    kind = dict(frequent.dtypes)["tids"].removeprefix("array<").removesuffix(">")
    items = frequent.select("city", "token", F.col("context_idx").cast("int"), F.col("feature_idx").cast("int"), "tids", F.col("needed").cast("int"))
    schema = f"city string, needed int, windows int, tids array<{kind}>, offsets array<int>, features array<int>, tokens array<string>, bits binary, numbers binary, codes binary"

    def board(frame: pd.DataFrame, cells: pd.DataFrame | None) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame(columns=[c.split(" ")[0] for c in schema.split(", ")])
        frame = frame.sort_values(["context_idx", "token"])
        tids = np.unique(np.concatenate(frame["tids"].to_numpy()))
        marks = np.zeros((len(frame), -(-len(tids) // 64) * 64), dtype=bool)
        for k, own in enumerate(frame["tids"]):
            marks[k, np.searchsorted(tids, own)] = True
        row = {"city": frame["city"].iat[0], "needed": int(frame["needed"].iat[0]), "windows": len(tids), "tids": tids, "offsets": frame["context_idx"].to_numpy(), "features": frame["feature_idx"].to_numpy(), "tokens": frame["token"].to_numpy(), "bits": np.packbits(marks, axis=1).tobytes(), "numbers": b"", "codes": b""}
        if cells is not None:
            cells = cells.set_index("window_id").loc[tids]
            symbols = np.array([list(s) for s in cells["symbols"]], dtype=object)
            codes, _ = pd.factorize(symbols.ravel(), use_na_sentinel=True)
            row |= {"numbers": np.array([list(v) for v in cells["numbers"]], dtype=np.float64).tobytes(), "codes": codes.astype(np.int16).tobytes()}
        return pd.DataFrame([row])

    if cube is None:
        return items.groupBy("city").applyInPandas(lambda frame: board(frame, None), schema)
    jn = len(NUMERIC)
    # numbers and symbols by offset, then feature
    ordered = lambda keep, v: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("context_idx", "feature_idx", F.col(v).alias("v"))))), lambda s: s["v"])
    wide = cube.groupBy("city", "window_id").agg(ordered(F.col("feature_idx") < jn, "num").alias("numbers"), ordered(F.col("feature_idx") >= jn, "sym").alias("symbols"))
    return items.groupBy("city").cogroup(wide.groupBy("city")).applyInPandas(board, schema)


def runs(frequent: DataFrame, cube: DataFrame | None = None, min_features: int = 1, min_offsets: int = 1, coherence: float | None = None) -> tuple[DataFrame, DataFrame]:
    """All closed runs that are large and coherent enough, and the boards by which they are read.

    Runs are (city, held, windows, cols, contexts, volume, hvar3), the first four as bits of the board's items and windows, of
    features and of offsets; hvar3 is null without a cube. ``decoded`` makes lists of them.
    """
    own = stored(boards(frequent, cube), "boards")
    tasks = 8 * own.sparkSession.sparkContext.defaultParallelism
    told = "city string, open boolean, first int, core int, held binary, windows binary, cols binary, contexts binary, volume long, hvar3 double"
    names = [c.split(" ")[0] for c in told.split(", ")]

    def search(work: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if not len(work):
            return pd.DataFrame(columns=names)
        board, left = Board(next(given.itertuples())), BUDGET
        for row in work.itertuples():
            windows = np.frombuffer(row.windows, np.uint64) if row.windows is not None else board.bits[row.first]
            seen, todo = met(board, row.first, row.core, windows, left)
            left -= sum(len(x.core) for x in seen)
            for x in gathered(seen):
                cols, contexts = board.shapes(x.inside)
                keep = (cols.sum(axis=1) >= min_features) & (contexts.sum(axis=1) >= min_offsets)
                hvar3 = np.full(len(keep), np.nan)
                if board.cells and keep.any():
                    hvar3[keep] = board.score(x.windows[keep], cols[keep], contexts[keep])
                    if coherence is not None:
                        keep &= ~(hvar3 > coherence)
                if len(k := np.flatnonzero(keep)):
                    packed = {c: [v.tobytes() for v in np.packbits(flags[k], axis=1)] for c, flags in (("held", x.inside), ("cols", cols), ("contexts", contexts))}
                    volume = np.bitwise_count(x.windows[k]).sum(axis=1, dtype=np.int64) * cols[k].sum(axis=1) * contexts[k].sum(axis=1)
                    out.append(pd.DataFrame({"city": row.city, "open": False, "first": row.first, "core": x.core[k], "windows": [w.tobytes() for w in x.windows[k]], "volume": volume, "hvar3": hvar3[k], **packed}))
            for x in todo:
                out.append(pd.DataFrame({"city": row.city, "open": True, "first": row.first, "core": x.core, "windows": [w.tobytes() for w in x.windows], "volume": 0, "hvar3": np.nan, "held": None, "cols": None, "contexts": None}))
        return pd.concat(out)[names] if out else pd.DataFrame(columns=names)

    # open runs that haven't been extended are met again as the first of their subtree
    work = own.select("city", F.posexplode("tokens").alias("first", "token")).select("city", "first", F.col("first").alias("core"), F.lit(None).cast("binary").alias("windows"))
    found: DataFrame | None = None
    parts = max(1, tasks // max(1, own.count()))
    while True:
        dealt = work.withColumn("part", F.pmod(F.xxhash64("first", "core", "windows"), F.lit(parts)))
        places = own.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>")).alias("part"))
        step = stored(dealt.groupBy("city", "part").cogroup(places.groupBy("city", "part")).applyInPandas(search, told), "runs")
        done = step.where(~F.col("open")).select("city", "held", "windows", "cols", "contexts", "volume", F.nanvl("hvar3", F.lit(None).cast("double")).alias("hvar3"))
        found = done if found is None else found.unionByName(done)
        work = step.where("open").select("city", "first", "core", "windows")
        if work.isEmpty():
            return found, own


def decoded(found: DataFrame, own: DataFrame, keep: list[str]) -> DataFrame:
    """``found``'s columns ``keep`` with context_idx and token of its items, in order, and subject_ids."""
    kinds = dict(own.dtypes)

    def read(work: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        if not len(work):
            return pd.DataFrame(columns=["city", *keep, "context_idx", "token", "subject_ids"])
        row = next(given.itertuples())
        offsets, tokens, tids = np.asarray(row.offsets), np.asarray(row.tokens, dtype=object), np.asarray(row.tids)
        places = lambda packed: np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8)))
        items = [places(h) for h in work["held"]]
        return work[["city", *keep]].assign(context_idx=[offsets[i] for i in items], token=[tokens[i] for i in items], subject_ids=[tids[places(w)] for w in work["windows"]])

    tasks = 8 * own.sparkSession.sparkContext.defaultParallelism
    dealt = found.select("city", *keep, "held", "windows", F.pmod(F.xxhash64("held", "windows"), F.lit(tasks)).alias("part"))
    places = own.select("city", "offsets", "tokens", "tids", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)).cast("array<bigint>")).alias("part"))
    types = dict(found.dtypes)
    schema = ", ".join(["city string", *(f"`{c}` {types[c]}" for c in keep), "context_idx array<int>", "token array<string>", f"subject_ids {kinds['tids']}"])
    return dealt.groupBy("city", "part").cogroup(places.groupBy("city", "part")).applyInPandas(read, schema)
