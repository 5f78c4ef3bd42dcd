"""Closed runs, their scores and the greedy choice against plain versions."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from isotherm.operators import mining, run_search, triclusters
from isotherm.plans import insights
from isotherm.plans.insights import Config, cells, find_triclusters
from isotherm.sources.storage import numbered


def closed_by_hand(rows, needed, least=1):
    """Runs of every closed set of items: all intersections of windows, split at gaps of offsets."""
    sets = {frozenset(r) for r in rows.values()}
    while True:
        more = {a & b for a in sets for b in sets} - sets
        if not more:
            break
        sets |= more
    out = {}
    for s in sets:
        offsets = sorted({o for o, _ in s})
        for k in [x for x in offsets if x - 1 not in offsets]:
            end = k
            while end + 1 in offsets:
                end += 1
            run = frozenset(i for i in s if k <= i[0] <= end)
            held = frozenset(w for w, items in rows.items() if run <= items)
            if len(held) >= needed and end - k + 1 >= least:
                out[run] = held
    return out


def frame(spark, data):
    rows = [(c, w, o, int(t[1]), t) for c, own in data.items() for w, items in own.items() for o, t in items]
    return spark.createDataFrame(rows, "city string, window_id int, context_idx int, feature_idx int, token string")


def windows(rng, n, features, offsets, symbols):
    return {w: {(o, f"f{f}_{o}#{rng.integers(symbols)}") for f in range(features) for o in range(offsets) if rng.random() < 0.9} for w in range(n)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_open_subtrees_are_dealt_out_again(spark, monkeypatch, seed):
    """A task hands back what it hasn't extended after a few runs; nothing is lost or found twice."""
    monkeypatch.setattr(run_search, "BUDGET", 5)
    monkeypatch.setattr(run_search, "BATCH", 2)
    rng = np.random.default_rng(seed)
    data = {"a": windows(rng, 7, 3, 4, 2), "b": windows(rng, 5, 2, 5, 2), "c": windows(rng, 1, 2, 2, 2)}
    # the functions are sent by value, so that what is patched holds in tasks
    frequent = mining.supports(frame(spark, data), 2, "exact")
    found, own = run_search.runs(frequent, min_offsets=2)
    rows = run_search.decoded(found, own, []).collect()
    got = [(r["city"], frozenset(zip(r["context_idx"], r["token"])), frozenset(r["subject_ids"])) for r in rows]
    want = {(c, k, v) for c, d in data.items() for k, v in closed_by_hand(d, 2, 2).items()}
    assert len(got) == len(set(got)) and set(got) == want


def test_a_branch_is_searched_without_a_memory_of_what_was_seen():
    rng = np.random.default_rng(7)
    data = windows(rng, 9, 3, 4, 2)
    items = sorted({i for own in data.values() for i in own})
    marks = np.zeros((len(items), 64), dtype=bool)
    for w, own in data.items():
        for i in own:
            marks[items.index(i), w] = True
    row = type("Row", (), {"offsets": [o for o, _ in items], "features": [int(t[1]) for _, t in items], "needed": 2, "windows": 64, "bits": np.packbits(marks, axis=1).tobytes(), "numbers": b"", "codes": b""})
    board, found = run_search.Board(row), []
    for first in range(len(items)):
        if marks[first].sum() >= 2:
            seen, todo = run_search.met(board, first, first, board.bits[first], 10**9)
            assert not todo
            found += [frozenset(items[k] for k in np.flatnonzero(i)) for own in seen for i in own.inside]
    assert len(found) == len(set(found)) and set(found) == set(closed_by_hand(data, 2))


def series(spark, values, city="a"):
    rows = [(city, dt.date(2020, 1, 1) + dt.timedelta(days=i), v - 1, v + 1, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "city string, date date, tmin double, tmax double, tavg double")


def greedy(blocks, limit):
    """Ids that the choice one by one keeps; blocks are (id, rows, cols, contexts, hvar3)."""
    size = lambda b: len(b[1]) * len(b[2]) * len(b[3])
    kept = []
    for b in sorted(blocks, key=lambda b: (b[4], -size(b), b[0])):
        common = lambda k: math.prod(len(set(b[i]) & set(k[i])) for i in (1, 2, 3))  # noqa: B023, E731
        if all(common(k) / (size(b) + size(k) - common(k)) < limit for k in kept):
            kept.append(b)
    return {b[0] for b in kept}


def test_scores_of_the_search_are_those_of_the_plan(spark):
    """Runs found, scored and told apart in the search equal plain patterns scored by joins and chosen one by one."""
    values = [math.sin(i / 9) * 10 + (i * 7919 % 13) / 7 for i in range(200)]
    config = Config(window=3, stride=4, min_rows=12, overlap=None)
    rows = series(spark, values).unionByName(series(spark, [v * 0.5 + i % 5 for i, v in enumerate(values)], "b"))
    blocks, _, _ = find_triclusters(rows, config)
    got = {(r["city"], r["pattern_string"]): r for r in blocks.collect()}
    _, cube = cells(rows, config)
    symbols = insights.bins.discretised(cube, insights.bins.edges(cube, 3))
    found, _ = mining.patterns(mining.supports(mining.items(symbols), 12), 2)
    shaped = triclusters.from_patterns(found, 12, 2, 2)
    want = {(r["city"], r["pattern_string"]): r for r in triclusters.coherence(shaped, cube).where("hvar3 <= 0.4").collect()}
    assert set(got) == set(want) and len(want) > 200
    for k, r in want.items():
        assert got[k]["hvar3"] == pytest.approx(r["hvar3"], abs=1e-12)
        assert (got[k]["rows"], got[k]["cols"], got[k]["contexts"]) == (r["rows"], r["cols"], r["contexts"])
    kept = {(r["city"], r["pattern_string"]) for r in find_triclusters(rows, Config(window=3, stride=4, min_rows=12))[0].collect()}
    for city in "ab":
        own = [(k[1], r["rows"], r["cols"], r["contexts"], round(r["hvar3"], 12)) for k, r in got.items() if k[0] == city]
        # ties of score and size go by the run's bits; they are told apart here by what they cover
        chosen = {k[1] for k in kept if k[0] == city}
        assert greedy([b for b in own if b[0] in chosen], 0.7) == chosen
        left = [b for b in own if b[0] not in chosen]
        size = lambda b: len(b[1]) * len(b[2]) * len(b[3])
        for b in left:
            assert any((k[4], -size(k)) <= (b[4], -size(b)) and b[0] not in greedy([k, (b[0], *b[1:4], k[4] + 1)], 0.7) for k in own if k[0] in chosen)


def test_missing_cells_count_by_their_share(spark):
    """A block of 3 windows, 2 features and 2 offsets, 3 of its 12 cells missing."""
    gone = {(0, 0, 0), (1, 1, 0), (2, 0, 7)}
    cube = spark.createDataFrame([("a", w, c, f, 2.0 if f < 7 and (w, c, f) not in gone else None, "x" if f >= 7 and (w, c, f) not in gone else None) for w in range(3) for c in range(2) for f in (0, 7)], "city string, window_id int, context_idx int, feature_idx int, num double, sym string")
    block = spark.createDataFrame([("a", 0, [0, 1, 2], [0, 7], [0, 1])], "city string, id int, rows array<int>, cols array<int>, contexts array<int>")
    assert triclusters.coherence(block, cube).first()["hvar3"] == pytest.approx(3 / 12)


@pytest.mark.parametrize(("chunk", "held"), [(20_000, 20_000), (7, 5), (1, 3)])
def test_the_choice_in_rounds_is_that_one_by_one(spark, monkeypatch, chunk, held):
    monkeypatch.setattr(triclusters, "CHUNK", chunk)
    monkeypatch.setattr(triclusters, "HELD", held)
    rng = np.random.default_rng(3)
    n = 60 if chunk > 1 else 12
    pick = lambda k, m: sorted(rng.choice(m, rng.integers(k, m + 1), replace=False).tolist())
    base = [(pick(6, 70), pick(2, 5), pick(2, 17)) for _ in range(8)]
    blocks = []
    for i in range(n):
        rows, cols, contexts = base[i % 8]
        blocks.append(("ab"[i % 2], i, sorted({*rows[i % 3 :], int(rng.integers(70))}), cols, contexts, round(float(rng.integers(4)) / 10, 1)))
    made = triclusters.described(spark.createDataFrame(blocks, "city string, id int, rows array<int>, cols array<int>, contexts array<int>, hvar3 double"))
    for limit in (0.7, 0.95):
        got = {(r["city"], r["id"]) for r in triclusters.overlap_filtered(made, limit).collect()}
        want = {(c, i) for c in "ab" for i in greedy([b[1:] for b in blocks if b[0] == c], limit)}
        assert got == want
    assert triclusters.overlap_filtered(made.where("false"), 0.7).count() == 0


def test_places_in_sorted_ranges(spark):
    rng = np.random.default_rng(5)
    rows = [("abc"[min(2, int(rng.integers(12)))], float(v), i) for i, v in enumerate(rng.integers(0, 90, 700))]
    got = numbered(spark.createDataFrame(rows, "k string, v double, i int").repartition(5), ["k"], ["v", "i"], "n").collect()
    want = {i: n for k in "abc" for n, (_, _, i) in enumerate(sorted(r for r in rows if r[0] == k))}
    assert {r["i"]: r["n"] for r in got} == want
    assert numbered(spark.createDataFrame([], "k string, v double"), ["k"], ["v"], "n").columns == ["k", "v", "n"]


def test_a_share_of_a_citys_windows(spark):
    data = {"a": {w: {(0, "f0_0#x")} if w < 3 else {(0, "f1_0#y")} for w in range(20)}, "b": {0: {(0, "f0_0#x")}, 1: {(0, "f0_0#x")}}}
    got = mining.supports(frame(spark, data), 2, "exact", min_share=0.2)
    assert {(r["city"], r["token"], r["needed"]) for r in got.collect()} == {("a", "f1_0#y", 4), ("b", "f0_0#x", 2)}
    assert mining.supports(frame(spark, data), 2, "exact").where(F.col("city") == "a").count() == 2
