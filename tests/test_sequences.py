"""Sequential patterns against plain enumeration."""

import itertools
import random

import numpy as np
import pytest

from isotherm.operators import mining, sequences


def contains(seq, pattern):
    at = 0
    for part in pattern:
        while at < len(seq) and not set(part) <= set(seq[at]):
            at += 1
        if at == len(seq):
            return False
        at += 1
    return True


def enumerated(data, needed):
    """{(city, pattern): sequences} of all frequent patterns: every pattern is tried that grows from a frequent one."""
    out = {}
    for city, own in data.items():
        items = sorted({i for s in own.values() for part in s for i in part})
        todo = [((i,),) for i in items]
        while todo:
            p = todo.pop()
            held = tuple(sorted(k for k, s in own.items() if contains(s, p)))
            if len(held) >= needed:
                out[city, p] = held
                todo += [(*p, (i,)) for i in items] + [(*p[:-1], (*p[-1], i)) for i in items if i > p[-1][-1]]
    return out


def closed(found):
    larger = lambda p, q: sum(map(len, q)) > sum(map(len, p)) and contains(q, p)
    return {k: v for k, v in found.items() if not any(c == k[0] and v == w and larger(k[1], q) for (c, q), w in found.items())}


def frame(spark, data):
    return spark.createDataFrame([(c, k, s) for c, own in data.items() for k, s in own.items()], "city string, seq long, itemsets array<array<string>>")


def told(df):
    rows = df.collect()
    out = {(r["city"], tuple(map(tuple, r["itemsets"]))): tuple(r["subject_ids"]) for r in rows}
    assert len(out) == len(rows) and all(r["support"] == len(r["subject_ids"]) for r in rows)
    return out


def random_data(seed, n, length, items):
    rng = random.Random(seed)
    some = lambda: [[i for i in items if rng.random() < 0.6] for _ in range(rng.randint(1, length))]
    return {"x": {k: some() for k in range(n)}, "y": {k: some() for k in range(100, 100 + n // 2)}}


@pytest.mark.parametrize(("seed", "needed"), [(1, 4), (2, 3)])
def test_miners_equal_enumeration(spark, monkeypatch, seed, needed):
    monkeypatch.setattr(sequences, "BLOCK", 5)  # so that counts are summed over blocks
    monkeypatch.setattr(sequences, "HELD", 7)
    data = random_data(seed, 12, 4, "abc")
    data["x"][0] = [["b", "a", "a"], ["a"], ["a"]]
    rows, want = frame(spark, data), enumerated({c: {k: [sorted(set(p)) for p in s] for k, s in own.items()} for c, own in data.items()}, needed)
    assert max(sum(map(len, p)) for _, p in want) >= 4
    assert told(sequences.prefixspan(rows, needed)) == want
    assert told(sequences.spam(rows, needed)) == want
    assert told(sequences.clospan(rows, needed)) == closed(want)


def test_patterns_of_windows_are_their_frequent_sets(spark):
    """Where each item can be at one place only, patterns are sets of items."""
    rng = np.random.default_rng(3)
    data = [("a", w, o, f, f"f{f}_{o}#{rng.integers(2)}") for w in range(8) for f in range(2) for o in range(3)]
    tokens = spark.createDataFrame(data, "city string, window_id int, context_idx int, feature_idx int, token string")
    lines = mining.sequences(tokens).withColumnRenamed("window_id", "seq")
    own = {w: {t for _, x, _, _, t in data if x == w} for w in range(8)}
    every = {frozenset(c): s for n in range(1, 7) for c in itertools.combinations(sorted({t for *_, t in data}), n) if len(s := [w for w in own if set(c) <= own[w]]) >= 3}
    for miner in ("prefixspan", "spam"):
        got = sequences.patterns(lines, 3, miner).collect()
        assert {frozenset(t for s in r["itemsets"] for t in s): r["subject_ids"] for r in got} == every
        assert sorted(r["pattern_id"] for r in got) == list(range(len(every)))
    whole, _ = mining.patterns(mining.supports(tokens, 3, "exact"), 1, contiguous=False)
    assert {r["pattern_string"] for r in sequences.patterns(lines, 3, "clospan").collect()} == {r["pattern_string"] for r in whole.collect()}


def test_copies_of_sequences_are_mined_once(spark, monkeypatch):
    """Neither rows nor bits are written for each copy, and supports count all copies."""
    rows, kinds, keep = [], set(), sequences.stored

    def counted(df, name="step"):
        out = keep(df, name)
        rows.append(out.count())
        kinds.update(k for _, k in df.dtypes)
        return out

    monkeypatch.setattr(sequences, "stored", counted)
    own = [[["a", "b"], ["c"]], [["a"], ["c"]], [["b"], [], ["c", None]]]
    for miner in (sequences.prefixspan, sequences.spam):
        told = {}
        for copies in (1, 9):
            rows.clear()
            found = miner(frame(spark, {"x": {len(own) * k + i: s for k in range(copies) for i, s in enumerate(own)}}), 1, 0.6, subjects=False).collect()
            told[copies] = sum(rows), {tuple(map(tuple, r["itemsets"])): r["support"] for r in found}
        assert told[1][0] == told[9][0]
        assert told[1][1] == {(("a",),): 2, (("b",),): 2, (("c",),): 3, (("a",), ("c",)): 2, (("b",), ("c",)): 2}
        assert told[9][1] == {p: 9 * n for p, n in told[1][1].items()}
    assert "binary" not in kinds


def test_bits_after_the_first():
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2**63, (200, 3), dtype=np.uint64) & rng.integers(0, 2**63, (200, 3), dtype=np.uint64) & rng.integers(0, 2**63, (200, 3), dtype=np.uint64)
    bits[rng.random((200, 3)) < 0.5] = 0
    flat = lambda b: ((b[:, :, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).reshape(len(b), -1).astype(bool)
    own, got = flat(bits), flat(sequences.after_first(bits))
    for a, b in zip(own, got, strict=True):
        first = a.argmax() if a.any() else len(a)
        assert (b == (np.arange(len(a)) > first)).all()


def test_no_sequences(spark):
    rows = frame(spark, {"x": {1: []}})
    for mine in sequences.MINERS.values():
        assert mine(rows, 1).count() == 0
    with pytest.raises(ValueError):
        sequences.patterns(rows, 1, "other")
