"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and on unusual input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from isotherm.llm import automaton, embedding_dedup, jaccard_join, licenses, mixing, queries, sharding, suffix_dedup, token_counts, topk, toxicity
from isotherm.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, n_tokens long, `range` int, key string"
EMPTY = (None,) * 7
#: Null columns, empty and very long texts, ties, repeated rows and ids, and columns whose names clash with results.
ODD = [(1, None), (2, ""), (2, ""), (None, "the mit license"), (None, "the mit license"), (3, "a"), (3, "b b b b b b"), (4, "lorem ipsum dolor sit amet " * 8000), (5, "x" * 60_000), (-7, "ΑΣΣ İ ñ 日本語 😀 \u0000 end"), (6, "the mit license"), (7, " \n\t ")]


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, *EMPTY) for r in rows], DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) + rng.choice([".", "!?", " 12345", " don't", " <|endoftext|> x", ""]) for _ in range(150)] + ["", "aaaaaaaaaaaaaaaaaaaaaaaa", "é́ñ😀 日本"]


def test_token_counts_equal_the_library(spark, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(i, t) for i, t in enumerate(texts)] + ODD
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in token_counts.token_counts(docs_of(spark, rows), path).collect()), key=repr)
    library = Tokenizer.from_file(path)
    assert got == sorted(((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows), key=repr)


def test_automaton_equals_the_library_and_decodes(spark, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(i, t) for i, t in enumerate(texts)] + ODD
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, ids, library.decode(ids, skip_special_tokens=False)))
    got = automaton.bpe_encode(docs_of(spark, rows), path).collect()
    assert sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in got), key=repr) == sorted(want, key=repr)
    digests = automaton.bpe_digest(docs_of(spark, rows), path).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in digests), key=repr) == sorted(((i, len(ids), sha(" ".join(map(str, ids))), sha(d)) for i, ids, d in want), key=repr)


def test_licenses_by_hand(spark):
    text = "MIT License here. Licensed under the Apache License, Version 2.0; GNU General Public License v3"
    got = {r["doc_id"]: r for r in licenses.license_scan(docs_of(spark, [(10, text), *ODD])).collect()}
    r = got[10]
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (16, 3, 0, 12, "apache,gpl,mit")
    assert r["labels"] == "apache,gpl,mit" and r["score"] == 1.0
    assert (got[2]["n_words"], got[2]["labels"], got[2]["score"], got[2]["first_word"]) == (0, "", 0.0, None)
    assert got[6]["base_labels"] == "mit" and len(licenses.rules()) > 250


def test_contained_detections_are_suppressed(spark):
    got = licenses.license_scan(docs_of(spark, [(1, "gnu lesser general public license"), (2, "general public license")])).orderBy("doc_id").collect()
    assert [(r["base_labels"], r["labels"], r["n_kept"]) for r in got] == [("gpl", "gpl,lgpl", 1), ("gpl", "gpl", 1)]


def test_gate_words_lose_no_rule():
    gate = licenses.gate_words()
    for *_, rule, _ in licenses.rules(raw=True):
        assert any(g in w for g in gate for w in licenses.needed_words(rule)), rule


def test_every_rule_is_found(spark):
    """Each rule's shortest text, its words in capitals and apart by other signs than blanks."""
    known = licenses.rules(raw=True)
    plain = lambda unit: re.sub(r".\?", "", re.sub(r"\[(.)[^]]*\]", r"\1", re.sub(r"\(\?:([^|)]*)[^)]*\)", r"\1", unit)))
    samples = ["/*_".join(plain(u).upper() for u in rule.split() if u[0] not in "?*") for _, _, _, rule, _ in known]
    got = {r["doc_id"]: r for r in licenses.license_scan(docs_of(spark, [(k, f"-{t}.") for k, t in enumerate(samples)])).collect()}
    assert [(label, t) for k, label, t in ((k, known[k][1], t) for k, t in enumerate(samples)) if label not in got[k]["labels"].split(",")] == []
    assert got[len(samples) - 1]["n_words"] == len(samples[-1].split("/*_"))


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(2)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    bad = ["grumble", "snarlish", "mopwit"]
    rows, labels = [], []
    for i in range(800):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 80))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randint(2, 4)):
                w = rng.choice(bad)
                words.insert(rng.randrange(len(words)), rng.choice([w, w.upper(), w.replace("o", "0").replace("i", "1"), w.replace("a", "а")]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    got = toxicity.toxicity(docs_of(spark, rows + [(None, None), (900, "")]), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    known = dict(labels)
    held = [(r["predicted"], known[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in known]
    assert len(held) > 100 and sum(p == t for p, t in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got) and {r["score"] for r in got if r["doc_id"] in (None, 900)} == {0.0}
    none = toxicity.toxicity(docs_of(spark, rows[:5]), spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.count() == 5


def test_exception_phrases_and_folding():
    lexicon = toxicity.Lexicon({" trash ": 5.0, " stup": 4.0}, 0.1)
    a = lexicon.automaton()
    assert toxicity.density("the trash can", a) == 0 and toxicity.density("such TR4SH!", a) > 0
    assert toxicity.density("ѕtuрid", a) == pytest.approx(4.0) and toxicity.density("astute", a) == 0


@pytest.mark.parametrize("rows", [[(i, "w" * (i * 37 % 900)) for i in range(600)] + [(1000 + i, "same text") for i in range(300)], ODD, []])
def test_shards(spark, monkeypatch, rows):
    monkeypatch.setattr(sharding, "ROWS", 40)  # so that ranges are subdivided
    monkeypatch.setattr(sharding, "RANGES", 1)
    got = sharding.shard(docs_of(spark, rows), 16).collect()
    assert len(got) == len(rows)
    slots, sizes, groups = defaultdict(list), defaultdict(int), defaultdict(set)
    plain = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=repr) == plain
    assert {(r["law"], r["grown_shard"]) for r in got} <= {("bytes", None)}
    for r in got:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
        groups[r["text_crc32"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(0 <= k < 16 for k in slots)
    if len(rows) > 100:
        mean = sum(sizes.values()) / 16
        assert max(sizes.values()) - min(sizes.values()) <= 2 * 901 + 2 * sharding.TOLERANCE * mean
        assert max(len(g) for g in groups.values()) <= 2


HOT_ROWS = {"distinct ids": lambda k: k, "clustered ids": lambda k: 10**15 + k // 40, "one id": lambda _: 5, "null ids": lambda _: None}


@pytest.mark.parametrize("ids", HOT_ROWS)
def test_hot_texts_are_spread_over_ranges(spark, monkeypatch, ids):
    """A third of all rows has an empty text, some texts come by hundreds, and the rest are short ones."""
    monkeypatch.setattr(sharding, "ROWS", 200)
    rows = [(HOT_ROWS[ids](k), "" if k % 3 == 0 else f"text {k % 7}" if k % 5 == 0 else "x" * (k % 900) + str(k)) for k in range(6000)]
    keyed = sharding.keys(docs_of(spark, rows))
    counts = [r["count"] for r in sharding.ranged(keyed, sharding._splitters(keyed, 10**6, 20)).groupBy("range").count().collect()]
    assert sum(counts) == 6000 and max(counts) <= 400
    got = sharding.shard(docs_of(spark, rows), 16).collect()
    sizes, slots, empty = Counter(), defaultdict(list), defaultdict(int)
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        empty[r["shard"]] += r["size"] == 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(got) == 6000
    mean = sum(sizes.values()) / 16
    assert max(sizes.values()) - min(sizes.values()) <= 2 * 905 + 2 * sharding.TOLERANCE * mean
    assert sum(n > 0 for n in empty.values()) <= 2  # 2,000 bytes of all


def test_long_documents_in_pieces(monkeypatch):
    """Windows of each run, by document and place, are the same in pieces."""
    rng = np.random.default_rng(3)
    sizes = np.array([0, 20, 4000, 49, 50, 700, 5000])
    text = rng.integers(97, 100, sizes.sum()).astype(np.uint8)
    flat = lambda found: sorted((int(d), w, int(a)) for lo, hi, a, _, d in zip(*found, strict=True) for w in range(int(lo), int(hi) + 1))
    whole = flat(suffix_dedup.runs(text, sizes))
    monkeypatch.setattr(suffix_dedup, "PIECE", 600)
    assert flat(suffix_dedup.runs(text, sizes)) == whole and len(whole) == sum(max(0, n - 49) for n in sizes)


def vectors(rng, n):
    base = rng.normal(size=(n // 4, 12))
    rows = [*base, *(base[:20] + rng.normal(scale=0.02, size=(20, 12))), *base[:5], *(base[0] + rng.normal(scale=0.03, size=(40, 12)))]
    return [(i, [float(np.float32(v)) for v in x], int(i % 2)) for i, x in enumerate(rows)]


ODD_VECTORS = [(900, None, 0), (901, [], 0), (902, [0.0] * 12, 0), (903, [1.0, None] * 6, 0), (904, [float("nan")] * 12, 0), (905, [float("inf")] * 12, 1), (906, [1.0] * 12, None), (907, [1.0] * 3, 0), (907, [1.0] * 3, 0), (None, [1.0] * 3, 0)]
VECTOR = "vec_id long, embedding array<float>, label int"


def test_near_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)  # so that buckets are checked in pairs of blocks
    rows = vectors(np.random.default_rng(1), 240)
    got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(spark.createDataFrame(rows + ODD_VECTORS, VECTOR)).collect() if r["vec_id"] is not None}
    links = defaultdict(set)
    for i, x, a in rows:
        for j, y, b in rows:
            if i != j and a == b and np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                links[i].add(j)
    for i, _, _ in rows:
        reach, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - reach
            reach |= new
            todo += new
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (len(links[i]), min(reach), i == min(reach))
    assert sum(map(len, links.values())) > 100
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(900, 907)) and got[907]["n_links"] == 2
    assert embedding_dedup.near_vectors(spark.createDataFrame([], VECTOR)).count() == 0


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(size=8)], 0) for i in range(130)] + [(200 + i, [0.5] * 8, 0) for i in range(7)]
    got = topk.top_k(spark.createDataFrame(rows + ODD_VECTORS, VECTOR), F.col("vec_id") % 50 == 0, 5).collect()
    whole = {i: [math.floor(256 * v) for v in x] for i, x, _ in rows}
    want = []
    for q in (i for i in whole if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(whole[q], x, strict=True)), i) for i, x in whole.items() if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)
    few = topk.top_k(spark.createDataFrame([(0, [1.0], 0), (1, [1e30], 0), (2, [-1e30], 0)], VECTOR), F.col("vec_id") == 0, 5)
    assert [r["vec_id"] for r in few.orderBy("rank").collect()] == [1, 2]
    assert topk.top_k(spark.createDataFrame([], VECTOR), F.col("vec_id") == 0, 5).count() == 0


def words(rng, n):
    return [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()) + str(rng.randint(0, 99)) for _ in range(n)]


def near_rows(seed):
    rng = random.Random(seed)
    rows, i = [], 0
    for _ in range(60):
        source = words(rng, rng.randint(3, 120))
        for _ in range(rng.choice([1, 1, 2, 12])):
            own = list(source)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = "new" + str(rng.randint(0, 9))
            rows.append((i, " ".join(own)))
            i += 1
    return rows


def test_jaccard_join_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "SMALL", 8)
    rows = near_rows(3) + [(1000, None), (1001, ""), (1002, "  ?!"), (1003, "one two"), (1004, "One, two!"), (None, "one two"), (1005, "lorem ipsum dolor sit amet " * 4000)]
    got = {r["doc_id"]: r for r in jaccard_join.jaccard_join(docs_of(spark, rows)).collect() if r["doc_id"] is not None}

    def grams(text):
        own = jaccard_join.re.findall(jaccard_join.WORD, (text or "").lower())
        return {tuple(own[k : k + 5]) for k in range(max(1, len(own) - 4))} if own else set()

    sets = [(i, grams(t)) for i, t in rows]
    links = defaultdict(set)
    for a, (_, x) in enumerate(sets):
        for b, (_, y) in enumerate(sets):
            if a != b and x and y and len(x & y) >= 0.8 * len(x | y) - 1e-9:
                links[a].add(b)
    assert sum(map(len, links.values())) > 100
    for a, (i, _) in enumerate(sets):
        reach, todo = {a}, [a]
        while todo:
            new = links[todo.pop()] - reach
            reach |= new
            todo += new
        if i is not None:
            assert (got[i]["n_links"], got[i]["class_id"]) == (len(links[a]), min(sets[b][0] for b in reach if sets[b][0] is not None)), i
    assert jaccard_join.jaccard_join(docs_of(spark, [])).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r["key"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30))


def removed_by_hand(rows):
    first, last = {}, 2**63 - 1
    key = lambda i: last if i is None else i
    for i, b in sorted(rows, key=lambda r: key(r[0])):
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], key(i))
    out = []
    for i, b in rows:
        gone = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < key(i):
                gone[p : p + 50] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [0, 1])
def test_repeats_equal_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(suffix_dedup, "BATCH", 3000)
    if seed:  # windows of anchors that occur more than a few times are dealt one by one
        monkeypatch.setattr(suffix_dedup, "HOT", 3)
        monkeypatch.setattr(suffix_dedup, "PACK", 2)
    rng = random.Random(seed)
    passages = ["".join(rng.choice("ab ") for _ in range(rng.randint(40, 300))) for _ in range(8)]
    rows = []
    for i in range(200):
        text = ""
        for _ in range(rng.randint(0, 6)):
            kind, p = rng.random(), rng.choice(passages)
            text += p[rng.randint(0, 20) :][: rng.randint(30, 300)] if kind < 0.5 else rng.choice(["x" * rng.randint(1, 200), "ñé" * rng.randint(1, 80)]) if kind < 0.7 else "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 100)))
        rows.append((None if rng.random() < 0.05 else rng.randint(0, 200), None if rng.random() < 0.03 else text))
    got = suffix_dedup.repeats(docs_of(spark, rows + ODD[:7]).repartition(3), carry=["lang"]).collect()
    mine = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in got), key=repr)
    assert mine == removed_by_hand([(i, (t or "").encode()) for i, t in rows + ODD[:7]])
    assert suffix_dedup.repeats(docs_of(spark, [])).count() == 0


def test_mixing_meets_targets(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        kind = i % 4 == 0
        rows.append((i, " ".join("".join(rng.choice("abcde" if kind else "vwxyz") for _ in range(5)) for _ in range(rng.randint(1, 60)))))
        labels.append((i, "a" if kind else "b"))
    labelled = spark.createDataFrame(labels[:200], "doc_id long, domain string")
    weights, kept = mixing.mix(docs_of(spark, rows), labelled, {"a": 0.5, "b": 0.5})
    got = weights.collect()
    tokens = np.array([r["n_tokens"] for r in got], dtype=float)
    p, rate = np.array([r["posterior"] for r in got]), np.array([r["rate"] for r in got])
    assert [r["n_tokens"] for r in sorted(got, key=lambda r: r["doc_id"])] == [len(t.split()) for _, t in rows]
    np.testing.assert_allclose((tokens * rate) @ p / tokens.sum(), [0.5, 0.5], atol=2e-3)
    assert (rate >= 0).all() and kept.count() == sum(r["copies"] for r in got) and kept.columns == [f.split(" ")[0].strip("`") for f in DOCS.split(", ")]
    # the same fit by plain projected gradient
    r = np.ones(len(got))
    for _ in range(5000):
        r = np.maximum(0, r - p @ ((tokens * r) @ p / tokens.sum() - 0.5))
    np.testing.assert_allclose(r, rate, atol=0.05)
    all_of, _ = mixing.mix(docs_of(spark, rows + ODD), labelled, {"a": 0.5, "b": 0.5}, budget=None, keep_all=True)
    assert all_of.agg(F.min("copies")).first()[0] >= 1 and all_of.count() == 412
    assert mixing.mix(docs_of(spark, []), labelled, {"a": 1.0})[0].count() == 0
    none, _ = mixing.mix(docs_of(spark, rows[:3]), spark.createDataFrame([], "doc_id long, domain string"), {"a": 0.5, "b": 0.5})
    assert none.count() == 3


def test_mixing_keeps_all_and_meets_targets(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        kind = i % 4 == 0
        rows.append((i, " ".join("".join(rng.choice("abcde" if kind else "vwxyz") for _ in range(5)) for _ in range(rng.randint(1, 60)))))
        labels.append((i, "a" if kind != (rng.random() < 0.2) else "b"))  # labels that are often wrong: soft posteriors
    weights, kept = mixing.mix(docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, domain string"), {"a": 0.6, "b": 0.4}, budget=None, keep_all=True)
    got = {r["doc_id"]: r for r in weights.collect()}
    p, tokens, rate = (np.array([got[i][c] for i in range(600)], dtype=float) for c in ("posterior", "n_tokens", "rate"))
    assert 0.6 < p[:, 0].max() < 0.95 and rate.min() >= 1
    expected = (tokens * rate) @ p
    np.testing.assert_allclose(expected / expected.sum(), [0.6, 0.4], atol=2e-3)
    times = Counter(r["doc_id"] for r in kept.select("doc_id").collect())
    assert all(times[i] == got[i]["copies"] >= 1 and abs(times[i] - rate[i]) < 1 for i in range(600))
    emitted = (tokens * np.array([times[i] for i in range(600)])) @ p
    np.testing.assert_allclose(emitted / emitted.sum(), [0.6, 0.4], atol=0.03)


def test_queries_cover_all_numbers():
    assert {int(n[2:].split("_")[0]) for n in queries.queries()} == set(range(1, 14)) and set(queries.oracle_sql()) <= set(queries.queries())
