"""Scores by a plain version, and unusual tables for the operators that had none."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from isotherm.llm import embedding_dedup, licenses, suffix_dedup, token_counts, topk, toxicity
from isotherm.llm.common import texts
from isotherm.llm.queries import BYTE_BPE

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, n_tokens long, `range` int, key string"
ODD = [(1, None), (2, ""), (2, ""), (None, "you idiot"), (None, "you idiot"), (3, "a"), (4, "lorem ipsum dolor sit amet " * 8000), (5, "x" * 60_000), (-7, "ΑΣΣ İ ñ 日本語 😀 \u0000 end"), (7, " \n\t ")]


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, *(None,) * 7) for r in rows], DOCS)


def plain_density(text, weights):
    """All places of all entries and phrases in the folded text, found by trying each; the first of those that overlap counts, the longest of one place."""
    words = toxicity.fold(text or "").split()
    if not words:
        return 0.0
    line = " " + " ".join(words) + " "
    known = {f" {p} ": None for p in toxicity.EXCEPTIONS} | weights
    hits = sorted((at, -len(e), w) for e, w in known.items() for at in range(len(line)) if line.startswith(e, at))
    total, end = 0.0, -1
    for at, size, weight in hits:
        if at >= end - 1:
            end, total = at - size, total + (weight or 0.0)
    return total / math.sqrt(len(words))


def test_scores_equal_the_plain_version(spark):
    rng = random.Random(8)
    weights = {" trash ": 5.0, " stup": 4.0, " stupi": 2.5, " idiot ": 4.0, " pig ": 1.5, " freak ": 3.0, " grumb": 3.5}
    words = ["trash", "can", "stupid", "stupa", "astute", "idiot", "proof", "guinea", "pig", "pigs", "iron", "freak", "accident", "grumble", "TR4SH", "ѕtuрid", "1d10t", "p!g", "day", "of", "control"]
    rows = [(100 + i, rng.choice([" ", ", ", "\n"]).join(rng.choice(words) for _ in range(rng.randint(0, 25)))) for i in range(300)] + ODD
    got = toxicity.scored(texts(docs_of(spark, rows)), toxicity.Lexicon(weights, 0.4)).collect()
    score = lambda t: plain_density(t, weights) / (plain_density(t, weights) + 0.4)
    assert sorted(((r["doc_id"], round(r["score"], 12)) for r in got), key=repr) == sorted(((i, round(score(t), 12)) for i, t in rows), key=repr)
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in got) and {0, 1} == {r["predicted"] for r in got}
    kept = toxicity.kept_rows(docs_of(spark, rows), toxicity.Lexicon(weights, 0.4)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=repr) == sorted(((i, t) for i, t in rows if score(t) < 0.5), key=repr)


def test_a_lexicon_is_learned_from_training_rows_alone(spark):
    """Words of held-out rows' labels don't enter it; contradicting labels of an id count as toxic; the seeds stay."""
    rng = random.Random(2)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(200)]
    rows, labels = [], []
    held = {r["id"] for r in spark.range(600).where(toxicity.held_out(F.col("id"))).collect()}
    for i in range(600):
        words = [rng.choice(plain) for _ in range(20)]
        if i % 4 == 0:
            words.insert(3, "heldword" if i in held else "trainword")
        rows.append((i, " ".join(words)))
        labels += [(i, int(i % 4 == 0))] + ([(i, 0)] if i % 8 == 0 else [])
    found = toxicity.fit(docs_of(spark, rows + ODD), spark.createDataFrame(labels, "doc_id long, toxic int"), ~toxicity.held_out(F.col("doc_id")))
    assert any(e.strip() and "trainword".startswith(e.strip()) for e in found.weights) and not any("heldword".startswith(e.strip()) for e in found.weights)
    assert {f" {w} " for w in toxicity.SEED} <= set(found.weights) and found.cutoff > 0


def test_empty_documents(spark):
    none, labels = docs_of(spark, []), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert licenses.license_scan(none).count() == 0
    assert toxicity.toxicity(none, labels).count() == 0
    import public_tokenizers

    assert token_counts.token_counts(none, public_tokenizers.path(BYTE_BPE)).count() == 0


CLASHING = "vec_id long, embedding array<float>, label int, query_id long, rank int, score long, n_links long, component_id string, kept int, bucket int, norm double"


def test_vectors_beside_columns_that_clash(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(size=6)], i % 2) for i in range(60)]
    rows += [(100 + i, rows[i][1], rows[i][2]) for i in range(10)]
    wide, narrow = spark.createDataFrame([(*r, *(None,) * 8) for r in rows], CLASHING), spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert same(embedding_dedup.near_vectors(wide), embedding_dedup.near_vectors(narrow))
    assert same(topk.top_k(wide, F.col("vec_id") % 50 == 0, 5), topk.top_k(narrow, F.col("vec_id") % 50 == 0, 5))


def removed_by_hand(rows, size=50):
    """Spans of bytes that a string of 50 bytes covers which starts in a document of smaller id, too; strings by their hash table of least ids."""
    least: dict[bytes, int] = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - size + 1):
            w = b[k : k + size]
            if i is not None and i < least.get(w, 2**63):
                least[w] = i
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - size + 1):
            if least.get(b[k : k + size], 2**63) < (2**63 if i is None else i):
                gone[k : k + size] = True
        out.append((i, len(b), int(gone.sum()), bytes(np.frombuffer(b, np.uint8)[~gone])))
    return sorted(out, key=repr)


@pytest.mark.parametrize("pack", [6, 1])
def test_long_documents_lose_what_others_hold(spark, monkeypatch, pack):
    """Very long texts, one of a single repeated passage and one of a single letter, against every string of 50 bytes."""
    monkeypatch.setattr(suffix_dedup, "PACK", pack)
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefgh ñ") for _ in range(400))
    rows = [*ODD, (8, "y" * 49 + "x" * 70), (9, passage * 60), (10, "some words " + passage + " more"), (11, "lorem ipsum dolor sit amet " * 5), (12, "".join(rng.choice("ab") for _ in range(70_000)))]
    got = suffix_dedup.repeats(docs_of(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in got), key=repr) == removed_by_hand(rows)
