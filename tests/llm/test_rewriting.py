"""Fill-in-the-middle, repetition rules and the prefix trie against brute force, and on unusual input."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from isotherm.llm import fill_middle, prefix_trie, repetition

#: Columns whose names clash with results.
DOCS = "doc_id long, text string, n long, form string, kept string, spans string, units int"
ODD = [(1, None), (2, ""), (2, ""), (None, "the mit license"), (None, "the mit license"), (3, "a"), (3, "b b b b b b"), (4, "lorem ipsum dolor sit amet " * 8000), (5, "x" * 60_000), (-7, "ΑΣΣ İ ñ 日本語 😀 \u0000 end"), (6, "<P> here"), (7, " \n\t "), (2**60 + 1, "é" * 5000)]


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, *(None,) * 5) for r in rows], DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    shared = " ".join("".join(rng.choice("abcdefgñ日") for _ in range(rng.randint(1, 9))) for _ in range(600))
    some = lambda n: "".join(rng.choice("ab ñ日\n<PSM>") for _ in range(n))
    return [some(rng.randint(0, 30)) for _ in range(200)] + [some(rng.randint(0, 900)).replace("<", "") + shared[rng.randint(0, 500) :] + some(9) for _ in range(40)]


def filled(doc_id, text):
    """(n, form, prefix, middle, output) by hand."""
    text = text or ""
    n = len(text)
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle(spark, texts):
    rows = [(100 + i, t) for i, t in enumerate(texts)] + ODD
    out = fill_middle.fill_in_middle(docs_of(spark, rows)).withColumn("again", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    got = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in out), key=repr)
    assert got == sorted(((i, *filled(i, t)) for i, t in rows), key=repr)
    assert sorted(((r["doc_id"], r["again"]) for r in out), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("sizes", [(64, 4096, 9), (1, 3, 1), (2, 20, 3)])
def test_cuts_are_located_through_chunks(monkeypatch, texts, sizes):
    for name, value in zip(("LEAST", "MOST", "BITS"), sizes, strict=True):
        monkeypatch.setattr(fill_middle, name, value)
    monkeypatch.setattr(fill_middle, "CACHED", 50)
    monkeypatch.setattr(fill_middle, "PIECE", 40)
    known = fill_middle.Summaries([b"<P>", b"<S>", b"<M>"])
    for t in texts:
        own = fill_middle.located(t.encode(), known)
        assert b"".join(own.parts) == t.encode() and own.units == len(t)
        assert own.marked == any(m in t for m in ("<P>", "<S>", "<M>"))
        assert all(own.byte_of(k) == len(t[:k].encode()) for k in {0, 1, len(t) // 3, len(t) // 2, len(t)} if k <= len(t))
    assert len(known) <= 50


def test_shared_passages_fall_into_the_same_chunks():
    rng = random.Random(1)
    some = lambda n: bytes(rng.randrange(97, 123) for _ in range(n))
    shared = some(20_000)
    a, b = (set(fill_middle.chunks(some(n) + shared + some(n))) for n in (3000, 1234))
    assert sum(map(len, a & b)) > 15_000


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def judged(text):
    """Counts by hand: (words, characters, symbols, repeated lines, words and characters in repeated runs of five, longest repeat)."""
    text = text or ""
    w = WORD.findall(text)
    runs = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {j for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    longest = 0
    if inside:
        low, high = 5, len(w)
        while low < high:
            k = (low + high + 1) // 2
            low, high = (k, high) if max(Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)).values()) > 1 else (low, k - 1)
        longest = low
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), sum(len(w[j]) for j in inside), longest


def test_quality_rules(spark, monkeypatch):
    monkeypatch.setattr(repetition, "PIECE", 4000)
    rng, rows = random.Random(3), [r for r in ODD if len(r[1] or "") < 61_000]
    for i in range(300):
        words = ["a", "bb", "ñc", "日本", "#x", "d%", "e"][: rng.randint(1, 7)]
        rows.append((100 + i, "".join(rng.choice(words) + rng.choice([" ", "\n", "\t ", "  ", "\x0b"]) for _ in range(rng.randint(0, 60)))))
    block = " ".join(f"w{k}" for k in range(120))
    rows += [(900, block + " and " + " ".join(f"v{k}" for k in range(900)) + " " + block), (901, " ".join(f"v{k}" for k in range(900))), (902, "same line of some words here\n" * 3 + " ".join(f"v{k}" for k in range(60)))]
    got = repetition.quality_rules(docs_of(spark, rows)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_chars", "longest_repeat")
    assert sorted(((r["doc_id"], *(r[c] for c in names)) for r in got), key=repr) == sorted(((i, *judged(t)) for i, t in rows), key=repr)
    for r in got:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_repeat_words"]
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed and r["covered_chars"] <= 0.25 * r["word_chars"] and r["longest_repeat"] <= 100)
    verdicts = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in got}
    assert verdicts[900] == (True, False) or verdicts[900] == (False, False)
    assert verdicts[901] == (False, True) and verdicts[902] == (True, False)
    assert repetition.quality_rules(docs_of(spark, [])).count() == 0


def test_the_longest_repeat_alone_fails(spark):
    block = " ".join(f"w{k}" for k in range(101))
    text = block + " " + " ".join(f"v{k}" for k in range(2000)) + " " + block
    got = repetition.quality_rules(docs_of(spark, [(1, text), (2, text.replace("w50 ", "u ", 1))])).orderBy("doc_id").collect()
    assert [(r["base_failed"], r["longest_repeat"], r["kept"]) for r in got] == [(False, 101, False), (False, 50, True)]


KIND = "conv_id long, turn long, role string, text string, depth int, digest string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie(rows):
    """Nodes by hand."""
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((t is not None, t or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16], role, text))
    own = {c: [turn[3:] for turn in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = own.get(c - abs(c) % 100 * (1 if c >= 0 else -1), [])[:h] + turns[h:]
    members, children = defaultdict(list), defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    leaves, saved, out = {}, {}, []
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        saved[k] = sum(saved[x] for x in children[k]) + ((len(members[k]) - 1) * len(k[-1][1]) if k else 0)
        ends = ",".join(str(c) for c in sorted(members[k]) if len(whole[c]) == len(k))
        out.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(children[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(rng, n, turns, texts):
    rows = []
    for c in rng.sample(range(-150, 600), n):
        rows += [(c, t * rng.choice([1, 1, 1, 5000]), rng.choice(["user", "assistant", None]), rng.choice(texts)) for t in range(rng.randint(1, turns))]
    return rows


UNUSUAL = [(None, 1, "user", "x"), (700, None, None, None), (700, None, None, None), (801, 0, "u", "only"), (900, 1, "user", "q"), (900, 1, "user", "q"), (901, 1, "user", "q")]


@pytest.mark.parametrize("rows", [conversations(random.Random(1), 120, 6, ["a", "bñ", "日本語", None, ""]), conversations(random.Random(2), 40, 14, ["a", "b"]), [(c, t, "user", "abc"[t % 3 if t < 9 else c % 2]) for c in range(60) for t in range(11)], [(104, 0, "u", "x")]])
def test_prefix_trie(spark, monkeypatch, rows):
    monkeypatch.setattr(prefix_trie, "SEGMENT", 4)  # so that conversations fall into segments
    monkeypatch.setattr(prefix_trie, "HELD", 2000)  # and tasks emit several trees
    monkeypatch.setattr(prefix_trie, "BLOCK", 7)
    rows = rows + UNUSUAL
    got = prefix_trie.prefix_trie(spark.createDataFrame([(*r, 1, "x") for r in rows], KIND)).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=repr) == trie(rows)


def test_no_conversations(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], KIND)).count() == 0


def test_nodes_grow_through_all_layouts():
    """Keys that differ in one byte fill a node of every layout; what is found equals a plain dictionary."""
    rng, width = random.Random(4), prefix_trie.WIDTH
    for n in (3, 4, 5, 16, 17, 48, 49, 200, 256):
        root, seen = prefix_trie.Tree(b"", [], [[0, 0]], 0, 0), Counter()
        first = rng.randbytes(width)
        for member, byte in enumerate(rng.sample(range(256), n)):
            key = first + bytes(width - 1) + bytes([byte]) + rng.randbytes(width) * (member % 2)
            turns = len(key) // width
            prefix_trie.insert(root, key, [7] * turns, [(0, 0)] * (turns - 1) + [(1, turns)], member)
            seen.update(key[: k * width] for k in range(turns + 1))
        found = {d: (turns, members) for d, _, turns, _, members, *_ in prefix_trie.nodes(root, prefix_trie.ROOT)}
        assert found == {prefix_trie.digest(prefix_trie.ROOT, k): (len(k) // width, m) for k, m in seen.items()}
        top = next(iter(prefix_trie.nodes(root, prefix_trie.ROOT)))
        assert top[6:] == (n, sum(2 + m % 2 for m in range(n)))
