"""The pipeline against the stages by themselves, on documents with planted cases."""

import random

import corpus_pipeline as cp


def tables(spark, folder):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    passage = " ".join(word() for _ in range(70))
    rows, labels = [], []
    for i in range(240):
        text = [word() for _ in range(rng.randint(30, 90))]
        toxic = i % 6 == 0
        if toxic:
            for w in ("grumblefoo", "snarlbar"):
                text.insert(rng.randrange(len(text)), w)
        if i in (41, 43):
            text.append(passage)
        rows.append((i, " ".join(text), "en", "s", 0))
        labels.append((i, int(i % 4 > 0), int(toxic)))
    rows += [(500, rows[1][1], "en", "s", 0), (501, rows[7][1] + " end", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows, passage


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    rows, passage = tables(spark, folder)
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        path = f"{folder}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    toxic = {r[0] for r in rows if "grumblefoo" in r[1]}
    assert not toxic & set(seen["toxicity"]) and len(seen["toxicity"]) == len(rows) - len(toxic)
    assert set(seen["toxicity"]) - set(seen["near_duplicates"]) == {500, 501}
    assert passage in seen["suffix_array_dedup"][41] and passage not in seen["suffix_array_dedup"][43]
    assert set(seen["mixing"]) == set(seen["suffix_array_dedup"])
    got, whole = cp.STAGES[-1][1](spark, docs, folder), cp.run(spark, folder)
    assert whole.exceptAll(got).count() == 0 and got.exceptAll(whole).count() == 0


def test_cut_characters_go(spark):
    """Bytes left of cut characters go, characters of a document's own stay, U+FFFD among them; names that clash with results are carried."""
    shared = "x" * 60 + "ñ"
    rows = [(1, "ab\ufffd " + shared, 1, "k1"), (2, "\ufffdñ" + shared.replace("ñ", "ò") + " \ufffd", 2, "k2"), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_removed int, kept string")
    got = {r["doc_id"]: r for r in cp.repeats_stage(spark, docs, "").collect()}
    assert got[1]["text"] == rows[0][1] and got[2]["text"] == "\ufffdñ \ufffd"
    assert (got[2]["n_removed"], got[2]["kept"]) == (2, "k2") and got[None]["text"] == ""


def test_unusual_rows(spark, tmp_path):
    """Null columns, empty and very long texts, repeated rows and ids, and an empty table go through every stage."""
    folder = str(tmp_path)
    kinds = "doc_id long, text string, lang string, source string, n_chars long, n_tokens int, kept string, copies long"
    rows = [(1, None), (2, ""), (2, ""), (None, "some words of no id"), (None, "some words of no id"), (3, "one two three"), (3, "other words than those"), (4, "lorem ipsum dolor sit amet " * 8000), (5, "x" * 60_000), (-7, "ΑΣΣ İ ñ 日本語")]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(*r, *(None,) * 6) for r in rows], kinds).write.parquet(f"{folder}/documents.parquet")
    docs, left = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in cp.STAGES[:-1]:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        left.append(sorted(r["doc_id"] for r in docs.where("doc_id is not null").select("doc_id").collect()))
    assert left == [[-7, 1, 2, 2, 3, 3, 4, 5]] * 4
    assert cp.STAGES[-1][1](spark, docs, folder).count() == 10
    none = spark.createDataFrame([], kinds)
    for _, stage in cp.STAGES:
        assert stage(spark, none, folder).count() == 0
