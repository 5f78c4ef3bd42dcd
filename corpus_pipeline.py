"""A training-data pipeline over ``documents``: each stage works on all that the one before kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isotherm.llm.automaton import bpe_digest
from isotherm.llm.common import table
from isotherm.llm.jaccard_join import jaccard_join
from isotherm.llm.mixing import mix
from isotherm.llm.queries import WORD_BPE, domains_of
from isotherm.llm.suffix_dedup import repeats
from isotherm.llm.toxicity import fit, held_out, kept_rows
from isotherm.sources import storage

#: Shares of tokens by domain after the mixing stage.
TARGETS = {"high": 0.9, "low": 0.1}


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score 0.5 or more; null and empty texts score 0 and stay, and so do repeated rows of the rest."""
    lexicon = fit(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    return kept_rows(docs, lexicon)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of near copies.

    Documents without words are classes of their own. Rows that repeat an id stay together: with the kept id, or with one that
    has a text of another class, all do; null ids can't be told apart and stay.
    """
    classes = jaccard_join(docs, threshold=0.8)
    # those that go are fewer than those that stay
    gone = classes.groupBy("doc_id").agg(F.max("kept").alias("kept")).where(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("__gone"), "left_anti").select(docs.columns)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that a document of smaller id holds as well; what is left of cut characters goes, too.

    Null texts become empty ones, repeated rows and null ids stay, other columns are carried along.
    """
    kinds = dict(docs.dtypes)
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    cleaned = repeats(docs, carry=others, as_text=True)
    own = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept")} | {c: F.col("carried").getField(c) for c in others}
    return cleaned.select(*(own[c].cast(kinds[c]).alias(c) for c in docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its fitted rate says, once at least, so that token shares by domain meet the targets."""
    return mix(docs, domains_of(table(spark, sf_dir, "labels")), TARGETS, budget=None, keep_all=True)[1]


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return bpe_digest(docs, public_tokenizers.path(WORD_BPE))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("suffix_array_dedup", repeats_stage),
    ("mixing", mixing_stage),
    ("bpe", encoding_stage),
]

#: SQL can't express learned scores, byte-pair encoding or the fit; tests compare with plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``, each result written and reread before the next.

    What a stage has stored on its way goes when its result is written.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        since = storage.steps()
        out = stage(spark, docs, sf_dir)
        path = f"{storage.shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
        out.write.parquet(path)
        storage.removed(spark, since)
        storage.noted("", path)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
