"""Keyed upserts, run log, cache rows and files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import file_safe
from .storage import scratch, stored


def latest(batches: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key over all batches, ``order`` being the columns that tell earlier from later."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order)))
    return batches.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def upsert(existing: DataFrame, batch: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Existing rows, replaced and added to by a batch.

    Of a batch's rows of one key that counts which is last by ``order``, columns of the batch that need not be stored; without it
    any of them may, so that a batch should have each key once then.
    """
    order = order or []
    last = batch.withColumns({"__batch": F.lit(1), **{f"__o{k}": F.col(c) for k, c in enumerate(order)}})
    old = existing.withColumns({"__batch": F.lit(0), **{f"__o{k}": F.lit(None).cast(batch.schema[c].dataType) for k, c in enumerate(order)}})
    names = [*existing.columns, "__batch", *(f"__o{k}" for k in range(len(order)))]
    return latest(old.select(names).unionByName(last.select(names)), keys, names[len(existing.columns) :]).select(existing.columns)


def write_upsert(spark: SparkSession, path: str, batch: DataFrame, keys: list[str], partition: str, order: list[str] | None = None) -> int:
    """Upsert into Parquet files partitioned by ``partition``: only the partitions that the batch touches are rewritten. Returns the rows submitted.

    The batch is worked out once. Columns of ``order`` tell which of a key's rows is last and aren't written.
    """
    with scratch(spark):
        batch = stored(batch, "batch")
        submitted, columns = batch.count(), [c for c in batch.columns if c not in (order or [])]
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            touched = batch.select(partition).distinct()
            merged = upsert(spark.read.parquet(path).join(touched, partition, "left_semi").select(columns), batch, keys, order)
            merged = stored(merged, "upsert")  # the files read are those replaced
        else:
            merged = upsert(batch.select(columns).limit(0), batch, keys, order)
        merged.repartition(partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    return submitted


def run_states(events: DataFrame) -> DataFrame:
    """The state of each run from appended events (run_id, at, status, ...): the last one, with the first one's time as start."""
    last = F.max_by(F.struct("status", "at"), F.struct("at", "status"))
    out = events.groupBy("run_id").agg(F.min("at").alias("started_at"), last.alias("last"))
    ended = F.col("last.status") != "running"
    return out.select("run_id", "started_at", F.when(ended, F.col("last.at")).alias("finished_at"), F.col("last.status").alias("status"), F.when(ended, ((F.unix_micros(F.col("last.at")) - F.unix_micros("started_at")) / 1000).cast("long")).alias("duration_ms"))


def cache_states(events: DataFrame) -> DataFrame:
    """By city the last status; a reference to a payload outlives later states that have none."""
    kept = F.max_by("payload_ref", F.when(F.col("payload_ref").isNotNull(), F.col("at")))
    return events.groupBy("city").agg(F.max_by("status", "at").alias("status"), F.max("at").alias("updated_at"), kept.alias("payload_ref"))


def as_json(df: DataFrame, keys: list[str], name: str = "payload") -> DataFrame:
    """Everything but the keys as one JSON column."""
    record: Column = F.to_json(F.struct(*(c for c in df.columns if c not in keys)), {"timestampFormat": "yyyy-MM-dd HH:mm:ss"})
    return df.select(*keys, record.alias(name))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def payload_file(city: Column, run: str, at: str) -> Column:
    """A payload's name by city, run and time (yyyyMMddTHHmmssZ): letters and digits that are no such become underscores."""
    return F.concat(file_safe(city), F.lit(f"__{run}__{at}.json"))


def write_payloads(payloads: DataFrame, base: str, run: str, at: str) -> DataFrame:
    """Writes each (city, payload) below ``base`` in a folder of its own name; returns (city, path)."""
    named = payloads.withColumn("file", payload_file(F.col("city"), run, at))
    named.select("file", F.col("payload").alias("value")).write.mode("append").partitionBy("file").text(base)
    return named.select("city", F.concat(F.lit(f"{base.rstrip('/')}/file="), "file").alias("path"))


def write_csv(df: DataFrame, path: str, meta: dict | None = None) -> None:
    """CSV with a header; with ``meta`` also one JSON record beside it, at ``path`` with the ending .meta.json."""
    df.write.mode("overwrite").csv(path, header=True)
    if meta is not None:
        record = df.sparkSession.createDataFrame([(json.dumps(meta, default=str),)], "value string")
        record.coalesce(1).write.mode("overwrite").text(path.rstrip("/").removesuffix(".csv") + ".meta.json")
