"""Sharding by sampled splitters, law ``bytes``: shards of near equal size, with equal texts side by side.

Rows are ordered by (hash of the text, text_crc32, hash of doc_id). A sample of hashes, each row drawn with a chance in proportion
to its size, gives splitters at its quantiles, which range-partition the rows into many small ranges. Texts of more than a quarter of
``ROWS`` rows are counted exactly and each is a range of its own. Ranges of many rows are then subdivided in equal steps of the
hash, a hot text's by the hash of doc_id or, where ids repeat or are null, by a salt of the row, so that ranges grow in number and
not in size whatever the texts and ids are.
Exact row and byte totals of the ranges place each range in the whole order; a shard's boundary is found by the running
totals inside its range. A boundary that would cut a group of equal texts moves to the nearer end of the group if the
shards stay within ``TOLERANCE`` of their share; a larger group is cut. Shards differ by that tolerance and by one
row's size at most, which shows where rows are large against shards.

Only the sample (about ``SAMPLE`` keys), the hot texts and the ranges' totals (a few for ``ROWS`` rows) and the boundaries come to
the driver.

Defined cases: a null text has size 1 and the checksum of the empty text; repeated rows each get a slot of their own; an empty table
gives an empty result; with fewer rows than shards some shards stay empty; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import lean, materialize

#: Keys in the sample, ranges that its quantiles make for each shard, and how far a shard may be from its share to keep a group whole.
SAMPLE, RANGES, TOLERANCE = 40_000, 48, 0.02
#: Rows of a range, about, beyond which it is subdivided.
ROWS = 500_000


def _splitters(keyed: DataFrame, total: int, ranges: int) -> list[int]:
    """Quantiles of a size-weighted sample of hashes; each row is drawn by itself, so that repeated ones don't come all together."""
    chance = F.least(F.lit(1.0), F.col("size") * (SAMPLE / max(total, 1)))
    sample = sorted(r["h"] for r in keyed.where(F.rand(7) < chance).select("h").collect())  # about SAMPLE of them
    return [sample[i * len(sample) // ranges] for i in range(1, ranges)] if sample else []


def _hot(keyed: DataFrame) -> dict[int, bool]:
    """Hashes of texts of more than a quarter of ROWS rows: whether one id of them has as many, so that the salt has to part them."""
    most = ROWS // 4
    texts = keyed.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > most).select("h")
    found = materialize(texts, "hot-texts")
    ids = keyed.join(found, "h", "left_semi").groupBy("h", "o").agg(F.count("*").alias("n")).where(F.col("n") > most)
    salted = {r["h"] for r in ids.select("h").distinct().collect()}
    return {r["h"]: r["h"] in salted for r in found.collect()}


def ranged(keyed: DataFrame, splitters: list[int]) -> DataFrame:
    """``keyed`` with ``range``: ranges of the order, numbered in it, of no more than some ROWS rows each; ``o`` is what equal texts are ordered by."""
    spark = keyed.sparkSession
    hot = _hot(keyed)
    # a hot text begins a range, and so does what follows it; a splitter is the first hash of its range
    firsts = sorted({*splitters, *hot, *(h + 1 for h in hot if h < 2**63 - 1)})
    bounds = spark.sparkContext.broadcast(firsts)  # at most shards * RANGES keys and two for each hot text

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.array(bounds.value, dtype=np.int64)
        for batch in batches:
            at = np.searchsorted(own, batch["h"].to_numpy(), "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], names=[*batch.schema.names, "range"])

    placed = keyed.mapInArrow(lean(place), StructType([*keyed.schema, StructField("range", IntegerType())]))
    kinds = spark.createDataFrame([(bisect_right(firsts, h), salted) for h, salted in hot.items()], "range int, salted boolean")
    placed = placed.join(F.broadcast(kinds), "range", "left")
    placed = placed.withColumn("o", F.when(F.col("salted"), F.col("salt")).otherwise(F.col("o"))).withColumn("step", F.when(F.col("salted").isNull(), F.col("h")).otherwise(F.col("o"))).drop("salted", "salt")
    placed = materialize(placed, "shard-ranges")
    spread = placed.groupBy("range").agg(F.count("*").alias("n"), F.min("step").alias("low"), F.max("step").alias("high"))
    parts, before = [], 0
    for r in spread.orderBy("range").collect():  # one for each range between splitters
        n = -(-2 * r["n"] // ROWS) if r["low"] < r["high"] else 1
        parts.append((r["range"], before, n, float(r["low"]), float(r["high"] - r["low"]) or 1.0))
        before += n
    steps = spark.createDataFrame(parts, "range int, before int, parts int, low double, width double")
    step = F.least(F.col("parts") - 1, F.floor((F.col("step").cast("double") - F.col("low")) / F.col("width") * F.col("parts"))).cast("int")
    return placed.join(F.broadcast(steps), "range").select(*keyed.drop("salt").columns, (F.col("before") + step).cast("int").alias("range"))


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of ``docs``."""
    keyed = keys(docs)
    total, rows = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    order = Window.partitionBy("range").orderBy("h", "text_crc32", "o", "doc_id", "size")
    own = ranged(keyed, _splitters(keyed, total, shards * RANGES))
    own = own.withColumn("row", F.row_number().over(order).cast("long")).withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    own = materialize(own, "shard-ranges")
    totals = sorted(tuple(r) for r in own.groupBy("range").agg(F.max("row"), F.max("upto")).collect())  # one for each range
    starts, n, b = {}, 0, 0
    for k, count, size in totals:
        starts[k] = (n, b)
        n, b = n + count, b + size
    cuts = _cuts(own, totals, starts, rows, total, shards)
    offsets = docs.sparkSession.createDataFrame([(k, *v) for k, v in starts.items()], "range int, row0 long, byte0 long")
    placed = own.join(F.broadcast(offsets), "range").withColumn("at", F.col("row0") + F.col("row") - 1)
    number = F.lit(0)
    first = F.lit(0).cast("long")
    for k, cut in enumerate(cuts, 1):
        number = F.when(F.col("at") >= cut, k).otherwise(number)
        first = F.when(F.col("at") >= cut, F.lit(cut).cast("long")).otherwise(first)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), number.cast("int").alias("shard"), (F.col("at") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def keys(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, h, o (hash of doc_id) and salt of every row, stored: about 40 bytes a row, so that texts are read once and salts stay."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        F.xxhash64(F.col("doc_id").cast("long")).alias("o"),
        F.xxhash64(F.monotonically_increasing_id()).alias("salt"),
    )
    return materialize(keyed, "shard-keys")


def _cuts(ranged: DataFrame, totals: list, starts: dict, rows: int, total: int, shards: int) -> list[int]:
    """For each shard but the first, the row number in the whole order at which it starts."""
    marks = [total * k // shards for k in range(1, shards)]
    held: dict[int, list[int]] = {}
    for m in marks if rows else []:
        k = next(k for k, _, size in totals if starts[k][1] + size > m)
        held.setdefault(k, []).append(m)
    if not held:
        return [rows] * (shards - 1)
    # the row of each mark: where the running total passes it
    spark = ranged.sparkSession
    sought = spark.createDataFrame([(k, m - starts[k][1], m) for k, ms in held.items() for m in ms], "range int, mark long, whole long")
    own = ranged.join(F.broadcast(sought), "range").where((F.col("upto") > F.col("mark")) & (F.col("upto") - F.col("size") <= F.col("mark")))
    at = {r["whole"]: r for r in own.select("whole", "range", "row", "upto", "size", "h", "text_crc32").collect()}
    # the groups of equal texts that the marks fall into: their bytes and first place
    groups = spark.createDataFrame([(r["h"], r["text_crc32"]) for r in at.values()], "h long, text_crc32 long").distinct()
    places = spark.createDataFrame([(k, *v) for k, v in starts.items()], "range int, row0 long, byte0 long")
    found = ranged.join(F.broadcast(groups), ["h", "text_crc32"]).join(F.broadcast(places), "range").groupBy("h", "text_crc32").agg(F.min(F.col("row0") + F.col("row") - 1).alias("first"), F.max(F.col("row0") + F.col("row")).alias("end"), F.min(F.col("byte0") + F.col("upto") - F.col("size")).alias("low"), F.max(F.col("byte0") + F.col("upto")).alias("high"))
    group = {(r["h"], r["text_crc32"]): r for r in found.collect()}
    cuts, slack = [], TOLERANCE * total / shards / 2
    for m in marks:
        r = at[m]
        g = group[(r["h"], r["text_crc32"])]
        row0, byte0 = starts[r["range"]]
        low, high = m - g["low"], g["high"] - m
        if min(low, high) <= slack:
            cuts.append(g["first"] if low <= high else g["end"])
        else:  # inside the group: at the nearer end of its row
            end = byte0 + r["upto"]
            cuts.append(row0 + r["row"] - 1 + (end - m < m - (end - r["size"])))
    return cuts
