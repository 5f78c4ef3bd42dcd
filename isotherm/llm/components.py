"""Connected components by contraction, for links between keys of any type.

Each round every key takes the smallest key among its neighbours and itself; links are then renamed to those keys, and
links that have become loops or repeat others go away. Each round at least halves the keys that still have links. Nothing
is collected; each round's table is written to the shared folder, so that its lineage ends there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame) -> DataFrame:
    """(key, root) for every key in ``links`` (a, b); root is the smallest key of its component."""
    spark = links.sparkSession
    own = links.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    own = materialize(own, "links")
    mapped = None
    while not own.isEmpty():
        both = own.unionByName(own.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("key"), F.least("a", "m").alias("to")), "components")
        # a key's smallest neighbour may itself have moved on: one more hop
        hop = step.select(F.col("key").alias("to"), F.col("to").alias("hop"))
        step = materialize(step.join(hop, "to", "left").select("key", F.coalesce("hop", "to").alias("to")), "components")
        of = lambda c: step.select(F.col("key").alias(c), F.col("to").alias(f"{c}_to"))
        if mapped is None:
            mapped = step.select("key", F.col("to").alias("root"))
        else:
            moved = step.select(F.col("key").alias("root"), "to")
            mapped = materialize(mapped.join(moved, "root", "left").select("key", F.coalesce("to", "root").alias("root")), "components")
        renamed = own.join(of("a"), "a").join(of("b"), "b").where(F.col("a_to") != F.col("b_to"))
        own = materialize(renamed.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), "links")
    if mapped is None:
        kind = links.schema["a"].dataType.simpleString()
        return spark.createDataFrame([], f"key {kind}, root {kind}")
    return mapped
