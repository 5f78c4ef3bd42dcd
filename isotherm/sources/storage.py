"""Tables written once in the folder that all executors share, to end a lineage that several later steps start from."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Where that is unset it is one in the warehouse; a cluster's session whose warehouse is a local folder is refused.
    """
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    if not spark.conf.get("spark.master", "local").split("[")[0] == "local" and spark._jvm.org.apache.hadoop.fs.Path(base).getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() == "file":
        raise RuntimeError("set spark.checkpoint.dir: the warehouse is a folder of one machine")
    return base


class _Steps(threading.local):
    """What a thread has stored and not yet removed: names of catalog tables, or '', and paths."""

    def __init__(self):
        self.known: list[tuple[str, str]] = []


_STEPS = _Steps()


def noted(name: str, path: str) -> None:
    """A step of some other kind (a catalog table ``name``, or '' for files) that ``removed`` takes along."""
    _STEPS.known.append((name, path))


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """``df``, written once as Parquet in the shared folder and reread."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    noted("", path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: a row's place, from 0, in its group of ``by`` in ``order``.

    Rows are sorted by ranges, each range numbers its own, and a range's numbers are moved on by the group's rows in the ranges
    before it; so a large group is spread over tasks.
    """
    ranged = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    rows = stored(ranged.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), "ranges")
    counts = rows.groupBy(*by, "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__least"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    moved = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__least")).drop("__n", "__least")
    out = rows.join(moved, [*by, "__part"])
    return out.withColumn(name, F.col("__at") + F.col("__before")).drop("__part", "__at", "__before").select(*df.columns, name)


def removed(spark: SparkSession, since: int = 0) -> int:
    """This thread's steps after the first ``since`` go; to be called once what was made of them has been written. Returns how many are left."""
    for name, path in _STEPS.known[since:]:
        if name:
            spark.sql(f"drop table if exists {name}")
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    del _STEPS.known[since:]
    return len(_STEPS.known)


def steps() -> int:
    """How many steps this thread has stored."""
    return len(_STEPS.known)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is stored inside goes at the end; what was made of it has to be written by then."""
    since = steps()
    try:
        yield
    finally:
        removed(spark, since)
