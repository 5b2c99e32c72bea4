"""Tables in the cluster's shared folder, and positions in a sorted order."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ehrflow.session import checkpoint_dir

_WRITTEN: dict[int, tuple[SparkSession, list[str]]] = {}


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path below ``spark.checkpoint.dir``; ``release`` removes it."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{tag}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(id(spark), (spark, []))[1].append(path)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage
    is cut there, the files outlive any executor, and the sizes that later
    joins are planned by are known."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete what ``written`` and ``shared_path`` left. DataFrames that read
    it cannot be used afterwards. Runs by itself when Python ends."""
    _, paths = _WRITTEN.pop(id(spark), (spark, []))
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


@atexit.register
def _release_all() -> None:
    for spark, _ in list(_WRITTEN.values()):
        if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
            release(spark)


def positions(df: DataFrame, order: list[Column], name: str = "idx", tag: str = "order") -> DataFrame:
    """``df`` with ``name``, its rows' place (from 0) in ``order``.

    No task sees all rows: a range partitioning is written, rows are counted
    within their partition, and the sums of the earlier partitions (one row
    for each partition) are added."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), tag)
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"))
    row = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return (ranged.withColumn("__row", row).join(starts, "__part")
            .withColumn(name, (F.col("__from") + F.col("__row") - 1).cast("long"))
            .drop("__part", "__row", "__from"))
