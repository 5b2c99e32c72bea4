"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. The time zone is pinned because the
# stored timestamps are zone-less UTC wall times; AQE re-plans joins and
# splits skewed partitions at run time.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.bucketing.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "ehrflow", extra: dict | None = None) -> SparkSession:
    """Session for tests and the bench. On a cluster, use the cluster's
    session and only make sure ``DEFAULT_CONF`` is applied."""
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scale_conf(input_bytes: int, cores: int, target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Partition sizing for a run over ``input_bytes`` of parquet on
    ``cores`` executor cores: ``target_partition_bytes`` of input per scan
    task; one shuffle partition per GB of input (the queries shuffle narrow
    projections and partial aggregates, a fraction of the input), at least 3
    per core and at most 100k so map x reduce block counts stay manageable;
    AQE coalesces small partitions towards 128 MB and splits skewed ones
    (over 4x the median and 256 MB). Apply with ``spark.conf.set`` before
    building the queries."""
    shuffle = min(max(cores * 3, input_bytes // (1 << 30)), 100_000)
    return {
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 << 20),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(256 << 20),
    }


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only with a local master (tests), where there is but one machine, is a
    private folder set when the session names none. On a cluster that is an
    error: executors would not see each other's files.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not configured:
        configured = tempfile.mkdtemp(prefix="ehrflow-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


_SCRATCH: dict[int, tuple[SparkSession, list[str]]] = {}


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder, which :func:`release` removes."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/ehrflow-{tag}-{uuid.uuid4().hex}"
    _SCRATCH.setdefault(id(spark), (spark, []))[1].append(path)
    return path


def release(spark: SparkSession) -> None:
    """Delete what the operators left below the shared folder. DataFrames that
    read it cannot be used afterwards. Runs by itself when Python ends."""
    _, paths = _SCRATCH.pop(id(spark), (spark, []))
    for path in paths:
        drop_path(spark, path)


@atexit.register
def _release_all() -> None:
    for spark, _ in list(_SCRATCH.values()):
        if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
            release(spark)


def shared_table(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written as Parquet below the shared folder (or to ``path``) and
    read again: lineage ends there, the rows outlive any executor, and a join
    with it gets an exchange of its own, which AQE can split."""
    path = path or scratch_path(df.sparkSession, "table")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate data."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
