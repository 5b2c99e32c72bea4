"""Tables that change by whole files: copy-on-write with manifests.

A table is a folder of Parquet files and of manifests. Manifest ``n`` is a
small Parquet table that lists the files of version ``n``; it is written under
a temporary name and takes its own by one rename, so a version is there with
all its files or not at all, and of two writers that start from one version
the second one fails and leaves nothing visible. A change reads the key column
with each row's ``_metadata.file_path`` to find the files that hold a changed
key, rewrites those, and lists all others again as they are. Earlier versions
stay readable until :func:`vacuum`.

The driver handles file names (as it does for any scan), never rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has committed a version since this one began."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _manifest(root: str, version: int) -> str:
    return f"{root}/_manifests/v{version:09d}"


def versions(spark: SparkSession, root: str) -> list[int]:
    """The committed versions, oldest first."""
    fs, path = _fs(spark, f"{root}/_manifests")
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n[1:]) for n in names if n.startswith("v"))


def files(spark: SparkSession, root: str, version: int | None = None) -> list[str]:
    """The file names of a version (the latest by default)."""
    version = versions(spark, root)[-1] if version is None else version
    return sorted(r.file for r in spark.read.schema("file string").parquet(_manifest(root, version)).collect())


def read(spark: SparkSession, root: str, version: int | None = None, only: list[str] | None = None) -> DataFrame:
    """The rows of a version; with ``only``, those of some of its files."""
    version = versions(spark, root)[-1] if version is None else version
    names = files(spark, root, version) if only is None else only
    schema = spark.read.parquet(f"{root}/_schema").schema
    return spark.read.schema(schema).parquet(*(f"{root}/{n}" for n in names)) if names else spark.createDataFrame([], schema)


def _write(df: DataFrame, root: str) -> list[str]:
    """New data files, which no version lists yet."""
    spark, folder = df.sparkSession, f"data/{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{folder}")
    fs, path = _fs(spark, f"{root}/{folder}")
    return [f"{folder}/{s.getPath().getName()}" for s in fs.listStatus(path) if s.getPath().getName().endswith(".parquet") and s.getLen() > 0]


def _commit(spark: SparkSession, root: str, version: int, names: list[str]) -> int:
    made = f"{root}/_manifests/.{uuid.uuid4().hex}"
    spark.createDataFrame([(n,) for n in names], "file string").coalesce(1).write.parquet(made)
    fs, source = _fs(spark, made)
    target = _fs(spark, _manifest(root, version))[1]
    if fs.exists(target) or not fs.rename(source, target):
        fs.delete(source, True)
        raise Conflict(f"version {version} of {root} is there already")
    return version


def create(df: DataFrame, root: str) -> int:
    """Version 0: the rows of ``df`` (as many files as it has partitions)."""
    df.limit(0).write.mode("overwrite").parquet(f"{root}/_schema")
    return _commit(df.sparkSession, root, 0, _write(df, root))


def touched(spark: SparkSession, root: str, keys: DataFrame, on: list[str], version: int) -> list[str]:
    """The files of a version that hold a row with one of ``keys``. Only the
    key columns are read."""
    found = (read(spark, root, version).select(*on, F.col("_metadata.file_path").alias("_file"))
             .join(keys.select(*on).distinct(), on, "left_semi").select("_file").distinct().collect())
    names = {n.rsplit("/", 2)[-2] + "/" + n.rsplit("/", 1)[-1]: n for n in files(spark, root, version)}
    return sorted(names["/".join(r["_file"].rsplit("/", 2)[-2:])] for r in found)


def change(spark: SparkSession, root: str, keys: DataFrame, on: str | list[str], new: Callable[[DataFrame], DataFrame],
           added: DataFrame | None = None) -> tuple[int, list[str], list[str]]:
    """Commit a version in which the files that hold a row with one of
    ``keys`` are replaced by ``new`` of their rows (patches, deletes), and
    ``added`` rows have files of their own (inserts). Returns the version, the
    files that left and those that came. Nothing to change commits nothing."""
    on = [on] if isinstance(on, str) else list(on)
    base = versions(spark, root)[-1]
    old = touched(spark, root, keys, on, base)
    fresh = _write(new(read(spark, root, only=old)), root) if old else []
    if added is not None:
        schema = read(spark, root, only=[]).schema
        fresh += _write(added.select(*(F.col(f.name).cast(f.dataType) for f in schema.fields)), root)
    if not old and not fresh:
        return base, [], []
    kept = sorted(set(files(spark, root, base)) - set(old))
    return _commit(spark, root, base + 1, kept + fresh), old, fresh


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Forget all versions but the last ``keep`` and delete the files that
    none of those lists; the number of deleted files. No writer may be at work."""
    known = versions(spark, root)
    wanted = {n for v in known[-keep:] for n in files(spark, root, v)}
    fs, path = _fs(spark, f"{root}/data")
    gone = 0
    for folder in fs.listStatus(path):
        inside = [s.getPath() for s in fs.listStatus(folder.getPath())]
        names = {f"data/{folder.getPath().getName()}/{p.getName()}": p for p in inside}
        dead = [p for n, p in names.items() if n.endswith(".parquet") and n not in wanted]
        gone += len(dead)
        if not any(n in wanted for n in names):
            fs.delete(folder.getPath(), True)
        else:
            for p in dead:
                fs.delete(p, False)
    for v in known[:-keep]:
        fs.delete(_fs(spark, _manifest(root, v))[1], True)
    return gone
