"""L1-L4: physical layout of the clinical tables.

Patient-keyed tables are bucketed by ``documento_id`` with the same bucket
count, so joins and aggregations on that key read matching buckets and need
no shuffle (the co-location the reference gets from distributing its tables
on the same key). Within a bucket rows are in Z-order of the columns that the
lookups filter on (:mod:`ehrflow.plans.clustering`), so parquet min/max
statistics skip row groups for each of them, and the near-unique ones have
Bloom filters, so a lookup of a key that is not there reads no row group. JSON
columns are saved as VARIANT, shredded into typed columns that Spark infers, so
a query of one vital reads that vital and parses nothing. The small
professionals table is left unbucketed.

A bucket is read by one task. Patients with so many rows that they alone would
make a bucket long (found by a heavy-hitter sketch) are kept out of the
buckets, in a side table per table whose files are dealt by row;
:meth:`Layout.per_patient` runs an operator on both and unites the results.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ehrflow.functions import scalars as S
from ehrflow.plans.clustering import z_value
from ehrflow.session import drop_path

KEY = "documento_id"
# Columns of the Z-order (the access paths of the reference's secondary indexes).
CLUSTER_COLUMNS = {
    "usuario": [KEY, "correo_electronico", "celular"],
    "atencion": [KEY, "fecha_hora_atencion", "atencion_id"],
    "diagnostico": [KEY, "atencion_id"],
    "tecnologia_salud": [KEY, "atencion_id"],
    "egreso": [KEY, "estado_egreso", "atencion_id"],
}
# Near-unique columns that are looked up by value: no dictionary, a Bloom filter.
BLOOM_COLUMNS = {
    "usuario": ["correo_electronico", "celular"],
    "atencion": ["atencion_id"],
    "diagnostico": ["atencion_id"],
    "tecnologia_salud": ["atencion_id"],
    "egreso": ["atencion_id"],
}
# JSON text that is saved as VARIANT.
VARIANT_COLUMNS = {"usuario": ["datos_adicionales"], "atencion": ["signos_vitales"], "profesional_salud": ["contacto"]}
ORDER = "orden_z"
TRACKED = 1024                      # heavy-hitter sketch: candidates per table
BLOOM_BYTES = 1 << 20               # a Bloom filter (one for each row group and column) at most; held until the file is closed
HEAVY = 2.0                         # a patient is heavy with so many times the rows of an average bucket


@dataclass
class Layout:
    """Catalog names of the saved tables, and of the side tables of heavy
    patients (none if there is no such patient)."""

    names: dict[str, str]
    heavy: dict[str, str] = field(default_factory=dict)
    paths: list[str] = field(default_factory=list)

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The bucketed tables: all patients but the heavy ones."""
        return {k: _read(spark, v) for k, v in self.names.items()}

    def heavy_tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The heavy patients' rows (and whole tables that have no patient)."""
        return {k: _read(spark, self.heavy.get(k, v)) for k, v in self.names.items()}

    def whole(self, spark: SparkSession, name: str) -> DataFrame:
        """All rows of one table, for scans and lookups by other columns."""
        df = _read(spark, self.names[name])
        return df.unionByName(_read(spark, self.heavy[name])) if name in self.heavy else df

    def per_patient(self, spark: SparkSession, operator: Callable[[dict[str, DataFrame]], DataFrame]) -> DataFrame:
        """``operator`` of the tables, for operators whose rows depend on one
        patient each: it runs on the buckets, where joins and aggregations on
        the patient need no shuffle, and on the heavy patients' side tables,
        where they shuffle and adaptive execution splits what is skewed."""
        out = operator(self.tables(spark))
        return out.unionByName(operator(self.heavy_tables(spark))) if self.heavy else out

    def drop(self, spark: SparkSession) -> None:
        """Forget the tables and delete their files."""
        for name in [*self.names.values(), *self.heavy.values()]:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        for path in self.paths:
            drop_path(spark, path)


def _read(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name).drop(ORDER)


def _hashable(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if not ("variant" in t or "map<" in t)]


def heavy_patients(tables: dict[str, DataFrame], buckets: int, heavy: float = HEAVY) -> list:
    """The patients with more than ``heavy`` times a bucket's average of rows
    in any table, from a heavy-hitter sketch of each; there are at most
    ``buckets / heavy`` of them a table."""
    found = set()
    for df in tables.values():
        if KEY in df.columns:
            row = df.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k({KEY}, {min(TRACKED, 2 * buckets)}, {10 * TRACKED})").alias("top")).first()
            found |= {x["item"] for x in row.top or [] if x["count"] > heavy * row.n / buckets and x["item"] is not None}
    return sorted(found)


def _writer(df: DataFrame, name: str, mode: str, location: str | None, row_group_bytes: int | None, bloom_bytes: int):
    w = df.write.mode(mode).format("parquet").option("parquet.bloom.filter.max.bytes", str(bloom_bytes))
    for c in BLOOM_COLUMNS.get(name, []):
        if c in df.columns:
            w = (w.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.adaptive.enabled#{c}", "true")
                 .option(f"parquet.enable.dictionary#{c}", "false"))
    if row_group_bytes:
        w = w.option("parquet.block.size", str(row_group_bytes))
    return w.option("path", location) if location else w


def save_layout(tables: dict[str, DataFrame], buckets: int, database: str = "ehr",
                location: str | None = None, mode: str = "overwrite", suffix: str = "",
                fanout: int = 8, row_group_bytes: int | None = None, bloom_bytes: int = BLOOM_BYTES,
                heavy: float = HEAVY) -> Layout:
    """Save patient-keyed tables bucketed by ``documento_id`` into ``buckets``
    buckets (the same count for all, which is what makes joins local).
    ``location`` places the table files in shared storage
    (``{location}/{table}``).

    Before writing, rows go to the task ``bucket * fanout + salt`` of
    ``buckets * fanout`` (salt from a hash of the row), so a task writes files
    of one bucket rather than of every bucket. Heavy patients' rows
    (:func:`heavy_patients`) are dealt to as many tasks by the whole row."""
    spark = next(iter(tables.values())).sparkSession
    db_loc = f" LOCATION '{location}/_db'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}{db_loc}")
    out = Layout({})
    apart = heavy_patients(tables, buckets, heavy)
    for name, df in tables.items():
        for c in VARIANT_COLUMNS.get(name, []):
            if dict(df.dtypes).get(c) == "string":
                df = df.withColumn(c, S.object_at_rest(c))
        full, place = f"{database}.{name}{suffix}", f"{location}/{name}" if location else None
        out.names[name] = full
        out.paths += [place] if place else []
        if KEY not in df.columns:
            _writer(df, name, mode, place, row_group_bytes, bloom_bytes).saveAsTable(full)
            continue
        columns = [c for c in CLUSTER_COLUMNS.get(name, [KEY]) if c in df.columns]
        df = df.withColumn(ORDER, z_value(df, columns))
        salt = F.xxhash64(*_hashable(df))
        rest = df
        if apart:
            rest = df.filter(F.col(KEY).isNull() | ~F.col(KEY).isin(apart))
            side, at = f"{full}_pesados", f"{place}_pesados" if place else None
            dealt = df.filter(F.col(KEY).isin(apart)).repartition(buckets * max(fanout, 1), salt).sortWithinPartitions(ORDER)
            _writer(dealt, name, mode, at, row_group_bytes, bloom_bytes).saveAsTable(side)
            out.heavy[name] = side
            out.paths += [at] if at else []
        if fanout <= 1:
            rest = rest.repartition(buckets, KEY)              # exactly one bucket per task
        else:                                                   # F.hash is the hash bucketing uses
            bucket = F.pmod(F.hash(KEY), F.lit(buckets))
            rest = rest.repartitionById(buckets * fanout, (bucket * F.lit(fanout) + F.pmod(salt, F.lit(fanout))).cast("int"))
        _writer(rest, name, mode, place, row_group_bytes, bloom_bytes).bucketBy(buckets, KEY).sortBy(ORDER).saveAsTable(full)
    return out


def lookup(df: DataFrame, column: str, values: Sequence | DataFrame) -> DataFrame:
    """The rows of a saved table with one of ``values`` in ``column``: a list
    becomes a filter that row-group statistics and Bloom filters answer before
    anything is read, a table of values a semi join."""
    if isinstance(values, DataFrame):
        return df.join(values.select(F.col(values.columns[0]).alias(column)).distinct(), column, "left_semi")
    return df.filter(F.col(column).isin(list(values)))


def plan_text(df: DataFrame) -> str:
    """The physical plan as ``df.explain()`` prints it."""
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def exchange_count(df: DataFrame) -> int:
    """Number of shuffle exchanges in the physical plan (a co-located join
    shows none)."""
    plan = plan_text(df)
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning")


def scanned_rows(df: DataFrame) -> int:
    """Run ``df`` and return the rows its file scans read: those of the row
    groups (and pages) that were not skipped."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            if name == "FileSourceScanExec":
                total += node.metrics().apply("numOutputRows").value()
            children = node.children()
            todo += [children.apply(i) for i in range(children.length())]
    return total
