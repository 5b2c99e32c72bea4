"""A1/A2: the clinical catalogue as DataFrames with fixed schemas, from
parquet (default) or a JDBC store; creation only when missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ehrflow.sources.schemas import SCHEMAS


def load_tables(spark: SparkSession, path: str | None = None, fmt: str = "parquet",
                names=None, jdbc_url: str | None = None, jdbc_props: dict | None = None,
                jdbc_partitions: int = 64, key_bounds: tuple[int, int] | None = None) -> dict[str, DataFrame]:
    """Read the six tables with their declared schema (nothing is inferred).

    ``fmt="parquet"`` reads ``{path}/{table}``. ``fmt="jdbc"`` reads
    ``hcd.{table}`` from ``jdbc_url``; patient-keyed tables are split into
    ``jdbc_partitions`` parallel range reads on ``documento_id`` when
    ``key_bounds`` is given.
    """
    out = {}
    for name in names or SCHEMAS:
        schema = SCHEMAS[name]
        if fmt == "jdbc":
            props = dict(jdbc_props or {})
            table = f"hcd.{name}"
            if key_bounds and "documento_id" in schema.fieldNames():
                df = spark.read.jdbc(jdbc_url, table, column="documento_id", lowerBound=key_bounds[0],
                                     upperBound=key_bounds[1], numPartitions=jdbc_partitions,
                                     properties=props)
            else:
                df = spark.read.jdbc(jdbc_url, table, properties=props)
            out[name] = df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])
        else:
            out[name] = spark.read.schema(schema).format(fmt).load(f"{path}/{name}")
    return out


def create_tables(spark: SparkSession, path: str | None = None, fmt: str = "parquet",
                  database: str | None = None) -> None:
    """Create every missing table as an empty dataset; existing ones are left
    untouched (``CREATE TABLE IF NOT EXISTS``). With ``database`` the tables
    are created in the session catalog (``saveAsTable``, mode ``ignore``),
    placed under ``path`` when given; otherwise as files under ``path``."""
    if database:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, schema in SCHEMAS.items():
        w = spark.createDataFrame([], schema).write.mode("ignore").format(fmt)
        if database:
            if path:
                w = w.option("path", f"{path}/{name}")
            w.saveAsTable(f"{database}.{name}")
        else:
            w.save(f"{path}/{name}")


def save_tables(tables: dict[str, DataFrame], path: str, mode: str = "append", fmt: str = "parquet") -> None:
    """Write tables to ``{path}/{table}`` conformed to the declared schema."""
    for name, df in tables.items():
        schema = SCHEMAS[name]
        df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields]) \
            .write.mode(mode).format(fmt).save(f"{path}/{name}")
