"""A3: seed tables from literal rows.

Rows are given per table as dicts. Each table is conformed to its declared
schema, column defaults are applied (random UUID keys, ``created_at`` /
``updated_at`` = ``as_of``, ``unidades_aplicadas`` = 0), an encounter may
name its professional (``profesional_nombre``) instead of giving the key —
resolved like the seed script's ``(SELECT id ... WHERE nombre = x LIMIT 1)``
— and an encounter time may be given as ``dias_atras`` (``now() - interval
'n days'``). Professionals have no natural key, so seeding twice duplicates
them, as in the reference; the other tables are insert-or-ignore on their
keys: of rows with one key the first stays.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ehrflow.functions import scalars as S
from ehrflow.operators.history import resolve_fk
from ehrflow.operators.writes import insert_or_ignore
from ehrflow.sources.schemas import PRIMARY_KEYS, SCHEMAS

_UUID_KEYS = {"profesional_salud": "id_personal_salud", "atencion": "atencion_id", "diagnostico": "diagnostico_id",
              "tecnologia_salud": "tecnologia_id", "egreso": "egreso_id"}
_EXTRA = {"atencion": [T.StructField("profesional_nombre", T.StringType()),
                       T.StructField("dias_atras", T.IntegerType())]}


def _frame(spark: SparkSession, name: str, rows: list[dict]) -> DataFrame:
    schema = T.StructType(list(SCHEMAS[name].fields) + _EXTRA.get(name, []))
    # JSON columns may be given as Python objects; store their JSON text.
    import json
    fixed = []
    for r in rows:
        fixed.append({k: (json.dumps(v, ensure_ascii=False) if isinstance(v, (dict, list)) and
                          schema[k].dataType == T.StringType() else v) for k, v in r.items()})
    nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
    return spark.createDataFrame([tuple(r.get(f.name) for f in nullable.fields) for r in fixed], nullable)


def seed_tables(spark: SparkSession, rows: dict[str, list[dict]], as_of_utc: _dt.datetime,
                current: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Build the seeded tables (unioned with ``current`` when given)."""
    as_of = S.ntz_lit(as_of_utc)
    out: dict[str, DataFrame] = dict(current or {})
    order = ["profesional_salud", "usuario", "atencion", "diagnostico", "tecnologia_salud", "egreso"]
    for name in order:
        if name not in rows:
            continue
        df = _frame(spark, name, rows[name])
        key = _UUID_KEYS.get(name)
        if key:
            df = df.withColumn(key, F.coalesce(F.col(key), S.random_key()))
        for stamp in ("created_at", "updated_at"):
            if stamp in df.columns:
                df = df.withColumn(stamp, F.coalesce(F.col(stamp), as_of))
        if name == "tecnologia_salud":
            df = df.withColumn("unidades_aplicadas", F.coalesce(F.col("unidades_aplicadas"), F.lit(0)))
        if name == "atencion":
            df = df.withColumn("fecha_hora_atencion", F.coalesce(
                F.col("fecha_hora_atencion"), S.days_before(as_of, F.coalesce(F.col("dias_atras"), F.lit(0)))))
            if "profesional_salud" in out:
                df = resolve_fk(df, out["profesional_salud"], "profesional_nombre", "nombre_completo",
                                "id_personal_salud", "_pid")
                df = df.withColumn("profesional_responsable", F.coalesce(F.col("profesional_responsable"), F.col("_pid")))
            df = df.drop("profesional_nombre", "dias_atras", "_pid")
        df = df.select(*SCHEMAS[name].fieldNames())
        if name in out:
            if name == "profesional_salud":
                out[name] = out[name].unionByName(df)
            else:
                out[name] = insert_or_ignore(out[name], df.withColumn("_orden", F.monotonically_increasing_id()), PRIMARY_KEYS[name], "_orden")[0]
        elif name == "profesional_salud":
            out[name] = df
        else:
            ordered = df.withColumn("_orden", F.monotonically_increasing_id())
            out[name] = insert_or_ignore(df.limit(0), ordered, PRIMARY_KEYS[name], "_orden")[0]
    return out


def seed_if_empty(spark: SparkSession, tables: dict[str, DataFrame], rows: dict[str, list[dict]],
                  as_of_utc: _dt.datetime) -> tuple[dict[str, DataFrame], bool]:
    """The loader's guard: seed only when the patient table holds no row yet
    (a one-row probe, not a full count). Returns the tables and whether
    seeding happened."""
    if tables["usuario"].limit(1).count() > 0:
        return tables, False
    return seed_tables(spark, rows, as_of_utc, current=tables), True
