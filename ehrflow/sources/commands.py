"""Typed JSON-lines commands (new patient, patch, new encounter).

Records that do not fit the command schema are kept apart with a reason
instead of failing the job, like the API's 422 answers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ehrflow.sources import fields
from ehrflow.sources.schemas import (ATENCION_LENGTHS, ENCOUNTER_OPTIONAL, ENCOUNTER_REQUIRED, PATIENT_REQUIRED,
                                     PUBLIC_PATIENT_FIELDS, USUARIO, USUARIO_LENGTHS)

NEW_PATIENT = T.StructType(
    [USUARIO[f] for f in PUBLIC_PATIENT_FIELDS if f != "tipo_usuario"]
    + [T.StructField("hashed_password", T.StringType()), T.StructField("seq", T.LongType())])

NEW_ENCOUNTER = T.StructType(
    [T.StructField("documento_id", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ENCOUNTER_REQUIRED if c != "documento_id"]
    + [T.StructField(c, T.ArrayType(T.StringType()) if c == "codigos_cie10" else T.StringType())
       for c in ENCOUNTER_OPTIONAL]
    + [T.StructField("clinician_id", T.LongType()), T.StructField("seq", T.LongType())])

PATCH = T.StructType([T.StructField("documento_id", T.LongType()), T.StructField("seq", T.LongType()),
                      T.StructField("patch", T.StringType())])

KINDS = {"patient": (NEW_PATIENT, PATIENT_REQUIRED), "encounter": (NEW_ENCOUNTER, ENCOUNTER_REQUIRED),
         "patch": (PATCH, ["documento_id"])}


# Fixed value: the reason of a line without a required field.
MISSING = "requerido"

# How each field is read (:mod:`ehrflow.sources.fields`).
_PATIENT_KINDS = {f: {"documento_id": "long", "fecha_nacimiento": "date", "edad": "int", "seq": "long"}.get(f, "text")
                  for f in NEW_PATIENT.fieldNames()}
_ENCOUNTER_KINDS = {f: {"documento_id": "long", "clinician_id": "long", "seq": "long", "codigos_cie10": "codes",
                        "signos_vitales": "any"}.get(f, "text") for f in NEW_ENCOUNTER.fieldNames()}
_LIMITS = {"patient": USUARIO_LENGTHS, "encounter": ATENCION_LENGTHS, "patch": {}}


def tagged(lines: DataFrame, kind: str) -> DataFrame:
    """Lines of JSON (column ``linea``; a table or a stream) with the fields
    of the command and ``motivo``, the reason a line is refused (else NULL):
    ``json`` (not a JSON object), ``tipo_invalido`` (a value of the wrong
    type), ``longitud`` (text over its limit) or ``requerido`` (a required
    field, ``seq`` among them, absent or null). Fields that can be read are
    there on refused lines, too. For patches only the key and the sequence
    are read; ``patch`` is the line as it came."""
    schema, required = KINDS[kind]
    kinds = {"patient": _PATIENT_KINDS, "encounter": _ENCOUNTER_KINDS, "patch": {"documento_id": "long", "seq": "long"}}[kind]
    read = fields.read(lines.select("linea"), "linea", kinds, _LIMITS[kind])
    missing = " OR ".join(f"_v_{c} IS NULL" for c in [*required, "seq"])

    def column(f: T.StructField) -> str:
        if kind == "patch" and f.name == "patch":
            return "linea AS patch"
        if isinstance(f.dataType, T.ArrayType):
            return f"from_json(_v_{f.name}, '{f.dataType.simpleString()}') AS {f.name}"
        return f"CAST(_v_{f.name} AS {f.dataType.simpleString()}) AS {f.name}"

    return read.selectExpr("linea", f"coalesce(_why, CASE WHEN {missing} THEN '{MISSING}' END) AS motivo", *[column(f) for f in schema.fields])


def read_commands(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """Read JSON-lines commands of ``kind`` ('patient', 'encounter', 'patch').

    Returns ``(accepted, rejected)``; rejected rows are (linea, motivo), with
    the reasons of :func:`tagged`. An absent key of a patch differs from an
    explicit null (:func:`ehrflow.operators.writes.patch_patients` reads the
    line).
    """
    schema, _ = KINDS[kind]
    lines = tagged(spark.read.text(path).select(F.col("value").alias("linea")), kind)
    return (lines.filter(F.col("motivo").isNull()).select(*schema.fieldNames()),
            lines.filter(F.col("motivo").isNotNull()).select("linea", "motivo"))


def write_commands(df: DataFrame, path: str) -> None:
    """Write commands as JSON lines (nulls kept, so absent ≠ null)."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
