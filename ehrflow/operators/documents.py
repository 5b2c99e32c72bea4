"""Per-patient unified history documents, rendered as text in bulk.

The reference renders one patient at a time to a PDF; here every patient's
document is built in one job. Each encounter is rendered to a text block
on its own row first (narrow rows), and only the rendered blocks are
gathered per patient and calendar month, newest first. A document is its
header part and a part for each month with encounters, so a patient with very
many encounters is written by many tasks and no row grows without bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ehrflow.functions import scalars as S
from ehrflow.operators.history import month_of, with_professional

# Vitals shown in the document, with label and unit.
VITALS = [
    ("ta", "P. Arterial", ""),
    ("fc", "F. Cardíaca", ""),
    ("fr", "F. Resp.", ""),
    ("temp", "Temp.", "°"),
    ("sat", "Sat O2", "%"),
    ("peso", "Peso", "kg"),
]
NO_RECORDS = "No existen registros de atención."


def with_vital_texts(df: DataFrame, text: str) -> DataFrame:
    """Adds ``_vt_{key}`` for every shown vital, read from the vitals JSON
    text: the value as the template prints it, NULL when the template would
    skip it (missing, null, 0, '', false). Integers print without a
    fraction, other numbers as doubles, text as is, true as ``True``.

    The text is parsed once into a struct of per-key variants
    (:func:`ehrflow.functions.scalars.vitals_struct`); each key's JSON type
    comes from its own small variant. Built in narrow projections so every
    expression is evaluated once and the generated code stays small."""
    keys = [k for k, _, _ in VITALS]
    df = df.select("*", S.vitals_struct(F.col(text), keys).alias("_vx"))
    df = df.select("*", *[F.regexp_extract(F.schema_of_variant(F.col("_vx")[k]), "^([A-Z]+)", 1).alias(f"_vk_{k}")
                          for k in keys])
    cols = []
    for k in keys:
        sub, kind = F.col("_vx")[k], F.col(f"_vk_{k}")
        text_value = F.try_variant_get(sub, "$", "string")
        as_double = F.try_variant_get(sub, "$", "double")
        numeric = kind.isin("TINYINT", "SMALLINT", "INT", "BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
        fractional = kind.isin("DECIMAL", "DOUBLE", "FLOAT")
        truthy = (F.when(kind == "STRING", text_value != "")
                  .when(kind == "BOOLEAN", text_value == "true")
                  .when(kind.isin("OBJECT", "ARRAY"), ~text_value.isin("{}", "[]"))
                  .when(numeric, as_double != 0)
                  .otherwise(F.lit(False)))
        shown = (F.when(kind == "BOOLEAN", F.lit("True"))
                 .when(fractional, as_double.cast("string"))
                 .otherwise(text_value))
        cols.append(F.when(F.coalesce(truthy, F.lit(False)), shown).alias(f"_vt_{k}"))
    return df.select("*", *cols).drop("_vx", *[f"_vk_{k}" for k in keys])


def encounter_block() -> Column:
    """One encounter rendered as text lines (newline separated); expects the
    ``_vt_*`` columns of :func:`with_vital_texts`."""
    shown = [F.when(F.col(f"_vt_{k}").isNotNull(),
                    F.concat(F.lit(lbl + ": "), S.with_unit(F.col(f"_vt_{k}"), unit)))
             for k, lbl, unit in VITALS]
    vitals_line = F.concat_ws("; ", *shown)
    history_any = S.any_present("antecedentes_personales", "antecedentes_familiares",
                                "medicamentos_actuales", "alergias_conocidas")
    exam_any = S.any_present("examen_fisico_general", "examen_fisico_por_sistemas")
    lines = [
        F.concat(F.lit("== "), S.fmt("fecha_hora_local", "header"), F.lit(" "), S.none_text(F.col("tipo_atencion"))),
        F.when(vitals_line != "", F.concat(F.lit("VITALES: "), vitals_line)),
        F.concat(F.lit("Motivo: "), S.none_text(F.col("motivo_consulta"))),
        F.when(S.any_present("enfermedad_actual"),
               F.concat(F.lit("Enfermedad Actual: "), F.col("enfermedad_actual"))),
        F.when(history_any, F.concat(
            F.lit("ANTECEDENTES: personales "), S.falsy_or("antecedentes_personales", "Niega"),
            F.lit("; alergias "), S.falsy_or("alergias_conocidas", "Niega"),
            F.lit("; familiares "), S.falsy_or("antecedentes_familiares", "No refiere"),
            F.lit("; farmacologicos "), S.falsy_or("medicamentos_actuales", "No refiere"))),
        F.when(exam_any, F.concat_ws("; ",
            F.when(S.any_present("examen_fisico_general"), F.concat(F.lit("General "), F.col("examen_fisico_general"))),
            F.when(S.any_present("examen_fisico_por_sistemas"),
                   F.concat(F.lit("Por Sistemas "), F.col("examen_fisico_por_sistemas"))))),
        F.concat(F.lit("DX: "), S.none_text(F.col("impresion_diagnostica"))),
        F.when(S.join_codes("codigos_cie10").isNotNull(), F.concat(F.lit("CIE10: "), S.join_codes("codigos_cie10"))),
        F.concat(F.lit("PLAN: "), S.none_text(F.col("conducta_plan_manejo"))),
        F.concat(F.lit("FIRMA: Dr/a. "), S.none_text(F.col("profesional_nombre"))),
    ]
    return F.concat_ws("\n", *lines)


def patient_header(as_of_utc) -> Column:
    """Demographic header of the document."""
    stamp = S.fmt(S.to_local(S.ntz_lit(as_of_utc)), "stamp")
    lines = [
        F.lit("HISTORIA CLINICA UNIFICADA"),
        F.concat(F.lit("PACIENTE: "), S.full_name("primer_nombre", "segundo_nombre", "primer_apellido", "segundo_apellido"),
                 F.lit(" | DOCUMENTO: "), S.none_text(F.col("tipo_documento")), F.lit(" "),
                 F.col("documento_id").cast("string")),
        F.concat(F.lit("EDAD: "), S.falsy_or_number("edad", "--"), F.lit(" años ("),
                 S.none_text(F.col("fecha_nacimiento")), F.lit(") | GÉNERO: "), S.falsy_or("genero", "--")),
        F.concat(F.lit("RH: "), S.falsy_or("grupo_sanguineo", ""), F.lit(" "), S.falsy_or("factor_rh", ""),
                 F.lit(" | ESTADO CIVIL: "), S.falsy_or("estado_civil", "--")),
        F.concat(F.lit("DIRECCIÓN: "), S.falsy_or("direccion_residencia", "--"), F.lit(" - "),
                 S.falsy_or("municipio_ciudad", "")),
        F.concat(F.lit("CONTACTO: "), S.coalesce_falsy("celular", "telefono", default="--"),
                 F.lit(" | EMAIL: "), S.falsy_or("correo_electronico", "--")),
        F.concat(F.lit("ENTIDAD: "), S.falsy_or("entidad_afiliacion", "PARTICULAR"),
                 F.lit(" | RÉGIMEN: "), S.falsy_or("regimen_afiliacion", "--")),
        F.concat(F.lit("IMPRESO: "), stamp),
    ]
    return F.concat_ws("\n", *lines)


def history_documents(patients: DataFrame, encounters: DataFrame, professionals: DataFrame,
                      as_of_utc, ext: str = "pdf") -> DataFrame:
    """(documento_id, mes, archivo, cuerpo) for every patient: the header
    part with ``mes`` NULL (which says so when there are no encounters), and
    one part per month with encounters. The parts of ``archivo``, header
    first and then the months from the newest on, joined by line breaks, are
    the document; every patient's has this shape.

    ``patients`` should already carry the displayed age (see
    :func:`ehrflow.operators.history.patient_view`). Encounters use the
    export name policy and local time.
    """
    archivo = S.export_name("documento_id", S.to_local(S.ntz_lit(as_of_utc)), ext).alias("archivo")
    with_any = encounters.select("documento_id", F.lit(True).alias("_any")).distinct()
    heads = patients.join(with_any, "documento_id", "left").select(
        "documento_id", F.lit(None).cast("date").alias("mes"), archivo,
        F.concat_ws("\n", patient_header(as_of_utc), F.when(F.col("_any").isNull(), F.lit(NO_RECORDS))).alias("cuerpo"))
    enc = encounters.withColumn("fecha_hora_local", S.to_local("fecha_hora_atencion"))
    enc = with_vital_texts(with_professional(enc, professionals, policy="export"), "signos_vitales")
    blocks = enc.select("documento_id", "atencion_id", "fecha_hora_atencion", encounter_block().alias("_block"))
    known = patients.select(F.bitwise_not("documento_id").alias("_key"))      # a key of its own: see patient_history_rows
    bodies = (blocks.withColumn("_key", F.bitwise_not("documento_id")).join(known, "_key", "left_semi")
              .groupBy("documento_id", month_of("fecha_hora_atencion").alias("mes"))
              .agg(F.sort_array(F.collect_list(F.struct("fecha_hora_atencion", "atencion_id", "_block")),
                                asc=False).alias("_bl"))
              .select("documento_id", "mes", archivo, F.array_join(F.col("_bl")["_block"], "\n").alias("cuerpo")))
    return heads.unionByName(bodies)
