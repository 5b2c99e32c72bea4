"""K2/K3 and the H rules in plain SQL: views, a session variable for the
principal, and SQL functions.

:func:`install` registers the tables of a session as views that hold the rules,
so a SQL user sees what the principal may see and nothing else. The principal
is the session variable ``principal`` (``SET VAR principal = 10``); the views
are unfolded when they are read, so they follow it. The functions are SQL
expressions that Catalyst unfolds, too: filters reach the scans through views
and functions, and unused columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ehrflow.functions.scalars import LOCAL_ZONE
from ehrflow.sources.schemas import PUBLIC_ENCOUNTER_FIELDS, PUBLIC_PATIENT_FIELDS

# name and arguments, type, expression
FUNCTIONS = [
    ("edad_en(nacimiento DATE, hoy DATE)", "INT",
     "year(hoy) - year(nacimiento) - CAST(month(hoy) < month(nacimiento) OR (month(hoy) = month(nacimiento) AND day(hoy) < day(nacimiento)) AS INT)"),
    ("edad_mostrada(nacimiento DATE, guardada INT, hoy DATE)", "INT", "coalesce(edad_en(nacimiento, hoy), guardada)"),
    ("hora_local(hora TIMESTAMP_NTZ)", "TIMESTAMP_NTZ", f"convert_timezone('UTC', '{LOCAL_ZONE}', hora)"),
    ("texto_o(texto STRING, defecto STRING)", "STRING", "coalesce(nullif(texto, ''), defecto)"),
    ("primer_texto(uno STRING, otro STRING, defecto STRING)", "STRING", "coalesce(nullif(uno, ''), nullif(otro, ''), defecto)"),
    ("firma(nombre STRING, apellido STRING)", "STRING", "'Dr. ' || coalesce(nombre, 'None') || ' ' || coalesce(apellido, 'None')"),
    ("capitalizar(texto STRING)", "STRING", "upper(substr(texto, 1, 1)) || lower(substr(texto, 2))"),
    ("unir_codigos(codigos ARRAY<STRING>)", "STRING", "CASE WHEN size(codigos) > 0 THEN array_join(codigos, ', ') END"),
    ("fecha_iso(texto STRING)", "STRING", "split_part(texto, 'T', 1)"),
    ("dias_antes(hora TIMESTAMP_NTZ, dias INT)", "TIMESTAMP_NTZ", "hora - make_dt_interval(dias)"),
]

_ROLE = "(SELECT max(tipo_usuario) FROM ehr_usuario WHERE documento_id = principal)"
# the row rule of exports and pages: a clinician sees all, a patient their own record, other roles none
_ROW_RULE = f"coalesce({_ROLE} = 'medico' OR ({_ROLE} = 'paciente' AND documento_id = principal), false)"


def _views(patients: list[str], encounters: list[str]) -> dict[str, str]:
    public = [c for c in PUBLIC_PATIENT_FIELDS if c in patients]
    shown = [c for c in PUBLIC_ENCOUNTER_FIELDS if c in encounters]
    contact = [f"CASE WHEN {_ROLE} IN ('medico', 'admisionista') OR documento_id = principal THEN {c} END AS {c}" if c in ("correo_electronico", "celular", "telefono") else c
               for c in public]
    return {
        # admissions: demographics of all patients, never the password hash
        "pacientes_admision": f"SELECT {', '.join(public)} FROM ehr_usuario",
        # what the principal may see of the patients, contacts masked for others
        "mis_pacientes": f"SELECT {', '.join(contact)} FROM ehr_usuario WHERE {_ROW_RULE}",
        "mis_atenciones": f"SELECT documento_id, {', '.join(shown)} FROM ehr_atencion WHERE {_ROW_RULE}",
    }


_EXPORTS = """SELECT s.solicitud_id, s.principal_id, s.documento_id, u.tipo_usuario AS rol
FROM ehr_solicitudes s JOIN ehr_usuario u ON u.documento_id = s.principal_id
WHERE s.accion = 'exportar' AND (u.tipo_usuario = 'medico' OR (u.tipo_usuario = 'paciente' AND s.principal_id = s.documento_id))"""


def install(spark: SparkSession, tables: dict[str, DataFrame]) -> list[str]:
    """Declare the variable, the functions and the views for this session:
    from ``usuario``, ``atencion`` and, if given, ``solicitudes`` (requests).
    Returns the names of the views."""
    spark.sql("DECLARE OR REPLACE VARIABLE principal BIGINT DEFAULT NULL")
    for head, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    for name, df in tables.items():
        df.createOrReplaceTempView(f"ehr_{name}")
    views = _views(tables["usuario"].columns, tables["atencion"].columns)
    if "solicitudes" in tables:
        views["exportaciones_visibles"] = _EXPORTS
    for name, text in views.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {name} AS {text}")
    return list(views)
