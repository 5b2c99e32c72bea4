"""The driver's star-schema tables seen as the clinical model.

customer -> usuario (patients and staff logins), orders -> atencion
(encounters), lineitem -> tecnologia_salud (child rows on the composite
key), supplier -> profesional_salud, events -> logins and requests.

Every derived column is a deterministic expression of the source row, so
the work grows with the tables. Each mapping exists twice: as DataFrame
expressions (used by the queries) and as a DuckDB CTE (used only by the
oracle SQL in :mod:`ehrflow.plans.catalog`). Keep the two in step.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ehrflow.functions import scalars as S

# Fixed parameters of the driver queries: "today" in local time, the print
# stamp instant (UTC wall time) and the token lifetime.
AS_OF_DATE = _dt.date(2024, 1, 31)
AS_OF_UTC = _dt.datetime(2024, 1, 31, 15, 30, 0)
TOKEN_TTL_MINUTES = 30

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, in the splits that Spark makes of its files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def model(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The clinical view of the driver tables: 'patients', 'encounters',
    'professionals' or 'technologies'."""
    builders = {
        "patients": lambda: patients(read(spark, sf_dir, "customer")),
        "encounters": lambda: encounters(read(spark, sf_dir, "orders")),
        "professionals": lambda: professionals(read(spark, sf_dir, "supplier")),
        "technologies": lambda: technologies(read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")),
    }
    return builders[name]()


def _s(c: Column) -> Column:
    return c.cast("string")


def _cat(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


# ------------------------------------------------------------- patients ---

def patients(customer: DataFrame) -> DataFrame:
    k, nk, seg, bal = F.col("c_custkey"), F.col("c_nationkey"), F.col("c_mktsegment"), F.col("c_acctbal")
    return customer.select(
        k.alias("documento_id"),
        F.lit("CC").alias("tipo_documento"),
        seg.alias("primer_apellido"),
        F.when(nk % 3 == 0, None).when(nk % 3 == 1, "").otherwise(_cat("N", _s(nk))).alias("segundo_apellido"),
        F.col("c_name").alias("primer_nombre"),
        F.when(k % 4 == 0, None).otherwise(_cat("R", _s(k % 4))).alias("segundo_nombre"),
        F.date_add(F.lit(_dt.date(1930, 1, 1)), ((k * 7919) % 32000).cast("int")).alias("fecha_nacimiento"),
        F.floor(F.abs(bal) / 100).cast("int").alias("edad"),
        F.when(k % 2 == 0, "M").otherwise("F").alias("sexo"),
        F.when(k % 3 == 0, None).otherwise("Femenino").alias("genero"),
        F.when(k % 4 == 0, "O").when(k % 4 == 1, "A").when(k % 4 == 2, "B").otherwise("AB").alias("grupo_sanguineo"),
        F.when(k % 5 == 0, "-").otherwise("+").alias("factor_rh"),
        F.when(nk % 2 == 0, "Soltero").otherwise("Casado").alias("estado_civil"),
        _cat("Calle ", _s(nk), " # ", _s(k)).alias("direccion_residencia"),
        _cat("Ciudad ", _s(nk)).alias("municipio_ciudad"),
        F.lit(None).cast("string").alias("departamento"),
        F.when(k % 5 == 0, None).otherwise(_cat("60", _s(k))).alias("telefono"),
        F.when(k % 3 == 0, None).when(k % 3 == 1, "").otherwise(_cat("3", F.lpad(_s(k), 9, "0"))).alias("celular"),
        F.when(seg == "HOUSEHOLD", None)
         .when(k % 10 == 0, _cat(F.lower(seg), ".", _s(nk), "@hce.test"))
         .otherwise(_cat("p", _s(k), "@hce.test")).alias("correo_electronico"),
        _cat("h$", _s(k)).alias("hashed_password"),
        F.lit(None).cast("string").alias("ocupacion"),
        F.when(bal > 5000, _cat("EPS ", _s(nk))).alias("entidad_afiliacion"),
        F.when(bal < 0, "Subsidiado").otherwise("Contributivo").alias("regimen_afiliacion"),
        F.when(seg == "MACHINERY", "medico").when(seg == "BUILDING", "admisionista")
         .when(seg == "AUTOMOBILE", None).otherwise("paciente").alias("tipo_usuario"),
        F.lit(None).cast("string").alias("datos_adicionales"),
        F.lit(None).cast("timestamp_ntz").alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("updated_at"),
    )


PATIENTS_SQL = """
patients AS (
  SELECT c_custkey AS documento_id, 'CC' AS tipo_documento, c_mktsegment AS primer_apellido,
    CASE c_nationkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'N' || c_nationkey END AS segundo_apellido,
    c_name AS primer_nombre,
    CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'R' || (c_custkey % 4) END AS segundo_nombre,
    DATE '1930-01-01' + CAST((c_custkey * 7919) % 32000 AS INTEGER) AS fecha_nacimiento,
    CAST(floor(abs(c_acctbal) / 100) AS INTEGER) AS edad,
    CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS sexo,
    CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'Femenino' END AS genero,
    CASE c_custkey % 4 WHEN 0 THEN 'O' WHEN 1 THEN 'A' WHEN 2 THEN 'B' ELSE 'AB' END AS grupo_sanguineo,
    CASE WHEN c_custkey % 5 = 0 THEN '-' ELSE '+' END AS factor_rh,
    CASE WHEN c_nationkey % 2 = 0 THEN 'Soltero' ELSE 'Casado' END AS estado_civil,
    'Calle ' || c_nationkey || ' # ' || c_custkey AS direccion_residencia,
    'Ciudad ' || c_nationkey AS municipio_ciudad,
    CAST(NULL AS VARCHAR) AS departamento,
    CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE '60' || c_custkey END AS telefono,
    CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE '3' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') END AS celular,
    CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN NULL
         WHEN c_custkey % 10 = 0 THEN lower(c_mktsegment) || '.' || c_nationkey || '@hce.test'
         ELSE 'p' || c_custkey || '@hce.test' END AS correo_electronico,
    'h$' || c_custkey AS hashed_password,
    CAST(NULL AS VARCHAR) AS ocupacion,
    CASE WHEN c_acctbal > 5000 THEN 'EPS ' || c_nationkey END AS entidad_afiliacion,
    CASE WHEN c_acctbal < 0 THEN 'Subsidiado' ELSE 'Contributivo' END AS regimen_afiliacion,
    CASE c_mktsegment WHEN 'MACHINERY' THEN 'medico' WHEN 'BUILDING' THEN 'admisionista'
         WHEN 'AUTOMOBILE' THEN NULL ELSE 'paciente' END AS tipo_usuario
  FROM customer
)"""


# ----------------------------------------------------------- encounters ---

def encounter_time(orders: DataFrame | None = None) -> Column:
    k = F.col("o_orderkey")
    return F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), (k % 1440).cast("int"))


def encounters(orders: DataFrame) -> DataFrame:
    k, st, pr = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")
    vitals = (F.when(k % 11 == 0, "no es json").when(k % 13 == 0, "").when(k % 17 == 0, None)
              .otherwise(_cat('{"ta":"1', _s(k % 4 + 1), '0/80","fc":', _s(k % 100), ',"temp":"3',
                              _s(6 + k % 3), '.5","sat":', _s(90 + k % 10), "}")))
    codes = _cat("I", _s(k % 50), ", E11.", _s(k % 10), F.when(k % 9 == 0, ",").otherwise(""))
    null = F.lit(None).cast("string")
    return orders.select(
        _s(k).alias("atencion_id"),
        F.col("o_custkey").alias("documento_id"),
        encounter_time().alias("fecha_hora_atencion"),
        pr.alias("tipo_atencion"),
        _cat("Motivo ", st).alias("motivo_consulta"),
        F.when(st == "F", None).otherwise(_cat("Evolucion ", _s(k))).alias("enfermedad_actual"),
        F.when(k % 3 == 0, None).when(k % 3 == 1, "").otherwise("HTA").alias("antecedentes_personales"),
        F.when(k % 4 == 0, "DM2").alias("antecedentes_familiares"),
        F.when(k % 6 == 0, "Penicilina").alias("alergias_conocidas"),
        null.alias("habitos"),
        null.alias("medicamentos_actuales"),
        vitals.alias("signos_vitales"),
        F.when(k % 2 == 0, "Normal").alias("examen_fisico_general"),
        null.alias("examen_fisico_por_sistemas"),
        _cat("Dx ", pr).alias("impresion_diagnostica"),
        S.split_codes(codes).alias("codigos_cie10"),
        _cat("Plan ", st).alias("conducta_plan_manejo"),
        *[null.alias(c) for c in ("recomendaciones_paciente", "medicos_interconsultados",
                                  "procedimientos_realizados", "resultados_paraclinicos",
                                  "diagnostico_definitivo", "evolucion_medica", "tratamiento_instaurado",
                                  "formulacion_medica", "educacion_consejeria",
                                  "referencia_contrarreferencia")],
        F.when(st == "F", "Ambulatorio").when(st == "O", "Hospitalizado").alias("estado_egreso"),
        F.when(k % 7 == 0, None).when(k % 7 == 1, _cat("x", _s(k % 50)))
         .otherwise(_s(k % 97)).alias("profesional_responsable"),
        null.alias("firma_paciente_path"),
        F.lit(None).cast("timestamp_ntz").alias("fecha_hora_cierre"),
        F.when(k % 5 == 0, None).when(k % 5 == 1, "")
         .otherwise(_cat("Dr. Reg ", _s(F.col("o_custkey") % 17))).alias("responsable_registro"),
        F.lit(None).cast("timestamp_ntz").alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("updated_at"),
    )


ENCOUNTERS_SQL = """
encounters AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS atencion_id, o_custkey AS documento_id,
    o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS INTEGER)) AS fecha_hora_atencion,
    o_orderpriority AS tipo_atencion, 'Motivo ' || o_orderstatus AS motivo_consulta,
    CASE WHEN o_orderstatus = 'F' THEN NULL ELSE 'Evolucion ' || o_orderkey END AS enfermedad_actual,
    CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'HTA' END AS antecedentes_personales,
    CASE WHEN o_orderkey % 4 = 0 THEN 'DM2' END AS antecedentes_familiares,
    CASE WHEN o_orderkey % 6 = 0 THEN 'Penicilina' END AS alergias_conocidas,
    CAST(NULL AS VARCHAR) AS medicamentos_actuales,
    CASE WHEN o_orderkey % 11 = 0 THEN 'no es json' WHEN o_orderkey % 13 = 0 THEN ''
         WHEN o_orderkey % 17 = 0 THEN NULL
         ELSE '{"ta":"1' || (o_orderkey % 4 + 1) || '0/80","fc":' || (o_orderkey % 100)
              || ',"temp":"3' || (6 + o_orderkey % 3) || '.5","sat":' || (90 + o_orderkey % 10) || '}' END
      AS signos_vitales,
    CASE WHEN o_orderkey % 2 = 0 THEN 'Normal' END AS examen_fisico_general,
    CAST(NULL AS VARCHAR) AS examen_fisico_por_sistemas,
    'Dx ' || o_orderpriority AS impresion_diagnostica,
    list_transform(string_split('I' || (o_orderkey % 50) || ', E11.' || (o_orderkey % 10)
                                || CASE WHEN o_orderkey % 9 = 0 THEN ',' ELSE '' END, ','), lambda x: trim(x))
      AS codigos_cie10,
    'Plan ' || o_orderstatus AS conducta_plan_manejo,
    CASE o_orderstatus WHEN 'F' THEN 'Ambulatorio' WHEN 'O' THEN 'Hospitalizado' END AS estado_egreso,
    CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'x' || (o_orderkey % 50)
         ELSE CAST(o_orderkey % 97 AS VARCHAR) END AS profesional_responsable,
    CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'Dr. Reg ' || (o_custkey % 17) END
      AS responsable_registro
  FROM orders
)"""


# -------------------------------------------------------- professionals ---

def professionals(supplier: DataFrame) -> DataFrame:
    k = F.col("s_suppkey")
    return supplier.select(
        _s(k).alias("id_personal_salud"),
        F.when(k % 10 == 3, None).otherwise(F.col("s_name")).alias("nombre_completo"),
        F.lit("Medico").alias("tipo_profesional"),
        _cat("RM-", _s(k)).alias("registro_profesional"),
        _cat("Nacion ", _s(F.col("s_nationkey"))).alias("cargo_servicio"),
        F.lit(None).cast("string").alias("firma_path"),
        S.json_object(telefono=_s(k), email=_cat("s", _s(k), "@hce.test")).alias("contacto"),
        F.lit(None).cast("timestamp_ntz").alias("created_at"),
    )


PROFESSIONALS_SQL = """
professionals AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS id_personal_salud,
    CASE WHEN s_suppkey % 10 = 3 THEN NULL ELSE s_name END AS nombre_completo,
    'Medico' AS tipo_profesional, 'RM-' || s_suppkey AS registro_profesional,
    'Nacion ' || s_nationkey AS cargo_servicio
  FROM supplier
)"""


# ------------------------------------------------- child rows (lineitem) ---

def technologies(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """tecnologia_salud rows; the patient key comes from the parent order."""
    parent = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("documento_id"))
    li = lineitem.join(parent, "l_orderkey", "inner")
    return li.select(
        _cat(_s(F.col("l_orderkey")), "-", _s(F.col("l_linenumber"))).alias("tecnologia_id"),
        _s(F.col("l_orderkey")).alias("atencion_id"),
        "documento_id",
        _cat("Med ", _s(F.col("l_partkey"))).alias("descripcion_medicamento"),
        F.lit(None).cast("string").alias("dosis"),
        F.lit("oral").alias("via_administracion"),
        F.lit(None).cast("string").alias("frecuencia"),
        F.col("l_quantity").cast("int").alias("dias_tratamiento"),
        F.lit(0).alias("unidades_aplicadas"),
        _s(F.col("l_suppkey")).alias("id_personal_salud"),
        F.col("l_returnflag").alias("finalidad_tecnologia"),
        F.lit(None).cast("string").alias("registro_administracion"),
        F.col("l_shipdate").alias("created_at"),
    )


# ------------------------------------------------------------- sessions ---

def logins(events: DataFrame) -> DataFrame:
    return (events.filter(F.col("event_type") == "signup")
            .select(F.col("user_id").alias("usuario"), F.col("ts").alias("login_ts")))


def requests(events: DataFrame) -> DataFrame:
    return (events.filter(F.col("event_type") != "signup")
            .select(F.col("event_id").alias("solicitud_id"), F.col("user_id").alias("usuario"),
                    F.col("ts").alias("ts")))


# Which event type stands for which application action.
ACTION_OF_EVENT = {
    "view": "consulta_medico",
    "click": "admision_consulta",
    "purchase": "exportar",
    "error": "pagina_paciente",
    "signup": "registrar_atencion",
}


def access_requests(events: DataFrame) -> DataFrame:
    """Requests for the visibility rules: principal, action and target
    patient, all derived from the event row."""
    e, u = F.col("event_id"), F.col("user_id")
    action = F.lit(None).cast("string")
    for ev, act in reversed(list(ACTION_OF_EVENT.items())):
        action = F.when(F.col("event_type") == ev, act).otherwise(action)
    return events.select(
        e.alias("solicitud_id"),
        (u * 11).alias("principal_id"),
        action.alias("accion"),
        F.when(e % 5 == 0, u * 11).otherwise((e * 37) % 2000).alias("documento_id"),
    )


ACCESS_REQUESTS_SQL = """
access_requests AS (
  SELECT event_id AS solicitud_id, user_id * 11 AS principal_id,
    CASE event_type WHEN 'view' THEN 'consulta_medico' WHEN 'click' THEN 'admision_consulta'
      WHEN 'purchase' THEN 'exportar' WHEN 'error' THEN 'pagina_paciente'
      WHEN 'signup' THEN 'registrar_atencion' END AS accion,
    CASE WHEN event_id % 5 = 0 THEN user_id * 11 ELSE (event_id * 37) % 2000 END AS documento_id
  FROM events
)"""


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + body
