"""Registered driver queries: each key maps to a DataFrame builder
``(spark, sf_dir) -> DataFrame`` and, where SQL can express it, the same
result as DuckDB SQL over the raw driver tables (the oracle).

Oracle hygiene: flat scalar columns only, fixed ``as_of``, timestamps
rendered as text, every computed column aliased identically on both sides.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ehrflow.functions import scalars as S
from ehrflow.operators import history as H
from ehrflow.plans import driver_model as M
from ehrflow.session import checkpoint_dir, drop_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _t(spark, sf_dir, name):
    return M.read(spark, sf_dir, name)


# DuckDB helpers shared by the oracle texts.
AGE_SQL = ("(year(DATE '{d}') - year({c}) - CASE WHEN month(DATE '{d}') < month({c}) OR "
           "(month(DATE '{d}') = month({c}) AND day(DATE '{d}') < day({c})) THEN 1 ELSE 0 END)")


def age_sql(col: str) -> str:
    return AGE_SQL.format(d=M.AS_OF_DATE.isoformat(), c=col)


def local_sql(col: str) -> str:
    return f"(({col} AT TIME ZONE 'UTC') AT TIME ZONE 'America/Bogota')"


# ------------------------------------------------------ patient history ---

def patient_history_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 + C2 + D2 + H1b + H3/H4: every patient with every encounter, the
    displayed age, local time, the clinician-view professional name and the
    encounter count."""
    pats = H.patient_view(M.model(spark, sf_dir, "patients"), M.AS_OF_DATE)
    enc = H.encounter_view(M.model(spark, sf_dir, "encounters"), M.model(spark, sf_dir, "professionals"),
                           policy="clinician")
    enc = enc.select("documento_id", "atencion_id", "tipo_atencion",
                     S.fmt("fecha_hora_local", "stamp").alias("fecha_local"), "profesional_nombre")
    return H.patient_history_rows(pats.select("documento_id", "primer_nombre", F.col("edad").cast("long").alias("edad")), enc,
                                  keys=M.model(spark, sf_dir, "encounters").select("documento_id"), count="n_atenciones")


register("patient_history", M.with_ctes(
    M.PATIENTS_SQL, M.ENCOUNTERS_SQL, M.PROFESSIONALS_SQL,
    "cnt AS (SELECT documento_id, count(*) AS n FROM encounters GROUP BY documento_id)",
    body=f"""
SELECT p.documento_id, p.primer_nombre,
  CAST(COALESCE({age_sql('p.fecha_nacimiento')}, p.edad) AS BIGINT) AS edad,
  e.atencion_id, e.tipo_atencion,
  strftime({local_sql('e.fecha_hora_atencion')}, '%d/%m/%Y %H:%M') AS fecha_local,
  CASE WHEN e.atencion_id IS NULL THEN NULL
       WHEN nullif(e.profesional_responsable, '') IS NULL THEN 'No especificado'
       WHEN pr.id_personal_salud IS NULL THEN 'Desconocido'
       ELSE pr.nombre_completo END AS profesional_nombre,
  COALESCE(c.n, 0) AS n_atenciones
FROM patients p
LEFT JOIN encounters e ON e.documento_id = p.documento_id
LEFT JOIN professionals pr ON pr.id_personal_salud = nullif(e.profesional_responsable, '')
LEFT JOIN cnt c ON c.documento_id = p.documento_id
"""))(patient_history_flat)


# ----------------------------------------------------------- shared bits ---

def _pats(spark, d):
    return M.model(spark, d, "patients")


def _encs(spark, d):
    return M.model(spark, d, "encounters")


def _profs(spark, d):
    return M.model(spark, d, "professionals")


def _techs(spark, d):
    return M.model(spark, d, "technologies")


def _ts_text(c):
    return S.fmt(c, "iso_micros")


TS_SQL = "'%Y-%m-%d %H:%M:%S.%f'"


def _at_end(spark: SparkSession, do: Callable[[], object]) -> None:
    """Call ``do`` when Python ends, if the session still runs then."""
    def run():
        if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
            do()
    atexit.register(run)


def _scratch(spark: SparkSession, tag: str) -> str:
    """A fresh folder under the shared checkpoint folder (never a
    machine-local temp folder); it is deleted when Python ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/ehrflow-{tag}-{uuid.uuid4().hex}"
    _at_end(spark, lambda: drop_path(spark, path))
    return path


# ------------------------------------------------------------ A1 / D1 ---

@register("scan_tables", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS tabla, count(*) AS n FROM {t}" for t in M.TABLES))
def scan_tables(spark, d):
    return H.row_counts({t: _t(spark, d, t) for t in M.TABLES})


# ------------------------------------------------------------- B1 / B3 ---

@register("encounters_of", M.with_ctes(M.ENCOUNTERS_SQL, body=f"""
SELECT documento_id, atencion_id, strftime({local_sql('fecha_hora_atencion')}, '%d/%m/%Y %H:%M') AS fecha_local
FROM encounters WHERE documento_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'FURNITURE')"""))
def encounters_of(spark, d):
    from ehrflow.operators.lookup import encounters_of as enc_of
    ids = _t(spark, d, "customer").filter(F.col("c_mktsegment") == "FURNITURE").select(
        F.col("c_custkey").alias("documento_id"))
    e = enc_of(_encs(spark, d), ids)
    return e.select("documento_id", "atencion_id", S.fmt(S.to_local("fecha_hora_atencion"), "stamp").alias("fecha_local"))


@register("lookup_ids", M.with_ctes(M.PATIENTS_SQL, body="""
SELECT documento_id, primer_nombre, primer_apellido, correo_electronico, tipo_usuario FROM patients
WHERE documento_id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"""))
def lookup_ids(spark, d):
    from ehrflow.operators.lookup import patients_by_id
    ids = _t(spark, d, "orders").filter(F.col("o_orderstatus") == "P").select(F.col("o_custkey").alias("documento_id"))
    return patients_by_id(_pats(spark, d), ids).select(
        "documento_id", "primer_nombre", "primer_apellido", "correo_electronico", "tipo_usuario")


# -------------------------------------------------------------- B2 / E1 ---

@register("lookup_email_first", M.with_ctes(M.PATIENTS_SQL, body="""
SELECT correo_electronico, min(documento_id) AS documento_id FROM patients
WHERE correo_electronico IS NOT NULL GROUP BY correo_electronico"""))
def lookup_email_first(spark, d):
    from ehrflow.operators.lookup import patients_by_email
    p = _pats(spark, d)
    wanted = p.select("correo_electronico")
    return patients_by_email(p, wanted).select("correo_electronico", "documento_id")


# ------------------------------------------------------- B4 / K3 / H1b ---

_PUBLIC_SQL_COLS = ", ".join(
    ["documento_id", "tipo_documento", "primer_apellido", "segundo_apellido", "primer_nombre", "segundo_nombre",
     "fecha_nacimiento", "CAST(edad AS BIGINT) AS edad", "sexo", "genero", "grupo_sanguineo", "factor_rh",
     "estado_civil", "direccion_residencia", "municipio_ciudad", "departamento", "telefono", "celular",
     "correo_electronico", "ocupacion", "entidad_afiliacion", "regimen_afiliacion", "tipo_usuario"])


@register("public_projection", M.with_ctes(M.PATIENTS_SQL, body=f"SELECT {_PUBLIC_SQL_COLS} FROM patients"))
def public_projection(spark, d):
    from ehrflow.operators.access import visible_columns
    p = H.patient_view(_pats(spark, d), M.AS_OF_DATE, recompute_age=False)
    return visible_columns(p, "admisionista").withColumn("edad", F.col("edad").cast("long"))


# ------------------------------------------------------------ B5 / B6 ---

@register("role_filter", M.with_ctes(M.PATIENTS_SQL, body="""
SELECT documento_id, tipo_usuario FROM patients WHERE tipo_usuario IN ('medico', 'admisionista')"""))
def role_filter(spark, d):
    from ehrflow.operators.lookup import with_role
    return with_role(_pats(spark, d), ["medico", "admisionista"]).select("documento_id", "tipo_usuario")


@register("prefix_count", """
SELECT 'part' AS tabla, count(*) AS n FROM part WHERE p_name LIKE 'red%'
UNION ALL SELECT 'customer' AS tabla, count(*) AS n FROM customer WHERE c_name LIKE 'Customer#0000001%'""")
def prefix_count(spark, d):
    from ehrflow.operators.lookup import prefix_count as pc
    a = pc(_t(spark, d, "part"), "p_name", "red").select(F.lit("part").alias("tabla"), "n")
    b = pc(_t(spark, d, "customer"), "c_name", "Customer#0000001").select(F.lit("customer").alias("tabla"), "n")
    return a.unionByName(b)


# ------------------------------------------------------------------ C3 ---

@register("exists_split", M.with_ctes(M.PATIENTS_SQL, M.ENCOUNTERS_SQL, body="""
SELECT p.documento_id, EXISTS (SELECT 1 FROM encounters e WHERE e.documento_id = p.documento_id
                               AND e.estado_egreso = 'Hospitalizado') AS hospitalizado
FROM patients p"""))
def exists_split(spark, d):
    from ehrflow.operators.lookup import exists_flag
    p = _pats(spark, d).select("documento_id")
    hosp = _encs(spark, d).filter(F.col("estado_egreso") == "Hospitalizado")
    return exists_flag(p, hosp, "documento_id", "hospitalizado")


# ------------------------------------------------------------------ C4 ---

def _new_patient_emails(spark, d):
    p = _pats(spark, d)
    k = F.col("documento_id")
    return p.select((k + 1_000_000_000).alias("documento_id"),
                    F.when(k % 3 == 0, F.col("correo_electronico"))
                    .otherwise(F.concat(F.lit("n"), k.cast("string"), F.lit("@nuevo.test"))).alias("correo_electronico"))


@register("nullsafe_conflict", M.with_ctes(M.PATIENTS_SQL, """
batch AS (SELECT documento_id + 1000000000 AS documento_id,
  CASE WHEN documento_id % 3 = 0 THEN correo_electronico ELSE 'n' || documento_id || '@nuevo.test' END AS correo_electronico
  FROM patients)""", body="""
SELECT b.documento_id, b.correo_electronico,
  EXISTS (SELECT 1 FROM patients p WHERE p.correo_electronico IS NOT DISTINCT FROM b.correo_electronico) AS conflicto
FROM batch b"""))
def nullsafe_conflict(spark, d):
    from ehrflow.operators.lookup import exists_flag
    batch = _new_patient_emails(spark, d)
    return exists_flag(batch, _pats(spark, d), "correo_electronico", "conflicto", null_safe=True)


# ------------------------------------------------------------- C5 / F1 ---

@register("resolve_fk", M.with_ctes(M.PROFESSIONALS_SQL, """
one AS (SELECT nombre_completo, min(id_personal_salud) AS id_resuelto FROM professionals GROUP BY nombre_completo)""",
                                    body="""
SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS tecnologia_id, o.id_resuelto
FROM lineitem l LEFT JOIN one o ON o.nombre_completo = 'Supplier#' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0')"""))
def resolve_fk(spark, d):
    li = _t(spark, d, "lineitem").select(
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("tecnologia_id"),
        F.concat(F.lit("Supplier#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0")).alias("_nombre"))
    out = H.resolve_fk(li, _profs(spark, d), "_nombre", "nombre_completo", "id_personal_salud", "id_resuelto")
    return out.select("tecnologia_id", "id_resuelto")


# ------------------------------------------------------------------ C6 ---

@register("children_join", M.with_ctes(M.ENCOUNTERS_SQL, """
tech AS (SELECT o.o_custkey AS documento_id, CAST(l.l_orderkey AS VARCHAR) AS atencion_id,
                CAST(l.l_quantity AS INTEGER) AS dias_tratamiento
         FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey)""", body="""
SELECT e.documento_id, e.atencion_id, count(t.atencion_id) AS n_tecnologias,
  CAST(sum(t.dias_tratamiento) AS BIGINT) AS dias_total
FROM encounters e LEFT JOIN tech t ON t.documento_id = e.documento_id AND t.atencion_id = e.atencion_id
GROUP BY e.documento_id, e.atencion_id"""))
def children_join(spark, d):
    tech = _techs(spark, d)
    per_enc = tech.groupBy("documento_id", "atencion_id").agg(
        F.count(F.lit(1)).alias("n_tecnologias"), F.sum("dias_tratamiento").cast("long").alias("dias_total"))
    enc = _encs(spark, d).select("documento_id", "atencion_id")
    out = H.with_children(enc, per_enc, "left")
    return out.withColumn("n_tecnologias", F.coalesce(F.col("n_tecnologias"), F.lit(0).cast("long")))


# ------------------------------------------------------------------ C7 ---

@register("authorised_asof", f"""
WITH req AS (SELECT event_id AS solicitud_id, user_id AS usuario, ts FROM events WHERE event_type <> 'signup'),
lg AS (SELECT user_id AS usuario, ts AS login_ts FROM events WHERE event_type = 'signup'),
j AS (SELECT r.solicitud_id, r.usuario, r.ts, l.login_ts FROM req r
      ASOF LEFT JOIN lg l ON r.usuario = l.usuario AND r.ts >= l.login_ts),
v AS (SELECT *, COALESCE(date_trunc('second', ts) <= date_trunc('second', login_ts + INTERVAL {M.TOKEN_TTL_MINUTES} MINUTE), false) AS ok FROM j)
SELECT solicitud_id, usuario, strftime(ts, {TS_SQL}) AS ts,
  CASE WHEN ok THEN strftime(login_ts, {TS_SQL}) END AS login_ts, ok AS autorizado
FROM v""")
def authorised_asof(spark, d):
    from ehrflow.operators.access import authorised_requests
    ev = _t(spark, d, "events")
    out = authorised_requests(M.requests(ev), M.logins(ev), M.TOKEN_TTL_MINUTES)
    return out.select("solicitud_id", "usuario", _ts_text(F.col("ts")).alias("ts"),
                      _ts_text(F.col("login_ts")).alias("login_ts"), "autorizado")


# ------------------------------------------------------------------ D2 ---

@register("encounter_counts", """
SELECT c.c_custkey AS documento_id, count(o.o_orderkey) AS n_atenciones
FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey""")
def encounter_counts(spark, d):
    return H.encounter_counts(_pats(spark, d).select("documento_id"), _encs(spark, d).select("documento_id"))


# ------------------------------------------------------------------ F2 ---

@register("nth_row", """
SELECT CAST(s_suppkey AS VARCHAR) AS id_personal_salud, s_name AS registro
FROM supplier ORDER BY s_suppkey LIMIT 1 OFFSET 1""")
def nth_row(spark, d):
    from ehrflow.operators.lookup import nth_row as nr
    p = _profs(spark, d).select("id_personal_salud", F.col("registro_profesional").alias("_r"),
                                 F.col("id_personal_salud").cast("long").alias("_k"))
    s = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("_k"), F.col("s_name").alias("registro"))
    return nr(p.join(s, "_k"), 1, [F.col("_k")]).select("id_personal_salud", "registro")


# ----------------------------------------------------------- H6/H7/B8 ---

@register("json_vitals", M.with_ctes(M.ENCOUNTERS_SQL, """
v AS (SELECT atencion_id, CASE WHEN json_valid(signos_vitales) THEN signos_vitales END AS j,
             nullif(signos_vitales, '') IS NOT NULL AS has_text FROM encounters),
x AS (SELECT atencion_id,
  nullif(json_extract_string(j, '$.ta'), '') AS ta,
  nullif(TRY_CAST(json_extract_string(j, '$.fc') AS INTEGER), 0) AS fc,
  nullif(TRY_CAST(json_extract_string(j, '$.temp') AS DOUBLE), 0) AS temp,
  nullif(TRY_CAST(json_extract_string(j, '$.sat') AS INTEGER), 0) AS sat,
  has_text FROM v)""", body="""
SELECT atencion_id, ta, CAST(fc AS BIGINT) AS fc, temp, CAST(sat AS BIGINT) AS sat,
  CAST(nullif((ta IS NOT NULL)::INT + (fc IS NOT NULL)::INT + (temp IS NOT NULL)::INT + (sat IS NOT NULL)::INT, 0) AS BIGINT)
    AS n_claves
FROM x"""))
def json_vitals(spark, d):
    return _vitals(_encs(spark, d).withColumn("_v", S.parse_json_or_empty("signos_vitales")), F.col("_v"))


def _vitals(e, v):
    out = e.select("atencion_id",
                   S.vital(v, "ta").alias("ta"),
                   S.vital(v, "fc", "bigint").alias("fc"),
                   S.vital(v, "temp", "double").alias("temp"),
                   S.vital(v, "sat", "bigint").alias("sat"))
    m = F.create_map(*[x for k in ("ta", "fc", "temp", "sat")
                       for x in (F.lit(k), F.coalesce(F.col(k).cast("string"), F.lit("")))])
    return out.withColumn("n_claves", F.size(S.clean_vitals(m)).cast("long")) \
        .withColumn("n_claves", F.when(F.col("n_claves") > 0, F.col("n_claves")))


# ------------------------------------------------------- H8 / H9 / H10 ---

@register("json_build", """
SELECT CAST(s_suppkey AS VARCHAR) AS id_personal_salud, CAST(s_suppkey AS VARCHAR) AS telefono,
  's' || s_suppkey || '@hce.test' AS email, CAST(2 AS BIGINT) AS n_medicamentos,
  'Med ' || s_nationkey AS primer_medicamento,
  CASE WHEN s_acctbal > 0 THEN '30 dias' END AS duracion
FROM supplier""")
def json_build(spark, d):
    s = _t(spark, d, "supplier")
    p = _profs(spark, d).select("id_personal_salud", "contacto")
    rx = s.select(F.col("s_suppkey").cast("string").alias("id_personal_salud"),
                  S.json_array_of_objects("medicamentos", [
                      {"nombre": F.concat(F.lit("Med "), F.col("s_nationkey").cast("string")),
                       "dosis": F.lit("1 tableta"),
                       "duracion": F.when(F.col("s_acctbal") > 0, F.lit("30 dias"))},
                      {"nombre": F.lit("Otro"), "dosis": F.lit(None).cast("string"), "duracion": F.lit("5 dias")},
                  ]).alias("formulacion"))
    j = p.join(rx, "id_personal_salud")
    c = F.parse_json("contacto")
    f = F.parse_json("formulacion")
    return j.select("id_personal_salud",
                    F.variant_get(c, "$.telefono", "string").alias("telefono"),
                    F.variant_get(c, "$.email", "string").alias("email"),
                    F.size(F.variant_get(f, "$.medicamentos", "array<variant>")).cast("long").alias("n_medicamentos"),
                    F.variant_get(f, "$.medicamentos[0].nombre", "string").alias("primer_medicamento"),
                    F.variant_get(f, "$.medicamentos[0].duracion", "string").alias("duracion"))


# ------------------------------------------------------ H11 / H12 / H13 ---

@register("codes_split_join", """
WITH t AS (SELECT p_partkey, list_concat(list_transform(string_split(p_type || ', ' || p_brand
    || CASE WHEN p_size % 5 = 0 THEN ',' ELSE '' END || CASE WHEN p_size % 7 = 0 THEN '  , X1 ' ELSE '' END, ','),
    lambda x: trim(x)), ['Z00.0']) AS codes FROM part)
SELECT p_partkey, CAST(len(codes) AS BIGINT) AS n_codigos, array_to_string(codes, ', ') AS codigos_texto,
  codes[len(codes) - 1] AS penultimo FROM t""")
def codes_split_join(spark, d):
    p = _t(spark, d, "part")
    text = F.concat(F.col("p_type"), F.lit(", "), F.col("p_brand"),
                    F.when(F.col("p_size") % 5 == 0, ",").otherwise(""),
                    F.when(F.col("p_size") % 7 == 0, "  , X1 ").otherwise(""))
    codes = F.concat(S.split_codes(text), F.array(F.lit("Z00.0")))
    return p.select("p_partkey", codes.alias("_c")).select(
        "p_partkey", F.size("_c").cast("long").alias("n_codigos"), S.join_codes("_c").alias("codigos_texto"),
        F.element_at("_c", -2).alias("penultimo"))


# ------------------------------------------------- B7 / B9 / H14 / H15 ---

@register("falsy_defaults", M.with_ctes(M.PATIENTS_SQL, body="""
SELECT documento_id,
  COALESCE(nullif(celular, ''), nullif(telefono, ''), '--') AS contacto,
  COALESCE(nullif(correo_electronico, ''), '--') AS email,
  COALESCE(nullif(entidad_afiliacion, ''), 'PARTICULAR') AS entidad,
  COALESCE(CAST(nullif(edad, 0) AS VARCHAR), '--') AS edad_texto,
  COALESCE(nullif(genero, ''), '--') AS genero,
  nullif(segundo_apellido, '') AS segundo_apellido
FROM patients"""))
def falsy_defaults(spark, d):
    p = _pats(spark, d)
    return p.select("documento_id",
                    S.coalesce_falsy("celular", "telefono", default="--").alias("contacto"),
                    S.falsy_or("correo_electronico", "--").alias("email"),
                    S.falsy_or("entidad_afiliacion", "PARTICULAR").alias("entidad"),
                    S.falsy_or_number("edad", "--").alias("edad_texto"),
                    S.falsy_or("genero", "--").alias("genero"),
                    S.blank_to_null("segundo_apellido").alias("segundo_apellido"))


# ---------------------------------------- H16 / H17 / H18 / H23 / H24 ---

@register("names_format", M.with_ctes(M.PATIENTS_SQL, body=f"""
SELECT documento_id,
  'Dr. ' || COALESCE(segundo_nombre, 'None') || ' ' || COALESCE(primer_nombre, 'None') AS firma,
  COALESCE(primer_nombre, 'None') || ' ' || COALESCE(segundo_nombre, '') || ' ' || COALESCE(primer_apellido, 'None')
    || ' ' || COALESCE(segundo_apellido, '') AS nombre_completo,
  upper(substr(primer_apellido, 1, 1)) || lower(substr(primer_apellido, 2)) AS apellido_cap,
  'HC_' || documento_id || '_' || strftime({local_sql("TIMESTAMP '" + M.AS_OF_UTC.isoformat(sep=' ') + "'")}, '%Y%m%d') || '.pdf'
    AS archivo,
  split_part(strftime(fecha_nacimiento, '%Y-%m-%dT00:00:00'), 'T', 1) AS fecha_iso
FROM patients"""))
def names_format(spark, d):
    p = _pats(spark, d)
    as_of_local = S.to_local(S.ntz_lit(M.AS_OF_UTC))
    iso = F.concat(F.col("fecha_nacimiento").cast("string"), F.lit("T00:00:00"))
    return p.select("documento_id",
                    S.signature("segundo_nombre", "primer_nombre").alias("firma"),
                    S.full_name("primer_nombre", "segundo_nombre", "primer_apellido", "segundo_apellido")
                    .alias("nombre_completo"),
                    S.capitalize("primer_apellido").alias("apellido_cap"),
                    S.export_name("documento_id", as_of_local).alias("archivo"),
                    S.iso_date_part(iso).alias("fecha_iso"))


@register("html_escape", """
SELECT doc_id, sha256(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),
  '"', '&#34;'), '''', '&#39;')) AS texto_sha256
FROM documents""")
def html_escape(spark, d):
    docs = _t(spark, d, "documents")
    return docs.select("doc_id", F.sha2(S.html_escape("text"), 256).alias("texto_sha256"))


# ------------------------------------------------------------ H2 / H5 ---

@register("interval_shift", f"""
SELECT event_id, strftime(ts - INTERVAL 5 DAY, {TS_SQL}) AS ts_menos_5d,
  CAST({local_sql('ts')} AS DATE) AS fecha_local
FROM events""")
def interval_shift(spark, d):
    ev = _t(spark, d, "events")
    return ev.select("event_id", _ts_text(S.days_before("ts", 5)).alias("ts_menos_5d"),
                     S.local_today("ts").alias("fecha_local"))


# ------------------------------------------------------------ H1 / H1b ---

@register("age_at", M.with_ctes(M.PATIENTS_SQL, body=f"""
SELECT documento_id, CAST({age_sql('fecha_nacimiento')} AS BIGINT) AS edad_calculada,
  CAST(COALESCE({age_sql('fecha_nacimiento')}, edad) AS BIGINT) AS edad_mostrada,
  CAST(edad AS BIGINT) AS edad_admision
FROM patients"""))
def age_at(spark, d):
    p = _pats(spark, d)
    return p.select("documento_id",
                    S.age_years("fecha_nacimiento", M.AS_OF_DATE).cast("long").alias("edad_calculada"),
                    S.display_age("fecha_nacimiento", "edad", M.AS_OF_DATE).cast("long").alias("edad_mostrada"),
                    S.display_age("fecha_nacimiento", "edad", M.AS_OF_DATE, recompute=False).cast("long")
                    .alias("edad_admision"))


# ------------------------------------------------------------ H3 / H4 ---

@register("history_local_formats", M.with_ctes(M.ENCOUNTERS_SQL, body=f"""
SELECT atencion_id,
  strftime({local_sql('fecha_hora_atencion')}, '%d/%m/%Y %H:%M') AS f_vista,
  strftime({local_sql('fecha_hora_atencion')}, '%Y%m%d') AS f_compacta,
  strftime({local_sql('fecha_hora_atencion')}, '%d-%m-%Y %H:%M') AS f_encabezado,
  strftime({local_sql('fecha_hora_atencion')}, '%d de %B, %Y') AS f_larga,
  strftime({local_sql('fecha_hora_atencion')}, '%I:%M %p') AS f_hora
FROM encounters"""))
def history_local_formats(spark, d):
    e = _encs(spark, d).withColumn("_l", S.to_local("fecha_hora_atencion"))
    return e.select("atencion_id", S.fmt("_l", "stamp").alias("f_vista"), S.fmt("_l", "compact").alias("f_compacta"),
                    S.fmt("_l", "header").alias("f_encabezado"), S.fmt("_l", "long_date").alias("f_larga"),
                    S.fmt("_l", "clock").alias("f_hora"))


# ------------------------------------------------------------ C2 / L3 ---

@register("name_policy", M.with_ctes(M.ENCOUNTERS_SQL, M.PROFESSIONALS_SQL, body="""
SELECT e.atencion_id,
  CASE WHEN nullif(e.profesional_responsable, '') IS NULL THEN 'No especificado'
       WHEN p.id_personal_salud IS NULL THEN 'Desconocido' ELSE p.nombre_completo END AS nombre_clinico,
  CASE WHEN nullif(e.profesional_responsable, '') IS NULL THEN COALESCE(nullif(e.responsable_registro, ''), 'Profesional de Staff')
       WHEN p.id_personal_salud IS NULL THEN 'Desconocido' ELSE p.nombre_completo END AS nombre_paciente,
  CASE WHEN nullif(e.profesional_responsable, '') IS NULL THEN COALESCE(nullif(e.responsable_registro, ''), 'Profesional de Turno')
       WHEN p.id_personal_salud IS NULL THEN 'Firma Pendiente' ELSE p.nombre_completo END AS nombre_export
FROM encounters e LEFT JOIN professionals p ON p.id_personal_salud = nullif(e.profesional_responsable, '')"""))
def name_policy(spark, d):
    e = _encs(spark, d).select("atencion_id", "profesional_responsable", "responsable_registro")
    pr = _profs(spark, d)
    e = H.with_professional(e, pr, {"nombre_clinico": "clinician", "nombre_paciente": "patient", "nombre_export": "export"})
    return e.select("atencion_id", "nombre_clinico", "nombre_paciente", "nombre_export")


# ------------------------------------------------------- I4 / G1 / I6 ---

def _ignore_batch(spark, d):
    k = F.col("documento_id")
    return _pats(spark, d).select(
        F.when(k % 4 == 0, k).otherwise(k % 700 + 2_000_000).alias("documento_id"),
        "primer_nombre", "hashed_password", k.alias("seq"))


@register("insert_or_ignore", M.with_ctes(M.PATIENTS_SQL, """
batch AS (SELECT CASE WHEN documento_id % 4 = 0 THEN documento_id ELSE documento_id % 700 + 2000000 END AS documento_id,
                 primer_nombre, documento_id AS seq FROM patients),
firsts AS (SELECT * FROM batch QUALIFY row_number() OVER (PARTITION BY documento_id ORDER BY seq) = 1)""", body="""
SELECT documento_id, primer_nombre FROM firsts f
WHERE NOT EXISTS (SELECT 1 FROM patients p WHERE p.documento_id = f.documento_id)"""))
def insert_or_ignore(spark, d):
    from ehrflow.operators.writes import insert_or_ignore as ioi
    _, inserted = ioi(_pats(spark, d), _ignore_batch(spark, d), ["documento_id"])
    return inserted.select("documento_id", "primer_nombre")


# ------------------------------------------------------------------ I1 ---

def _patient_batch(spark, d):
    """New-patient commands derived from customer rows: some reuse an
    existing document (and of these some repeat or lack their ``seq``), many
    share documents or e-mails inside the batch, some have no e-mail, too long
    a name or no password hash."""
    k = F.col("c_custkey")
    c = _t(spark, d, "customer")
    return c.select(
        F.when(k % 5 == 0, k).otherwise(k % 900 + 3_000_000).alias("documento_id"),
        F.when(k % 50 == 1, F.repeat(F.lit("n"), 121)).otherwise(F.col("c_name")).alias("primer_nombre"),
        F.when(k % 7 == 0, None).when(k % 3 == 0, F.concat(F.lit("p"), k.cast("string"), F.lit("@hce.test")))
         .otherwise(F.concat(F.lit("b"), (k % 1100).cast("string"), F.lit("@b.test"))).alias("correo_electronico"),
        F.date_add(F.lit(M.AS_OF_DATE), -(k * 13 % 30000).cast("int")).alias("fecha_nacimiento"),
        F.when(k % 50 != 2, F.concat(F.lit("h$"), k.cast("string"))).alias("hashed_password"),
        F.when(k % 35 == 0, None).when(k % 10 == 5, 7).otherwise(k).alias("seq"))


_WALK_SQL = """
batch AS (
  SELECT row_number() OVER (ORDER BY c_custkey) AS rn,
    CASE WHEN c_custkey % 35 = 0 THEN NULL WHEN c_custkey % 10 = 5 THEN 7 ELSE c_custkey END AS seq,
    CASE WHEN c_custkey % 5 = 0 THEN c_custkey ELSE c_custkey % 900 + 3000000 END AS documento_id,
    CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'p' || c_custkey || '@hce.test'
         ELSE 'b' || (c_custkey % 1100) || '@b.test' END AS correo_electronico,
    DATE '{d}' - CAST(c_custkey * 13 % 30000 AS INTEGER) AS fecha_nacimiento
  FROM customer WHERE c_custkey % 50 NOT IN (1, 2)),
walk AS (
  SELECT CAST(0 AS BIGINT) AS rn,
    (SELECT list(documento_id) FROM patients) AS docs,
    (SELECT list(COALESCE(correo_electronico, chr(1))) FROM patients) AS mails,
    CAST(NULL AS VARCHAR) AS motivo
  UNION ALL
  SELECT b.rn,
    CASE WHEN NOT list_contains(w.docs, b.documento_id)
              AND NOT list_contains(w.mails, COALESCE(b.correo_electronico, chr(1)))
         THEN list_append(w.docs, b.documento_id) ELSE w.docs END,
    CASE WHEN NOT list_contains(w.docs, b.documento_id)
              AND NOT list_contains(w.mails, COALESCE(b.correo_electronico, chr(1)))
         THEN list_append(w.mails, COALESCE(b.correo_electronico, chr(1))) ELSE w.mails END,
    CASE WHEN list_contains(w.docs, b.documento_id) THEN 'documento'
         WHEN list_contains(w.mails, COALESCE(b.correo_electronico, chr(1))) THEN 'correo' END
  FROM walk w JOIN batch b ON b.rn = w.rn + 1
)""".replace("{d}", M.AS_OF_DATE.isoformat())

# The oracle replays the batch one request at a time (a recursive walk that
# carries the taken documents and e-mails), the way the application does.
_INSERT_PATIENTS_SQL = "WITH RECURSIVE " + M.with_ctes(M.PATIENTS_SQL, _WALK_SQL, body=f"""
SELECT b.documento_id, b.seq, CASE WHEN w.motivo IS NULL THEN 'aceptado' ELSE 'rechazado' END AS estado, w.motivo,
  CASE WHEN w.motivo IS NULL THEN CAST({age_sql('b.fecha_nacimiento')} AS BIGINT) END AS edad
FROM walk w JOIN batch b ON b.rn = w.rn
UNION ALL SELECT c_custkey % 900 + 3000000, c_custkey, 'rechazado', CASE c_custkey % 50 WHEN 1 THEN 'longitud' ELSE 'campo_requerido' END, NULL
FROM customer WHERE c_custkey % 50 IN (1, 2)""")[len("WITH "):]


@register("insert_patients", _INSERT_PATIENTS_SQL)
def insert_patients(spark, d):
    from ehrflow.operators.writes import insert_patients as ip
    accepted, rejected = ip(_pats(spark, d), _patient_batch(spark, d), M.AS_OF_UTC)
    a = accepted.select("documento_id", "seq", F.lit("aceptado").alias("estado"),
                        F.lit(None).cast("string").alias("motivo"), F.col("edad").cast("long").alias("edad"))
    r = rejected.select("documento_id", "seq", F.lit("rechazado").alias("estado"), "motivo",
                        F.lit(None).cast("long").alias("edad"))
    return a.unionByName(r)


# ------------------------------------------------------------------ I2 ---

def _patches(spark, d):
    k = F.col("c_custkey")
    c = _t(spark, d, "customer")
    first = F.when(k % 6 == 0, F.concat(F.lit('{"celular":"31'), k.cast("string"), F.lit('"}'))) \
        .when(k % 6 == 1, F.lit('{"celular":null}')) \
        .when(k % 12 == 2, F.concat(F.lit('{"celular":"a","edad":3,"celular":"33'), k.cast("string"), F.lit('"}'))) \
        .when(k % 6 == 2, F.lit("{}")) \
        .when(k % 6 == 3, F.lit('{"correo_electronico":"","fecha_nacimiento":"1990-05-05"}')) \
        .when(k % 6 == 4, F.lit('{"edad":7}')) \
        .otherwise(F.lit('{"fecha_nacimiento":null}'))
    p1 = c.select(k.alias("documento_id"), F.lit(1).cast("long").alias("seq"), first.alias("patch"))
    second = F.when(k % 4 == 0, F.concat(F.lit('{"celular":"32'), k.cast("string"), F.lit('","edad":9}'))) \
        .when(k % 4 == 1, F.lit('{"celular":5}')) \
        .when(k % 8 == 2, F.lit('{"edad":"12","telefono":null}')) \
        .when(k % 8 == 6, F.lit('{"factor_rh":"AB positivo de 5"}')) \
        .when(k % 8 == 3, F.lit('{"celular":')) \
        .otherwise(F.lit("{}"))
    p2 = c.select(k.alias("documento_id"), F.lit(2).cast("long").alias("seq"), second.alias("patch"))
    p3 = c.select((k + 5_000_000).alias("documento_id"), F.lit(1).cast("long").alias("seq"),
                  F.lit('{"celular":"x"}').alias("patch"))
    return p1.unionByName(p2).unionByName(p3)


_PATCHES_SQL = """
patches AS (
  SELECT c_custkey AS documento_id, CAST(1 AS BIGINT) AS seq,
    CASE c_custkey % 6 WHEN 0 THEN '{"celular":"31' || c_custkey || '"}' WHEN 1 THEN '{"celular":null}'
      WHEN 2 THEN CASE WHEN c_custkey % 12 = 2 THEN '{"edad":3,"celular":"33' || c_custkey || '"}' ELSE '{}' END
      WHEN 3 THEN '{"correo_electronico":"","fecha_nacimiento":"1990-05-05"}'
      WHEN 4 THEN '{"edad":7}' ELSE '{"fecha_nacimiento":null}' END AS patch
  FROM customer
  UNION ALL SELECT c_custkey, 2,
    CASE WHEN c_custkey % 4 = 0 THEN '{"celular":"32' || c_custkey || '","edad":9}'
         WHEN c_custkey % 8 = 2 THEN '{"edad":12,"telefono":null}' ELSE '{}' END FROM customer
  UNION ALL SELECT c_custkey + 5000000, 1, '{"celular":"x"}' FROM customer
),
good AS (SELECT * FROM patches WHERE documento_id IN (SELECT documento_id FROM patients)),
agg AS (
  SELECT documento_id,
    arg_max({'v': patch->>'$.celular'}, seq) FILTER (WHERE list_contains(json_keys(patch), 'celular')) AS p_cel,
    arg_max({'v': patch->>'$.correo_electronico'}, seq) FILTER (WHERE list_contains(json_keys(patch), 'correo_electronico')) AS p_mail,
    arg_max({'v': TRY_CAST(patch->>'$.fecha_nacimiento' AS DATE)}, seq) FILTER (WHERE list_contains(json_keys(patch), 'fecha_nacimiento')) AS p_dob,
    arg_max({'v': TRY_CAST(patch->>'$.edad' AS INTEGER)}, seq) FILTER (WHERE list_contains(json_keys(patch), 'edad')) AS p_age,
    max(seq) FILTER (WHERE list_contains(json_keys(patch), 'fecha_nacimiento') AND patch->>'$.fecha_nacimiento' IS NOT NULL) AS dob_seq,
    arg_max(TRY_CAST(patch->>'$.fecha_nacimiento' AS DATE), seq) FILTER (WHERE list_contains(json_keys(patch), 'fecha_nacimiento') AND patch->>'$.fecha_nacimiento' IS NOT NULL) AS dob_val,
    max(seq) FILTER (WHERE list_contains(json_keys(patch), 'edad')) AS age_seq
  FROM good GROUP BY documento_id
),
merged AS (
  SELECT p.documento_id, p.celular AS o_cel, p.correo_electronico AS o_mail, p.fecha_nacimiento AS o_dob, p.edad AS o_age, p.telefono AS o_tel,
    CASE WHEN a.p_cel IS NOT NULL THEN a.p_cel.v ELSE p.celular END AS celular,
    CASE WHEN a.p_mail IS NOT NULL THEN a.p_mail.v ELSE p.correo_electronico END AS correo_electronico,
    CASE WHEN a.p_dob IS NOT NULL THEN a.p_dob.v ELSE p.fecha_nacimiento END AS fecha_nacimiento,
    CASE WHEN a.dob_seq IS NOT NULL AND (a.age_seq IS NULL OR a.dob_seq >= a.age_seq)
         THEN (year(DATE '{d}') - year(a.dob_val) - CASE WHEN month(DATE '{d}') < month(a.dob_val) OR
               (month(DATE '{d}') = month(a.dob_val) AND day(DATE '{d}') < day(a.dob_val)) THEN 1 ELSE 0 END)
         WHEN a.p_age IS NOT NULL THEN a.p_age.v ELSE p.edad END AS edad
  FROM patients p LEFT JOIN agg a ON a.documento_id = p.documento_id
)""".replace("{d}", M.AS_OF_DATE.isoformat())


@register("patch_patients", M.with_ctes(M.PATIENTS_SQL, _PATCHES_SQL, body="""
SELECT documento_id, celular, correo_electronico, fecha_nacimiento, CAST(edad AS BIGINT) AS edad,
  (celular IS DISTINCT FROM o_cel OR correo_electronico IS DISTINCT FROM o_mail
   OR fecha_nacimiento IS DISTINCT FROM o_dob OR edad IS DISTINCT FROM o_age OR (o_tel IS NOT NULL AND documento_id % 8 = 2)) AS actualizado
FROM merged"""))
def patch_patients(spark, d):
    from ehrflow.operators.writes import patch_patients as pp
    return _patched(pp(_pats(spark, d), _patches(spark, d), M.AS_OF_UTC)[0])


def _patched(rows):
    return rows.select("documento_id", "celular", "correo_electronico", "fecha_nacimiento",
                       F.col("edad").cast("long").alias("edad"),
                       F.col("updated_at").isNotNull().alias("actualizado"))


@register("patch_rejects", """
SELECT c_custkey + 5000000 AS documento_id, CAST(1 AS BIGINT) AS seq, 'no_existe' AS motivo
FROM customer
UNION ALL SELECT c_custkey, 2, CASE WHEN c_custkey % 8 = 6 THEN 'longitud' ELSE 'tipo_invalido' END
FROM customer WHERE c_custkey % 4 = 1 OR c_custkey % 8 IN (3, 6)""")
def patch_rejects(spark, d):
    from ehrflow.operators.writes import patch_patients as pp
    _, rejected = pp(_pats(spark, d), _patches(spark, d), M.AS_OF_UTC)
    return rejected.select("documento_id", "seq", "motivo")


# ------------------------------------------------------------------ I3 ---

def _encounter_batch(spark, d):
    k = F.col("o_orderkey")
    o = _t(spark, d, "orders")
    return o.select(
        F.when(k % 10 == 0, F.col("o_custkey") + 7_000_000).otherwise(F.col("o_custkey")).alias("documento_id"),
        F.col("o_orderpriority").alias("tipo_atencion"),
        F.concat(F.lit("Motivo "), F.col("o_orderstatus")).alias("motivo_consulta"),
        F.when(k % 13 == 0, None).otherwise(F.lit("Cuadro")).alias("enfermedad_actual"),
        F.lit("Dx").alias("impresion_diagnostica"),
        F.lit("Plan").alias("conducta_plan_manejo"),
        F.when(k % 3 == 0, "").otherwise("Niega").alias("alergias_conocidas"),
        (k % 1500).alias("clinician_id"),
        k.alias("seq"))


@register("insert_encounters", M.with_ctes(M.PATIENTS_SQL, """
batch AS (SELECT CASE WHEN o_orderkey % 10 = 0 THEN o_custkey + 7000000 ELSE o_custkey END AS documento_id,
                 CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 'Cuadro' END AS enfermedad_actual,
                 CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Niega' END AS alergias_conocidas,
                 o_orderkey % 1500 AS clinician_id, o_orderkey AS seq FROM orders),
checked AS (
  SELECT b.*, m.primer_nombre, m.primer_apellido,
    CASE WHEN m.documento_id IS NULL THEN 'no_autenticado' WHEN m.tipo_usuario IS DISTINCT FROM 'medico' THEN 'rol_no_permitido'
         WHEN b.enfermedad_actual IS NULL THEN 'campo_requerido'
         WHEN b.documento_id NOT IN (SELECT documento_id FROM patients) THEN 'paciente_no_existe' END AS motivo
  FROM batch b LEFT JOIN patients m ON m.documento_id = b.clinician_id)""", body="""
SELECT documento_id, seq, CASE WHEN motivo IS NULL THEN 'aceptado' ELSE 'rechazado' END AS estado, motivo,
  CASE WHEN motivo IS NULL THEN 'Dr. ' || COALESCE(primer_nombre, 'None') || ' ' || COALESCE(primer_apellido, 'None') END AS responsable_registro,
  CASE WHEN motivo IS NULL
       THEN sha256(concat_ws(chr(1), CAST(documento_id AS VARCHAR), CAST(seq AS VARCHAR), CAST(clinician_id AS VARCHAR))) END AS atencion_id,
  nullif(alergias_conocidas, '') AS alergias_conocidas
FROM checked"""))
def insert_encounters(spark, d):
    from ehrflow.operators.writes import encounter_outcomes
    pats = _pats(spark, d)
    out = encounter_outcomes(pats, _encounter_batch(spark, d), pats, M.AS_OF_UTC)
    return out.select("documento_id", "seq", "estado", "motivo", "responsable_registro", "atencion_id", "alergias_conocidas")


# ------------------------------------------------------------------ I5 ---

@register("cascade_delete", """
WITH gone AS (SELECT c_custkey AS documento_id FROM customer WHERE c_mktsegment = 'AUTOMOBILE')
SELECT 'usuario' AS tabla, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT documento_id FROM gone)
UNION ALL SELECT 'atencion', count(*) FROM orders WHERE o_custkey NOT IN (SELECT documento_id FROM gone)
UNION ALL SELECT 'tecnologia_salud', count(*) FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
  WHERE o.o_custkey NOT IN (SELECT documento_id FROM gone)""")
def cascade_delete(spark, d):
    from ehrflow.operators.writes import cascade_delete as cd
    tables = {"usuario": _pats(spark, d).select("documento_id"),
              "atencion": _encs(spark, d).select("documento_id", "atencion_id"),
              "tecnologia_salud": _techs(spark, d)
              .select("documento_id", "atencion_id")}
    return H.row_counts(cd(tables, _deleted_ids(spark, d)))


def _deleted_ids(spark, d):
    return _t(spark, d, "customer").filter(F.col("c_mktsegment") == "AUTOMOBILE").select(F.col("c_custkey").alias("documento_id"))


@register("delete_encounters", """
SELECT 'usuario' AS tabla, count(*) AS n FROM customer
UNION ALL SELECT 'atencion', count(*) FROM orders WHERE o_orderpriority <> '1-URGENT' OR o_orderpriority IS NULL
UNION ALL SELECT 'tecnologia_salud', count(*) FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
  WHERE o.o_orderpriority <> '1-URGENT' OR o.o_orderpriority IS NULL""")
def delete_encounters(spark, d):
    from ehrflow.operators.writes import delete_encounters as de
    tables = {"usuario": _pats(spark, d).select("documento_id"),
              "atencion": _encs(spark, d).select("documento_id", "atencion_id"),
              "tecnologia_salud": _techs(spark, d).select("documento_id", "atencion_id")}
    gone = _t(spark, d, "orders").filter(F.col("o_orderpriority") == "1-URGENT").select(
        F.col("o_custkey").alias("documento_id"), F.col("o_orderkey").cast("string").alias("atencion_id"))
    return H.row_counts(de(tables, gone))


# ---------------------------------------------------------- J1-J7 / D4 ---

_TECH_SQL = """
tech AS (SELECT CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) AS tecnologia_id,
                CAST(l.l_orderkey AS VARCHAR) AS atencion_id, o.o_custkey AS documento_id,
                CAST(l.l_suppkey AS VARCHAR) AS id_personal_salud
         FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey)"""


@register("validate", M.with_ctes(M.ENCOUNTERS_SQL, M.PROFESSIONALS_SQL, M.PATIENTS_SQL, _TECH_SQL, """
enc AS (SELECT * EXCLUDE (fecha_hora_atencion), CASE WHEN CAST(atencion_id AS BIGINT) % 97 <> 0 THEN fecha_hora_atencion END AS fecha_hora_atencion
        FROM encounters)""", body="""
SELECT 'pk_duplicada' AS regla, 'tecnologia_salud' AS tabla,
  CAST(documento_id AS VARCHAR) || '|' || tecnologia_id AS clave, 'n=' || count(*) AS detalle
FROM tech GROUP BY documento_id, tecnologia_id HAVING count(*) > 1
UNION ALL
SELECT 'fk', 'atencion', CAST(documento_id AS VARCHAR) || '|' || atencion_id,
  'profesional_salud(' || profesional_responsable || ')'
FROM enc e WHERE profesional_responsable IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM professionals p WHERE p.id_personal_salud = e.profesional_responsable)
UNION ALL
SELECT 'fk', 'tecnologia_salud', CAST(documento_id AS VARCHAR) || '|' || tecnologia_id,
  'atencion(' || CAST(documento_id AS VARCHAR) || '|' || atencion_id || ')'
FROM tech t WHERE CAST(atencion_id AS BIGINT) % 50 = 0
UNION ALL
SELECT 'longitud', 'usuario', CAST(documento_id AS VARCHAR), 'correo_electronico'
FROM patients WHERE length(correo_electronico) > 20
UNION ALL
SELECT 'no_nulo', 'atencion', CAST(documento_id AS VARCHAR) || '|' || atencion_id, 'fecha_hora_atencion' FROM enc WHERE fecha_hora_atencion IS NULL"""))
def validate(spark, d):
    """Every 97th encounter has no time, and every 50th is missing as the
    parent of its technologies."""
    from ehrflow.operators import integrity as J
    tech = _techs(spark, d)
    k = F.col("atencion_id").cast("long")
    enc = _encs(spark, d).withColumn("fecha_hora_atencion", F.when(k % 97 != 0, F.col("fecha_hora_atencion")))
    reports = [
        J.repeated_keys(tech, ["documento_id", "tecnologia_id"], "tecnologia_salud"),
        J.fk_violations(enc, _profs(spark, d), ["profesional_responsable"], ["id_personal_salud"],
                        ["documento_id", "atencion_id"], "atencion", "profesional_salud"),
        J.fk_violations(tech, enc.filter(k % 50 != 0), ["documento_id", "atencion_id"], ["documento_id", "atencion_id"],
                        ["documento_id", "tecnologia_id"], "tecnologia_salud", "atencion"),
        J.row_violations(tech, ["documento_id", "tecnologia_id"], "tecnologia_salud"),
        J.row_violations(_pats(spark, d), ["documento_id"], "usuario", limits={"correo_electronico": 20}),
        J.row_violations(enc, ["documento_id", "atencion_id"], "atencion", ["fecha_hora_atencion"]),
    ]
    return J.validate(reports)


@register("violations_required", M.with_ctes(M.PATIENTS_SQL, body="""
SELECT 'requerido' AS regla, 'usuario' AS tabla, CAST(documento_id AS VARCHAR) AS clave, f AS detalle
FROM (SELECT documento_id, unnest(list_filter([CASE WHEN correo_electronico IS NULL THEN 'correo_electronico' END,
                                               CASE WHEN segundo_nombre IS NULL THEN 'segundo_nombre' END,
                                               CASE WHEN genero IS NULL THEN 'genero' END], lambda x: x IS NOT NULL)) AS f
      FROM patients)"""))
def violations_required(spark, d):
    from ehrflow.operators.integrity import missing_required
    return missing_required(_pats(spark, d), ["correo_electronico", "segundo_nombre", "genero"],
                            ["documento_id"], "usuario")


@register("violations_length_documents", """
SELECT 'longitud' AS regla, 'documents' AS tabla, CAST(doc_id AS VARCHAR) AS clave, 'text' AS detalle
FROM documents WHERE length(text) > 20000""")
def violations_length_documents(spark, d):
    from ehrflow.operators.integrity import length_violations
    return length_violations(_t(spark, d, "documents"), {"text": 20000}, ["doc_id"], "documents")


# ------------------------------------------------------------ K1/K2/K4 ---

@register("access_outcomes", M.with_ctes(M.PATIENTS_SQL, M.ACCESS_REQUESTS_SQL, """
rules AS (SELECT * FROM (VALUES ('medico','consulta_medico'), ('medico','registrar_atencion'),
  ('admisionista','admision_consulta'), ('admisionista','admision_crear'), ('admisionista','admision_actualizar'),
  ('paciente','pagina_paciente'), ('medico','exportar'), ('paciente','exportar')) t(rol, accion))""", body="""
SELECT r.solicitud_id, r.principal_id, r.accion, r.documento_id, u.tipo_usuario AS rol,
  CASE WHEN u.documento_id IS NULL THEN 401
       WHEN NOT EXISTS (SELECT 1 FROM rules x WHERE x.rol = u.tipo_usuario AND x.accion = r.accion) THEN 403
       WHEN r.accion = 'exportar' AND u.tipo_usuario = 'paciente' AND r.principal_id <> r.documento_id THEN 403
       WHEN r.accion IN ('consulta_medico','registrar_atencion','admision_consulta','admision_actualizar','exportar')
            AND NOT EXISTS (SELECT 1 FROM patients t WHERE t.documento_id = r.documento_id) THEN 404
       ELSE 200 END AS estado
FROM access_requests r LEFT JOIN patients u ON u.documento_id = r.principal_id"""))
def access_outcomes(spark, d):
    from ehrflow.operators.access import access_outcomes as ao
    p = _pats(spark, d)
    return ao(M.access_requests(_t(spark, d, "events")), p, p)


@register("visible_rows", M.with_ctes(M.PATIENTS_SQL, M.ACCESS_REQUESTS_SQL, body="""
SELECT r.solicitud_id, r.principal_id, r.documento_id, u.tipo_usuario AS rol
FROM access_requests r JOIN patients u ON u.documento_id = r.principal_id
WHERE r.accion = 'exportar' AND (u.tipo_usuario = 'medico' OR (u.tipo_usuario = 'paciente' AND r.principal_id = r.documento_id))"""))
def visible_rows(spark, d):
    from ehrflow.operators.access import visible_rows as vr
    req = M.access_requests(_t(spark, d, "events")).filter(F.col("accion") == "exportar")
    return vr(req, _pats(spark, d)).select("solicitud_id", "principal_id", "documento_id", "rol")


# ------------------------------------------- K2 / K3 / H in plain SQL ---

def _sql_session(spark, d):
    """A session of its own (views, functions and the variable are its own)
    with the policies installed."""
    from ehrflow.plans import policies
    own = spark.newSession()
    policies.install(own, {"usuario": _pats(own, d), "atencion": _encs(own, d), "solicitudes": M.access_requests(_t(own, d, "events"))})
    return own


@register("sql_visible_rows", ORACLE["visible_rows"])
def sql_visible_rows(spark, d):
    return _sql_session(spark, d).sql("SELECT * FROM exportaciones_visibles")


@register("sql_public_projection", ORACLE["public_projection"])
def sql_public_projection(spark, d):
    return _sql_session(spark, d).sql("SELECT * EXCEPT (edad), CAST(edad AS BIGINT) AS edad FROM pacientes_admision")


# ----------------------------------------------------- A6 / H21 / H22 ---

def _blank(c: str) -> str:
    return f"COALESCE({c}, '') <> ''"


_DOC_SQL = f"""
ev AS (
  SELECT e.*, pr.id_personal_salud AS pid, pr.nombre_completo AS pname,
    CASE WHEN json_valid(e.signos_vitales) THEN e.signos_vitales END AS v
  FROM encounters e LEFT JOIN professionals pr ON pr.id_personal_salud = nullif(e.profesional_responsable, '')
),
vt AS (
  SELECT *,
    nullif(json_extract_string(v, '$.ta'), '') AS ta_t,
    CASE WHEN TRY_CAST(json_extract_string(v, '$.fc') AS DOUBLE) <> 0 THEN json_extract_string(v, '$.fc') END AS fc_t,
    nullif(json_extract_string(v, '$.temp'), '') AS temp_t,
    CASE WHEN TRY_CAST(json_extract_string(v, '$.sat') AS DOUBLE) <> 0 THEN json_extract_string(v, '$.sat') END AS sat_t
  FROM ev
),
blocks AS (
  SELECT documento_id, fecha_hora_atencion, atencion_id, concat_ws(chr(10),
    '== ' || strftime({local_sql('fecha_hora_atencion')}, '%d-%m-%Y %H:%M') || ' ' || COALESCE(tipo_atencion, 'None'),
    CASE WHEN concat_ws('; ', CASE WHEN ta_t IS NOT NULL THEN 'P. Arterial: ' || ta_t END,
                              CASE WHEN fc_t IS NOT NULL THEN 'F. Cardíaca: ' || fc_t END,
                              CASE WHEN temp_t IS NOT NULL THEN 'Temp.: ' || temp_t || '°' END,
                              CASE WHEN sat_t IS NOT NULL THEN 'Sat O2: ' || sat_t || '%' END) <> ''
         THEN 'VITALES: ' || concat_ws('; ', CASE WHEN ta_t IS NOT NULL THEN 'P. Arterial: ' || ta_t END,
                              CASE WHEN fc_t IS NOT NULL THEN 'F. Cardíaca: ' || fc_t END,
                              CASE WHEN temp_t IS NOT NULL THEN 'Temp.: ' || temp_t || '°' END,
                              CASE WHEN sat_t IS NOT NULL THEN 'Sat O2: ' || sat_t || '%' END) END,
    'Motivo: ' || COALESCE(motivo_consulta, 'None'),
    CASE WHEN {_blank('enfermedad_actual')} THEN 'Enfermedad Actual: ' || enfermedad_actual END,
    CASE WHEN {_blank('antecedentes_personales')} OR {_blank('antecedentes_familiares')}
           OR {_blank('medicamentos_actuales')} OR {_blank('alergias_conocidas')}
         THEN 'ANTECEDENTES: personales ' || COALESCE(nullif(antecedentes_personales, ''), 'Niega')
           || '; alergias ' || COALESCE(nullif(alergias_conocidas, ''), 'Niega')
           || '; familiares ' || COALESCE(nullif(antecedentes_familiares, ''), 'No refiere')
           || '; farmacologicos ' || COALESCE(nullif(medicamentos_actuales, ''), 'No refiere') END,
    CASE WHEN {_blank('examen_fisico_general')} OR {_blank('examen_fisico_por_sistemas')}
         THEN concat_ws('; ', CASE WHEN {_blank('examen_fisico_general')} THEN 'General ' || examen_fisico_general END,
                              CASE WHEN {_blank('examen_fisico_por_sistemas')} THEN 'Por Sistemas ' || examen_fisico_por_sistemas END) END,
    'DX: ' || COALESCE(impresion_diagnostica, 'None'),
    CASE WHEN len(codigos_cie10) > 0 THEN 'CIE10: ' || array_to_string(codigos_cie10, ', ') END,
    'PLAN: ' || COALESCE(conducta_plan_manejo, 'None'),
    'FIRMA: Dr/a. ' || COALESCE(CASE WHEN nullif(profesional_responsable, '') IS NULL
                                       THEN COALESCE(nullif(responsable_registro, ''), 'Profesional de Turno')
                                     WHEN pid IS NULL THEN 'Firma Pendiente' ELSE pname END, 'None')) AS block
  FROM vt
),
bodies AS (
  SELECT documento_id, CAST(date_trunc('month', fecha_hora_atencion) AS DATE) AS mes,
    string_agg(block, chr(10) ORDER BY fecha_hora_atencion DESC, atencion_id DESC) AS enc
  FROM blocks WHERE documento_id IN (SELECT documento_id FROM patients) GROUP BY 1, 2
),
pv AS (SELECT *, COALESCE({age_sql('fecha_nacimiento')}, edad) AS edad_m FROM patients)"""

_AS_OF_LOCAL_SQL = local_sql("TIMESTAMP '" + M.AS_OF_UTC.isoformat(sep=" ") + "'")


_FILE_SQL = f"'HC_' || documento_id || '_' || strftime({_AS_OF_LOCAL_SQL}, '%Y%m%d') || '.pdf'"

_DOCS_SELECT = f"""
SELECT p.documento_id, CAST(NULL AS DATE) AS mes, {_FILE_SQL} AS archivo,
  concat_ws(chr(10),
    'HISTORIA CLINICA UNIFICADA',
    'PACIENTE: ' || COALESCE(primer_nombre, 'None') || ' ' || COALESCE(segundo_nombre, '') || ' '
      || COALESCE(primer_apellido, 'None') || ' ' || COALESCE(segundo_apellido, '')
      || ' | DOCUMENTO: ' || COALESCE(tipo_documento, 'None') || ' ' || p.documento_id,
    'EDAD: ' || COALESCE(CAST(nullif(edad_m, 0) AS VARCHAR), '--') || ' años ('
      || COALESCE(CAST(fecha_nacimiento AS VARCHAR), 'None') || ') | GÉNERO: ' || COALESCE(nullif(genero, ''), '--'),
    'RH: ' || COALESCE(nullif(grupo_sanguineo, ''), '') || ' ' || COALESCE(nullif(factor_rh, ''), '')
      || ' | ESTADO CIVIL: ' || COALESCE(nullif(estado_civil, ''), '--'),
    'DIRECCIÓN: ' || COALESCE(nullif(direccion_residencia, ''), '--') || ' - ' || COALESCE(nullif(municipio_ciudad, ''), ''),
    'CONTACTO: ' || COALESCE(nullif(celular, ''), nullif(telefono, ''), '--')
      || ' | EMAIL: ' || COALESCE(nullif(correo_electronico, ''), '--'),
    'ENTIDAD: ' || COALESCE(nullif(entidad_afiliacion, ''), 'PARTICULAR')
      || ' | RÉGIMEN: ' || COALESCE(nullif(regimen_afiliacion, ''), '--'),
    'IMPRESO: ' || strftime({_AS_OF_LOCAL_SQL}, '%d/%m/%Y %H:%M'),
    CASE WHEN p.documento_id NOT IN (SELECT documento_id FROM encounters) THEN 'No existen registros de atención.' END) AS cuerpo
FROM pv p
UNION ALL SELECT documento_id, mes, {_FILE_SQL}, enc FROM bodies"""


@register("history_documents", M.with_ctes(M.PATIENTS_SQL, M.ENCOUNTERS_SQL, M.PROFESSIONALS_SQL, _DOC_SQL,
                                           body=_DOCS_SELECT))
def history_documents(spark, d):
    from ehrflow.operators.documents import history_documents as hd
    pats = H.patient_view(_pats(spark, d), M.AS_OF_DATE)
    return hd(pats, _encs(spark, d), _profs(spark, d), M.AS_OF_UTC)


# ------------------------------------------------------------- A4 / J6 ---

def _command_lines(spark, d):
    """New-patient commands as JSON text derived from customer rows: some have
    a document that is no number, or a number as text (which is taken), a name
    that is a number or too long, no password hash, no ``seq``, or are cut
    off."""
    k = F.col("c_custkey")
    c = _t(spark, d, "customer")

    def line(document=k, name=F.col("c_name"), password=F.concat(F.lit("h$"), k.cast("string")), seq=k):
        born = F.date_add(F.lit(M.AS_OF_DATE), -(k * 13 % 30000).cast("int"))
        return F.to_json(F.struct(document.alias("documento_id"), name.alias("primer_nombre"), born.alias("fecha_nacimiento"),
                                  password.alias("hashed_password"), seq.alias("seq")))

    return c.select(
        F.when(k % 50 == 0, line(document=F.concat(F.lit("x"), k.cast("string")))).when(k % 50 == 10, line(document=k.cast("string")))
        .when(k % 50 == 20, line(name=k)).when(k % 50 == 30, line(name=F.repeat(F.lit("n"), 121))).when(k % 50 == 40, F.left(line(), F.lit(20)))
        .when(k % 40 == 1, line(password=F.lit(None).cast("string"))).when(k % 60 == 7, line(seq=F.lit(None).cast("long")))
        .otherwise(line()).alias("value"))


@register("commands_ingest", """
WITH t AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 50 IN (0, 20) THEN 'tipo_invalido' WHEN c_custkey % 50 = 30 THEN 'longitud'
    WHEN c_custkey % 50 = 40 THEN 'json' WHEN c_custkey % 40 = 1 OR c_custkey % 60 = 7 THEN 'requerido' ELSE 'aceptado' END AS estado FROM customer)
SELECT CASE WHEN estado <> 'json' AND k % 60 <> 7 THEN k END AS seq, CASE WHEN estado = 'aceptado' THEN k END AS documento_id, estado FROM t""")
def commands_ingest(spark, d):
    from ehrflow.sources.commands import read_commands
    path = _scratch(spark, "commands")
    _command_lines(spark, d).write.mode("overwrite").text(path)
    accepted, rejected = read_commands(spark, path, "patient")
    a = accepted.select("seq", "documento_id", F.lit("aceptado").alias("estado"))
    r = rejected.select(F.get_json_object("linea", "$.seq").cast("long").alias("seq"),
                        F.lit(None).cast("long").alias("documento_id"), F.col("motivo").alias("estado"))
    return a.unionByName(r)


# ------------------------------------------------------------------ A5 ---

@register("history_json", M.with_ctes(M.ENCOUNTERS_SQL, body="""
SELECT c.c_custkey AS documento_id, count(e.atencion_id) AS n_atenciones,
  first(e.atencion_id ORDER BY e.fecha_hora_atencion DESC, e.atencion_id DESC) AS mas_reciente,
  CAST(date_trunc('month', e.fecha_hora_atencion) AS DATE) AS mes
FROM customer c LEFT JOIN encounters e ON e.documento_id = c.c_custkey GROUP BY c.c_custkey, mes"""))
def history_json(spark, d):
    from ehrflow.sources.sinks import write_history_json
    pats = _pats(spark, d).select("documento_id", "primer_nombre")
    enc = _encs(spark, d).select("documento_id", "atencion_id", "fecha_hora_atencion", "tipo_atencion",
                                 "codigos_cie10")
    hist = H.patient_history(pats, enc)
    path = _scratch(spark, "history-json")
    write_history_json(hist, path)
    back = spark.read.schema(hist.schema).json(path)
    return back.select("documento_id", F.size("atenciones").cast("long").alias("n_atenciones"),
                       F.get(F.col("atenciones"), 0)["atencion_id"].alias("mas_reciente"), "mes")


# ------------------------------------------------------------------ M1 ---



def _encounter_lines(spark, d):
    """The encounter commands as JSON text: some with the document as text
    (which is taken), with a number or an object where a text belongs, cut
    off, with a key given twice, or without ``seq``."""
    b = _encounter_batch(spark, d)
    k, document = F.col("seq"), F.col("documento_id")

    def line(documento=document, tipo=F.col("tipo_atencion"), motivo=F.col("motivo_consulta"), seq=k):
        new = {"documento_id": documento, "tipo_atencion": tipo, "motivo_consulta": motivo, "seq": seq}
        return F.to_json(F.struct(*[new.get(c, F.col(c)).alias(c) for c in b.columns]))

    twice = F.concat(F.lit('{"alergias_conocidas":5,'), F.substring(line(), 2, 1 << 20))
    return b.select(F.when(k % 17 == 1, line(documento=document.cast("string"))).when(k % 19 == 2, line(tipo=F.lit(5)))
                    .when(k % 23 == 3, line(motivo=F.struct(F.lit(1).alias("a")))).when(k % 29 == 4, F.left(line(), F.lit(30)))
                    .when(k % 31 == 5, twice).when(k % 37 == 6, line(seq=F.lit(None).cast("long"))).otherwise(line()).alias("value"))


@register("encounter_stream", M.with_ctes(M.PATIENTS_SQL, """
lines AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 0 THEN o_custkey + 7000000 ELSE o_custkey END AS documento_id,
                 o_orderkey % 13 = 0 AS sin_cuadro, o_orderkey % 1500 AS clinician_id,
                 CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'Niega' END AS alergias,
                 CASE WHEN o_orderkey % 17 = 1 THEN 'texto' WHEN o_orderkey % 19 = 2 OR o_orderkey % 23 = 3 THEN 'tipo_invalido'
                      WHEN o_orderkey % 29 = 4 THEN 'json' WHEN o_orderkey % 31 = 5 THEN 'doble' WHEN o_orderkey % 37 = 6 THEN 'sin_seq' END AS caso FROM orders),
checked AS (
  SELECT b.*, m.primer_nombre, m.primer_apellido,
    CASE WHEN caso IN ('tipo_invalido', 'json') THEN caso
         WHEN m.documento_id IS NULL THEN 'no_autenticado' WHEN m.tipo_usuario IS DISTINCT FROM 'medico' THEN 'rol_no_permitido'
         WHEN sin_cuadro THEN 'campo_requerido'
         WHEN b.documento_id NOT IN (SELECT documento_id FROM patients) THEN 'paciente_no_existe'
         WHEN caso = 'sin_seq' THEN 'campo_requerido' END AS motivo
  FROM lines b LEFT JOIN patients m ON m.documento_id = b.clinician_id)""", body="""
SELECT CASE WHEN motivo IS DISTINCT FROM 'json' THEN documento_id END AS documento_id,
  CASE WHEN motivo IS DISTINCT FROM 'json' AND caso IS DISTINCT FROM 'sin_seq' THEN k END AS seq,
  CASE WHEN motivo IS NULL THEN 'aceptado' ELSE 'rechazado' END AS estado, motivo, motivo IS NOT NULL AS linea_guardada,
  CASE WHEN motivo IS NULL THEN 'Dr. ' || COALESCE(primer_nombre, 'None') || ' ' || COALESCE(primer_apellido, 'None') END AS responsable_registro,
  CASE WHEN motivo IS NULL
       THEN sha256(concat_ws(chr(1), CAST(documento_id AS VARCHAR), CAST(k AS VARCHAR), CAST(clinician_id AS VARCHAR))) END AS atencion_id,
  CASE WHEN motivo IS NULL OR motivo NOT IN ('json', 'tipo_invalido') THEN alergias END AS alergias_conocidas
FROM checked"""))
def encounter_stream(spark, d):
    from ehrflow.streaming.encounters import encounter_stream as es
    root = _scratch(spark, "stream")
    _encounter_lines(spark, d).repartition(4).write.mode("overwrite").text(f"{root}/in")
    q = es(spark, f"{root}/in", lambda: (_pats(spark, d), _pats(spark, d)), f"{root}/out", f"{root}/checkpoint", M.AS_OF_UTC)
    q.awaitTermination()
    out = spark.read.parquet(f"{root}/out")
    return out.select("documento_id", "seq", "estado", "motivo", F.col("linea").isNotNull().alias("linea_guardada"), "responsable_registro",
                      "atencion_id", "alergias_conocidas")


# ------------------------------------------------------- C7 as a stream ---

@register("authorised_stream", ORACLE["authorised_asof"])
def authorised_stream(spark, d):
    """The events as two streams of files, in no order of time within a file;
    two last pairs of files move the watermark of the join, and then that of
    the result, beyond all events."""
    from ehrflow.streaming import sessions
    root, ev = _scratch(spark, "sessions"), _t(spark, d, "events")
    sides = {"requests": M.requests(ev), "logins": M.logins(ev)}
    for days in (None, 2, 4):
        for name, rows in sides.items():
            if days:
                last = F.struct(F.lit(-1).alias("solicitud_id"), F.lit(-1).alias("usuario"), "ts", F.col("ts").alias("login_ts"))
                rows = (ev.agg((F.max("ts") + F.make_dt_interval(F.lit(days))).alias("ts")).select(last.alias("x"))
                        .select(*[F.col("x")[f.name].cast(f.dataType).alias(f.name) for f in rows.schema.fields]))
            rows.write.mode("append").parquet(f"{root}/{name}")
        if days:
            streams = {name: spark.readStream.schema(rows.schema).parquet(f"{root}/{name}") for name, rows in sides.items()}
            out = sessions.authorised_stream(streams["requests"], streams["logins"], M.TOKEN_TTL_MINUTES, delay="1 hour")
            sessions.write_authorised(out, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    found = spark.read.schema(out.schema).parquet(f"{root}/out").filter("solicitud_id >= 0")
    return found.select("solicitud_id", "usuario", _ts_text(F.col("ts")).alias("ts"), _ts_text(F.col("login_ts")).alias("login_ts"), "autorizado")


# -------------------------------------------------------- L1 / L2 / L4 ---

# Write tasks per bucket in the layout query: each bucket (including one
# holding a very large patient) is written by up to this many tasks.
FANOUT = 2


def _saved(spark, d, tables, **options):
    """The tables saved in the physical layout; they go when Python ends."""
    from ehrflow.plans.layout import save_layout
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    layout = save_layout(tables, buckets, location=_scratch(spark, "layout"), suffix="_" + uuid.uuid4().hex[:12], fanout=FANOUT, **options)
    _at_end(spark, lambda: layout.drop(spark))
    return layout


@register("layout_join", ORACLE["encounter_counts"])
def layout_join(spark, d):
    layout = _saved(spark, d, {"usuario": _pats(spark, d), "atencion": _encs(spark, d)})
    return layout.per_patient(spark, lambda t: H.encounter_counts(t["usuario"].select("documento_id"), t["atencion"].select("documento_id")))


# Keys looked up in the saved layout: present, absent, and shared ones.
LOOKUPS = {"correo_electronico": ["p11@hce.test", "p457@hce.test", "building.7@hce.test", "nadie@hce.test", "p999999999999@hce.test"],
           "celular": ["3000000011", "3000000457", "3999999999", ""], "atencion_id": ["1", "77", "1003", "no-existe"]}


def _lookups_sql():
    listed = {c: ", ".join(f"'{x}'" for x in v) for c, v in LOOKUPS.items()}
    parts = [f"SELECT '{c}' AS via, {c} AS valor, CAST(documento_id AS BIGINT) AS documento_id FROM {'encounters' if c == 'atencion_id' else 'patients'} WHERE {c} IN ({v})"
             for c, v in listed.items()]
    return " UNION ALL ".join(parts)


@register("layout_lookups", M.with_ctes(M.PATIENTS_SQL, M.ENCOUNTERS_SQL, body=_lookups_sql()))
def layout_lookups(spark, d):
    from ehrflow.plans.layout import lookup
    layout = _saved(spark, d, {"usuario": _pats(spark, d), "atencion": _encs(spark, d)})
    found = [lookup(layout.whole(spark, "atencion" if c == "atencion_id" else "usuario"), c, v)
             .select(F.lit(c).alias("via"), F.col(c).alias("valor"), "documento_id") for c, v in LOOKUPS.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


@register("layout_email_first", ORACLE["lookup_email_first"])
def layout_email_first(spark, d):
    from ehrflow.operators.lookup import patients_by_email
    saved = _saved(spark, d, {"usuario": _pats(spark, d)}).whole(spark, "usuario").select("documento_id", "correo_electronico")
    return patients_by_email(saved, _pats(spark, d).select("correo_electronico")).select("correo_electronico", "documento_id")


@register("vitals_at_rest", ORACLE["json_vitals"])
def vitals_at_rest(spark, d):
    """``json_vitals`` on shredded files: the vitals' own columns are read."""
    layout = _saved(spark, d, {"atencion": _encs(spark, d).select("documento_id", "atencion_id", "fecha_hora_atencion", "signos_vitales")})
    return _vitals(layout.whole(spark, "atencion"), F.col("signos_vitales"))


# ------------------------------------------------- I2 / I5 by whole files ---

def _versioned(spark, df, files):
    """``df`` as a versioned table; hash parts, so that a change of a few rows
    touches few of the files."""
    from ehrflow.plans import versions as V
    root = _scratch(spark, "versions")
    V.create(df.repartition(files, "documento_id"), root)
    return root


@register("patch_files", ORACLE["patch_patients"])
def patch_files(spark, d):
    """The patches of ``patch_patients`` committed as a new version: files
    without a patched patient stay as they are."""
    from ehrflow.operators.writes import patch_patients as pp
    from ehrflow.plans import versions as V
    patches = _patches(spark, d)
    root = _versioned(spark, _pats(spark, d), 16)
    V.change(spark, root, patches, "documento_id", lambda rows: pp(rows, patches, M.AS_OF_UTC)[0])
    return _patched(V.read(spark, root))


@register("cascade_delete_files", ORACLE["cascade_delete"])
def cascade_delete_files(spark, d):
    from ehrflow.operators.writes import cascade_delete as cd
    from ehrflow.plans import versions as V
    ids = _deleted_ids(spark, d)
    left = {}
    for name, df in {"usuario": _pats(spark, d), "atencion": _encs(spark, d), "tecnologia_salud": _techs(spark, d)}.items():
        root = _versioned(spark, df, 16)
        V.change(spark, root, ids, "documento_id", lambda rows, name=name: cd({name: rows}, ids)[name])
        left[name] = V.read(spark, root)
    return H.row_counts(left)


# -------------------------------------------- C1 / D2 / D3 kept up to date ---

@register("history_refresh", M.with_ctes(M.ENCOUNTERS_SQL, """
kept AS (SELECT * FROM encounters WHERE CAST(atencion_id AS BIGINT) % 11 <> 3),
counted AS (SELECT documento_id, count(*) AS total FROM kept GROUP BY documento_id)""", body=f"""
SELECT documento_id, CAST(date_trunc('month', fecha_hora_atencion) AS DATE) AS mes, count(*) AS n_mes, any_value(total) AS n_atenciones,
  string_agg(atencion_id || '|' || tipo_atencion || '|' || strftime(fecha_hora_atencion, {TS_SQL}), ',' ORDER BY fecha_hora_atencion DESC, atencion_id DESC) AS lista
FROM kept JOIN counted USING (documento_id) GROUP BY documento_id, mes"""))
def history_refresh(spark, d):
    """Stored month lists of an older state of the encounters (some missing,
    some at another time or of another kind, some deleted since), and the
    change set that leads to the present one."""
    from ehrflow.operators import incremental as N
    k = F.col("atencion_id").cast("long")
    now = _encs(spark, d).select("documento_id", "atencion_id", "fecha_hora_atencion", "tipo_atencion")
    before = now.filter(k % 7 != 0).withColumns({"fecha_hora_atencion": F.when(k % 5 == 0, F.col("fecha_hora_atencion") - F.expr("INTERVAL 40 DAYS")).otherwise(F.col("fecha_hora_atencion")),
                                                 "tipo_atencion": F.when(k % 6 == 0, F.lit("otra")).otherwise(F.col("tipo_atencion"))})
    stored_at, counts_at = _scratch(spark, "lists"), _scratch(spark, "counts")
    N.month_lists(before).write.parquet(stored_at)
    stored = spark.read.parquet(stored_at)
    N.counts(stored).write.parquet(counts_at)
    changed = now.filter((k % 7 == 0) | (k % 5 == 0) | (k % 6 == 0) | (k % 11 == 3)).withColumns({"borrado": k % 11 == 3, "seq": F.lit(2)})
    early = changed.withColumns({"tipo_atencion": F.lit("primera"), "seq": F.lit(1), "borrado": F.lit(False)})       # overtaken by the later change
    changes = N.last_changes(changed.unionByName(early))
    lists, totals = N.merge(stored, changes), N.merge_counts(spark.read.parquet(counts_at), stored, changes)
    text = F.transform("atenciones", lambda x: F.concat_ws("|", x["atencion_id"], x["tipo_atencion"], _ts_text(x["fecha_hora_atencion"])))
    return lists.join(totals, "documento_id").select("documento_id", "mes", F.size("atenciones").cast("long").alias("n_mes"), "n_atenciones", F.array_join(text, ",").alias("lista"))


# -------------------------------------------------- J1 / J2 / J3 alone ---

@register("violations_pk", M.with_ctes(_TECH_SQL, body="""
SELECT 'pk_duplicada' AS regla, 'tecnologia_salud' AS tabla,
  CAST(documento_id AS VARCHAR) || '|' || tecnologia_id AS clave, 'n=' || count(*) AS detalle
FROM tech GROUP BY documento_id, tecnologia_id HAVING count(*) > 1"""))
def violations_pk(spark, d):
    from ehrflow.operators.integrity import pk_violations
    return pk_violations(_techs(spark, d), ["documento_id", "tecnologia_id"], "tecnologia_salud")


@register("violations_fk", M.with_ctes(M.ENCOUNTERS_SQL, M.PROFESSIONALS_SQL, body="""
SELECT 'fk' AS regla, 'atencion' AS tabla, CAST(documento_id AS VARCHAR) || '|' || atencion_id AS clave,
  'profesional_salud(' || profesional_responsable || ')' AS detalle
FROM encounters e WHERE profesional_responsable IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM professionals p WHERE p.id_personal_salud = e.profesional_responsable)"""))
def violations_fk(spark, d):
    from ehrflow.operators.integrity import fk_violations
    return fk_violations(_encs(spark, d), _profs(spark, d), ["profesional_responsable"], ["id_personal_salud"],
                         ["documento_id", "atencion_id"], "atencion", "profesional_salud")


@register("violations_null", M.with_ctes(M.PROFESSIONALS_SQL, body="""
SELECT 'no_nulo' AS regla, 'profesional_salud' AS tabla, id_personal_salud AS clave, 'nombre_completo' AS detalle
FROM professionals WHERE nombre_completo IS NULL"""))
def violations_null(spark, d):
    from ehrflow.operators.integrity import null_violations
    return null_violations(_profs(spark, d), ["nombre_completo"], ["id_personal_salud"], "profesional_salud")


# ------------------------------------------------------------ H6 again ---

def _props_text():
    p = F.col("props")
    quoted = F.concat(F.lit('"'), F.replace(p, F.lit('"'), F.lit('\\"')), F.lit('"'))
    return (F.when(F.col("event_type") == "error", F.expr("substring(props, 2)"))
            .when(F.col("event_type") == "view", F.lit(""))
            .when(F.col("event_type") == "click", quoted)
            .otherwise(p))


@register("json_or_empty", r"""
WITH t AS (
  SELECT event_id, CASE event_type WHEN 'error' THEN substr(props, 2) WHEN 'view' THEN ''
    WHEN 'click' THEN '"' || replace(props, '"', '\"') || '"' ELSE props END AS txt FROM events),
u AS (SELECT event_id, txt, CASE WHEN ltrim(txt) LIKE '"%' AND json_valid(txt) THEN json_extract_string(txt, '$')
                                 WHEN ltrim(txt) LIKE '"%' THEN '{}' ELSE txt END AS inner_txt FROM t)
SELECT event_id,
  CASE WHEN json_valid(inner_txt) THEN nullif(TRY_CAST(json_extract_string(inner_txt, '$.k') AS BIGINT), 0) END AS k,
  (nullif(txt, '') IS NOT NULL AND nullif(inner_txt, '') IS NOT NULL) AS mostrado
FROM u""")
def json_or_empty(spark, d):
    ev = _t(spark, d, "events").select("event_id", _props_text().alias("_txt"))
    v = ev.select("event_id", S.parse_vitals("_txt").alias("_v"))
    return v.select("event_id", S.vital("_v", "k", "bigint").alias("k"), F.col("_v").isNotNull().alias("mostrado"))


# ------------------------------------------------ K2 + A6: the export ---

@register("export_documents", M.with_ctes(M.PATIENTS_SQL, M.ENCOUNTERS_SQL, M.PROFESSIONALS_SQL, M.ACCESS_REQUESTS_SQL,
                                          _DOC_SQL, """
allowed AS (
  SELECT r.solicitud_id, r.documento_id FROM access_requests r JOIN patients u ON u.documento_id = r.principal_id
  WHERE r.accion = 'exportar'
    AND (u.tipo_usuario = 'medico' OR (u.tipo_usuario = 'paciente' AND r.principal_id = r.documento_id))),
docs AS (""" + _DOCS_SELECT + """)""", body="""
SELECT a.solicitud_id, a.documento_id, d.mes, d.archivo, sha256(d.cuerpo) AS cuerpo_sha256
FROM allowed a JOIN docs d ON d.documento_id = a.documento_id"""))
def export_documents(spark, d):
    from ehrflow.operators.views import export_documents as ed
    tables = {"usuario": _pats(spark, d), "atencion": _encs(spark, d), "profesional_salud": _profs(spark, d)}
    req = M.access_requests(_t(spark, d, "events")).filter(F.col("accion") == "exportar")
    out = ed(tables, req, M.AS_OF_DATE, M.AS_OF_UTC)
    return out.select("solicitud_id", "documento_id", "mes", "archivo", F.sha2("cuerpo", 256).alias("cuerpo_sha256"))


# --------------------------------------- the patient's page (role view) ---

@register("patient_page", M.with_ctes(M.PATIENTS_SQL, M.ENCOUNTERS_SQL, M.PROFESSIONALS_SQL, body=f"""
SELECT p.documento_id, CAST(COALESCE({age_sql('p.fecha_nacimiento')}, p.edad) AS BIGINT) AS edad, e.atencion_id,
  strftime({local_sql('e.fecha_hora_atencion')}, '%d de %B, %Y') AS fecha,
  strftime({local_sql('e.fecha_hora_atencion')}, '%I:%M %p') AS hora,
  CASE WHEN nullif(e.profesional_responsable, '') IS NULL THEN COALESCE(nullif(e.responsable_registro, ''), 'Profesional de Staff')
       WHEN pr.id_personal_salud IS NULL THEN 'Desconocido' ELSE pr.nombre_completo END AS profesional,
  CASE WHEN json_valid(e.signos_vitales) THEN nullif(TRY_CAST(json_extract_string(e.signos_vitales, '$.fc') AS BIGINT), 0) END
    AS fc
FROM patients p JOIN encounters e ON e.documento_id = p.documento_id
LEFT JOIN professionals pr ON pr.id_personal_salud = nullif(e.profesional_responsable, '')
WHERE p.tipo_usuario = 'paciente'"""))
def patient_page(spark, d):
    from ehrflow.operators.views import patient_page as page
    t = {"usuario": _pats(spark, d), "atencion": _encs(spark, d), "profesional_salud": _profs(spark, d)}
    pages = page(t, _pats(spark, d).select("documento_id"), M.AS_OF_DATE)
    a = pages.select("documento_id", F.col("edad").cast("long").alias("edad"), F.explode("atenciones").alias("a"))
    return a.select("documento_id", "edad", F.col("a.atencion_id").alias("atencion_id"),
                    S.fmt("a.fecha_hora_atencion", "long_date").alias("fecha"),
                    S.fmt("a.fecha_hora_atencion", "clock").alias("hora"),
                    F.col("a.profesional_responsable_nombre").alias("profesional"),
                    S.vital(F.col("a.signos_vitales"), "fc", "bigint").alias("fc"))


# ------------------------------- what clinicians and admissions look up ---

@register("clinician_lookup", M.with_ctes(M.PATIENTS_SQL, M.ENCOUNTERS_SQL, M.PROFESSIONALS_SQL, body=f"""
SELECT p.documento_id, CAST(COALESCE({age_sql('p.fecha_nacimiento')}, p.edad) AS BIGINT) AS edad, e.atencion_id,
  strftime({local_sql('e.fecha_hora_atencion')}, '%d/%m/%Y %H:%M') AS fecha, e.signos_vitales,
  CASE WHEN e.atencion_id IS NULL THEN NULL WHEN nullif(e.profesional_responsable, '') IS NULL THEN 'No especificado'
       WHEN pr.id_personal_salud IS NULL THEN 'Desconocido' ELSE pr.nombre_completo END AS profesional
FROM patients p LEFT JOIN encounters e ON e.documento_id = p.documento_id
LEFT JOIN professionals pr ON pr.id_personal_salud = nullif(e.profesional_responsable, '')"""))
def clinician_lookup(spark, d):
    from ehrflow.operators.views import clinician_lookup as lookup
    return _looked_up(lookup(_role_tables(spark, d), _pats(spark, d).select("documento_id"), M.AS_OF_DATE))


@register("admission_lookup", M.with_ctes(M.PATIENTS_SQL, M.ENCOUNTERS_SQL, body="""
SELECT p.documento_id, CAST(p.edad AS BIGINT) AS edad, e.atencion_id,
  strftime(e.fecha_hora_atencion, '%d/%m/%Y %H:%M') AS fecha, e.signos_vitales, CAST(NULL AS VARCHAR) AS profesional
FROM patients p LEFT JOIN encounters e ON e.documento_id = p.documento_id"""))
def admission_lookup(spark, d):
    from ehrflow.operators.views import admission_lookup as lookup
    return _looked_up(lookup(_role_tables(spark, d), _pats(spark, d).select("documento_id")))


def _role_tables(spark, d):
    return {"usuario": _pats(spark, d), "atencion": _encs(spark, d), "profesional_salud": _profs(spark, d)}


def _looked_up(found):
    a = found.select("documento_id", F.col("edad").cast("long").alias("edad"), F.explode_outer("atenciones").alias("a"))
    return a.select("documento_id", "edad", F.col("a.atencion_id").alias("atencion_id"), S.fmt("a.fecha_hora_atencion", "stamp").alias("fecha"),
                    F.col("a.signos_vitales").alias("signos_vitales"), F.col("a.profesional_responsable_nombre").alias("profesional"))
