"""Visibility rules (role -> action, own-record row rule, column masks),
ordered request outcomes, and token validity as an as-of join over windows.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ehrflow.sources.schemas import PUBLIC_PATIENT_FIELDS

# Which role may perform which action.
ACCESS_RULES = [
    ("medico", "consulta_medico"),
    ("medico", "registrar_atencion"),
    ("admisionista", "admision_consulta"),
    ("admisionista", "admision_crear"),
    ("admisionista", "admision_actualizar"),
    ("paciente", "pagina_paciente"),
    ("medico", "exportar"),
    ("paciente", "exportar"),
]
# Actions that name a target patient that must exist (404 otherwise).
TARGETED_ACTIONS = ["consulta_medico", "registrar_atencion", "admision_consulta",
                    "admision_actualizar", "exportar"]
# Actions where a patient may only reach their own record.
OWN_RECORD_ACTIONS = ["exportar"]


def access_rules(spark: SparkSession) -> DataFrame:
    """K1: the (role, action) matrix as a small DataFrame (8 literal rows,
    always broadcast)."""
    rows = F.array(*[F.struct(F.lit(r).alias("rol"), F.lit(a).alias("accion")) for r, a in ACCESS_RULES])
    return F.broadcast(spark.range(1).select(F.inline(rows)))


def access_outcomes(requests: DataFrame, users: DataFrame, patients: DataFrame,
                    rules: DataFrame | None = None) -> DataFrame:
    """K4: status of each request (solicitud_id, principal_id, accion,
    documento_id) in the reference's order of checks:
    401 unknown principal, 403 role not allowed, 403 other patient's record,
    404 no such patient, else 200.

    The role is the user table's current value. Joins: principal (left, on
    the user key), rule (broadcast, 8 rows), target existence (left semi
    flag through a left join on distinct keys).
    """
    rules = rules if rules is not None else access_rules(requests.sparkSession)
    u = users.select(F.col("documento_id").alias("principal_id"), F.col("tipo_usuario").alias("rol"),
                     F.lit(True).alias("_known"))
    r = rules.select("rol", "accion", F.lit(True).alias("_allowed"))
    t = patients.select("documento_id").withColumn("_exists", F.lit(True))   # primary key
    df = (requests.join(u, "principal_id", "left")
          .join(r, ["rol", "accion"], "left")
          .join(t, "documento_id", "left"))
    status = (F.when(F.col("_known").isNull(), 401)
              .when(F.col("_allowed").isNull(), 403)
              .when(F.col("accion").isin(OWN_RECORD_ACTIONS) & (F.col("rol") == "paciente")
                    & (F.col("principal_id") != F.col("documento_id")), 403)
              .when(F.col("accion").isin(TARGETED_ACTIONS) & F.col("_exists").isNull(), 404)
              .otherwise(200))
    return df.select("solicitud_id", "principal_id", "accion", "documento_id", "rol",
                     status.alias("estado"))


def visible_rows(requests: DataFrame, users: DataFrame) -> DataFrame:
    """K2: export requests that pass the row rule: a clinician may export any
    record, a patient only their own; other roles none."""
    u = users.select(F.col("documento_id").alias("principal_id"), F.col("tipo_usuario").alias("rol"))
    df = requests.join(u, "principal_id", "inner")
    ok = (F.col("rol") == "medico") | ((F.col("rol") == "paciente") & (F.col("principal_id") == F.col("documento_id")))
    return df.filter(F.coalesce(ok, F.lit(False)))


def visible_columns(patients: DataFrame, role: str, parity: bool = False) -> DataFrame:
    """K3: the columns a role sees. The password hash is never visible.
    Admissions sees demographics; with ``parity=True`` it also gets the
    nested history when present (as the reference's response model does)."""
    cols = [c for c in PUBLIC_PATIENT_FIELDS if c in patients.columns]
    extra = [c for c in ("mes", "atenciones", "n_atenciones") if c in patients.columns]
    if role in ("medico", "paciente") or parity:
        cols += extra
    return patients.select(*cols)


def _floor_div(x, d: int):
    """Exact floor division of a long column by a positive constant, also
    for negative values: ``x - pmod(x, d)`` is an exact multiple of ``d``,
    so the quotient is an exactly representable integer (|x| < 2^53)."""
    return ((x - F.pmod(x, F.lit(d))) / F.lit(d)).cast("long")


def authorised_requests(requests: DataFrame, logins: DataFrame, ttl_minutes: int = 30,
                        key: str = "solicitud_id", user: str = "usuario", ts: str = "ts",
                        login_ts: str = "login_ts") -> DataFrame:
    """A request is authorised while the latest login of its user at or
    before it is still valid: ``trunc_sec(ts) <= trunc_sec(login + ttl)``.

    Time is cut into windows one second longer than the ttl, so a login that
    is valid for a request lies in the request's window or the one before.
    Logins stand in their own window and the next; within (user, window), in
    time order, the last login at or before a request is the one to test: one
    shuffle and one sort, no pairs, and a user with very many events is dealt
    out by window. Output: every request with ``login_ts`` (latest valid
    login, NULL if none) and ``autorizado``.
    """
    ttl_us, second = ttl_minutes * 60_000_000, 1_000_000
    width = ttl_us + second
    # Microseconds since 1970-01-01 on the wall clock of the stored values,
    # whatever the session time zone.
    epoch = F.lit(_dt.datetime(1970, 1, 1)).cast(requests.schema[ts].dataType)

    def micros(c):
        return F.timestamp_diff("MICROSECOND", epoch, F.col(c))

    own = F.struct(*requests.columns)
    req = requests.select(F.col(user).alias("_user"), micros(ts).alias("_us"), F.lit(1).alias("_kind"),
                          F.lit(None).cast(logins.schema[login_ts].dataType).alias("_login"), own.alias("_own"))
    req = req.withColumn("_window", _floor_div(F.col("_us"), width))
    lg = logins.select(F.col(user).alias("_user"), micros(login_ts).alias("_us"), F.lit(0).alias("_kind"), F.col(login_ts).alias("_login"),
                       F.lit(None).cast(req.schema["_own"].dataType).alias("_own")).distinct()
    at = _floor_div(F.col("_us"), width)
    lg = lg.withColumn("_window", F.explode(F.array(at, at + 1)))
    in_time = Window.partitionBy("_user", "_window").orderBy("_us", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    last = req.unionByName(lg).withColumn("_last", F.last("_login", ignorenulls=True).over(in_time)).filter("_kind = 1")
    valid = _floor_div(F.col("_us"), second) <= _floor_div(micros("_last") + ttl_us, second)
    valid = F.coalesce(valid & F.col("_user").isNotNull(), F.lit(False))
    return last.select("_own.*", F.when(valid, F.col("_last")).alias(login_ts), valid.alias("autorizado"))
