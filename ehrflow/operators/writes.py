"""Set-based writes: conflict-checked patient inserts, sparse patches,
enriched encounter inserts, insert-or-ignore and cascading deletes.

Each returns new DataFrames (accepted / rejected / new table); the caller
writes them to a new path (plain parquet tables have no MERGE).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ehrflow.functions import scalars as S
from ehrflow.operators.conflicts import MAX_COMPONENT, accepted_rows
from ehrflow.operators.lookup import exists_flag, first_per, missing_in
from ehrflow.session import scratch_path, shared_table
from ehrflow.sources import fields as J
from ehrflow.sources.schemas import (ATENCION_LENGTHS, ENCOUNTER_OPTIONAL, ENCOUNTER_REQUIRED, PATCH_FIELDS,
                                     USUARIO, USUARIO_LENGTHS)

# Rejection reasons.
REASON_DOCUMENT = "documento"
REASON_EMAIL = "correo"
REASON_NO_PATIENT = "paciente_no_existe"
REASON_MISSING = "campo_requerido"
REASON_TOO_LONG = "longitud"
REASON_UNKNOWN_ID = "no_existe"
REASON_BAD_TYPE = "tipo_invalido"
REASON_NO_USER = "no_autenticado"
REASON_ROLE = "rol_no_permitido"


def _conform(df: DataFrame, schema, keep: Sequence[str] = ()) -> DataFrame:
    """Select ``schema``'s columns in order (NULL for the missing ones),
    followed by the ``keep`` columns."""
    cols = []
    for f in schema.fields:
        if f.name in df.columns:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols, *keep)


_NO_EMAIL = "\u0001"


def _email_key(col: str = "correo_electronico"):
    """E-mail as a join key where NULL equals NULL (the reference compares
    with ``== None``, which renders ``IS NULL``)."""
    c = F.col(col)
    return F.when(c.isNull(), F.lit(_NO_EMAIL)).otherwise(F.concat(F.lit("\u0002"), c))


def _role_problem(df: DataFrame, users: DataFrame, by: str, role: str) -> tuple[DataFrame, Column]:
    """``df`` with the role of the user in column ``by``, and the reason a
    user may not write: unknown (401), or another role than ``role`` (403)."""
    known = users.select(F.col("documento_id").alias("_by"), F.col("tipo_usuario").alias("_role"), F.lit(True).alias("_user"))
    joined = df.join(known, F.col(by) == F.col("_by"), "left").drop("_by")
    return joined, (F.when(F.col("_user").isNull(), F.lit(REASON_NO_USER))
                    .when(~S.role_in("_role", [role]), F.lit(REASON_ROLE)))


def _too_long(df: DataFrame, limits: dict[str, int]) -> Column:
    out = F.lit(False)
    for c, n in limits.items():
        if c in df.columns:
            out = out | F.coalesce(F.char_length(c) > n, F.lit(False))
    return out


def insert_patients(current: DataFrame, batch: DataFrame, as_of_utc, seq: str = "seq",
                    users: DataFrame | None = None, by: str = "principal_id", max_component: int = MAX_COMPONENT,
                    folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Insert new patients as the reference does one request at a time,
    in arrival order ``seq``: a row is rejected when its document already
    exists (checked first), else when its e-mail already exists (NULL-safe);
    an accepted row counts against every later one. Before that: with
    ``users``, the user in column ``by`` must be known and an admissions clerk;
    the document and the password hash must be there; texts must keep their
    lengths.

    Returns ``(accepted, rejected)``: accepted rows in table shape (role forced
    to ``paciente``, age computed, audit stamps set), rejected rows as
    (documento_id, seq, motivo). Rows have a number of their own, so equal or
    missing ``seq`` values do no harm: equal ones are taken in the order of
    their contents, missing ones last.

    Conflicts inside the batch are resolved on the keys alone
    (:mod:`ehrflow.operators.conflicts`): a few rounds for the rows that are
    first in their groups, then each component of rows tied by documents and
    e-mails is replayed in order by one task; only a component of more than
    ``max_component`` rows needs further rounds. The work is kept in a folder
    below ``spark.checkpoint.dir``, or in ``folder``, which the caller may
    delete (:func:`ehrflow.session.drop_path`) when the results are written.
    """
    as_of = S.ntz_lit(as_of_utc)
    checked, problem = _role_problem(batch, users, by, "admisionista") if users is not None else (batch, F.lit(None).cast("string"))
    why = F.coalesce(problem, F.when(F.col("documento_id").isNull() | F.col("hashed_password").isNull(), F.lit(REASON_MISSING)),
                     F.when(_too_long(batch, USUARIO_LENGTHS), F.lit(REASON_TOO_LONG)))
    folder = folder or scratch_path(batch.sparkSession, "insert")
    order = F.struct(F.col(seq).isNull().alias("n"), F.col(seq).alias("s"), F.xxhash64(*[c for c in batch.columns]).alias("h"), F.col("_rid").alias("r"))
    rows = shared_table(checked.select(*batch.columns, why.alias("_why"), _email_key().alias("_ek"), F.monotonically_increasing_id().alias("_rid")), f"{folder}/rows")
    keys = rows.filter(F.col("_why").isNull()).select("_rid", "documento_id", "_ek", order.alias("_ord"))

    cur_docs = current.select("documento_id", F.lit(True).alias("_doc_taken"))               # primary key
    cur_mail = shared_table(current.select(_email_key().alias("_ek")).distinct().withColumn("_mail_taken", F.lit(True)), f"{folder}/mails")
    no_mail = F.col("_ek") == _NO_EMAIL
    null_taken = cur_mail.filter(no_mail).limit(1).count() > 0
    known = keys.join(cur_docs, "documento_id", "left")
    flagged = shared_table(known.filter(~no_mail).join(cur_mail, "_ek", "left").unionByName(
        known.filter(no_mail).withColumn("_mail_taken", F.lit(True) if null_taken else F.lit(None).cast("boolean"))), f"{folder}/flagged")
    undecided = flagged.filter(F.col("_doc_taken").isNull() & F.col("_mail_taken").isNull()).select("_rid", "documento_id", "_ek", "_ord")
    accepted = accepted_rows(undecided, no_mail, folder, max_component=max_component)
    # Reasons, in the reference's order: the document is checked first
    # against the stored rows and every earlier accepted batch row, then
    # the e-mail. Accepted rows are unique per document.
    acc_doc = accepted.select("documento_id", F.col("_ord").alias("_a_ord"))
    lost = (flagged.join(accepted.select("_rid"), "_rid", "left_anti").join(acc_doc, "documento_id", "left")
            .select("documento_id", F.col("_ord.s").alias(seq),
                    F.when(F.col("_doc_taken").isNotNull() | (F.col("_a_ord") < F.col("_ord")), REASON_DOCUMENT)
                    .otherwise(REASON_EMAIL).alias("motivo")))
    invalid = rows.filter(F.col("_why").isNotNull()).select("documento_id", seq, F.col("_why").alias("motivo"))
    table = (rows.join(accepted.select("_rid"), "_rid", "left_semi")
             .withColumn("tipo_usuario", F.lit("paciente"))
             .withColumn("edad", S.age_years("fecha_nacimiento", S.local_today(as_of)))
             .withColumn("created_at", as_of).withColumn("updated_at", as_of))
    return _conform(table, USUARIO, keep=[seq]), invalid.unionByName(lost)


def insert_or_ignore(current: DataFrame, batch: DataFrame, keys: Sequence[str] | None,
                     seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """I4 + G1: ``INSERT ... ON CONFLICT DO NOTHING``. Within the batch the
    first arrival per key wins; keys already present are skipped. With
    ``keys=None`` every row is appended (no natural key). Returns
    ``(new_table, inserted)``."""
    if keys is None:
        inserted = batch.drop(seq) if seq in batch.columns else batch
    else:
        keys = list(keys)
        firsts = first_per(batch, keys, [seq])
        inserted = missing_in(firsts, current, keys).drop(seq)
    return current.unionByName(inserted, allowMissingColumns=True), inserted


_DOB_SET = "_fecha_nacimiento_no_nula"
_PATCH_KINDS = {f: {"fecha_nacimiento": "date", "edad": "int"}.get(f, "text") for f in PATCH_FIELDS}


def patch_patients(current: DataFrame, patches: DataFrame, as_of_utc, patch: str = "patch",
                   seq: str = "seq", users: DataFrame | None = None, by: str = "principal_id") -> tuple[DataFrame, DataFrame]:
    """Sparse patches ``(documento_id, seq, patch JSON text)``.

    Only known keys present in a patch change a field; an explicit ``null``
    sets NULL; several patches per patient apply in ``seq`` order, equal ones
    in the order of their text (per field the last present value wins, kept
    inside a struct so "last value is null" differs from "never present"). Age
    is recomputed when a non-null birth date is patched at or after the last
    explicit age; e-mail uniqueness is not rechecked; ``updated_at`` moves
    only when a value changed.

    Rejected, in this order: with ``users``, a user in column ``by`` that is
    unknown or no admissions clerk; text that is no JSON object or has a value
    of the wrong type, or over its length (:mod:`ehrflow.sources.fields`; no
    text ends the job, and of a repeated key the last value counts); unknown
    ids.

    Each patch is read on its own row and exploded into one row per present
    field; the last value per (patient, field) is a partial aggregate, and the
    per-patient change set is bounded by the number of fields, so many patches
    for one patient never gather in one buffer.
    Returns ``(patched_table, rejected)``.
    """
    as_of = S.ntz_lit(as_of_utc)
    fields = list(PATCH_FIELDS)
    p, problem = _role_problem(patches, users, by, "admisionista") if users is not None else (patches, F.lit(None).cast("string"))
    p = p.select("documento_id", F.struct(F.col(seq).alias("s"), F.xxhash64(patch).alias("h")).alias("_ord"), problem.alias("_who"), F.col(patch).alias("_text"))
    p = J.read(p, "_text", _PATCH_KINDS, USUARIO_LENGTHS)
    p = exists_flag(p, current.select("documento_id"), "documento_id", "_known", unique=True)
    bad = F.when(F.col("_why") == J.NO_OBJECT, F.lit(REASON_BAD_TYPE)).otherwise(F.col("_why"))
    why = F.coalesce("_who", bad, F.when(~F.col("_known"), F.lit(REASON_UNKNOWN_ID)))
    rejected = p.filter(why.isNotNull()).select("documento_id", F.col("_ord.s").alias(seq), why.alias("motivo"))

    # Long form: one row per present field; a non-null birth date also
    # yields a marker entry that carries the value used for the age.
    present = [f"CASE WHEN _has_{f} THEN struct('{f}' AS f, _v_{f} AS v) END" for f in fields]
    present.append(f"CASE WHEN _v_fecha_nacimiento IS NOT NULL THEN struct('{_DOB_SET}' AS f, _v_fecha_nacimiento AS v) END")
    long = (p.filter(why.isNull()).selectExpr("documento_id", "_ord", f"explode(array_compact(array({', '.join(present)}))) AS _x")
            .selectExpr("documento_id", f"_ord AS `{seq}`", "_x.f AS _f", "_x.v AS _val"))
    last = long.groupBy("documento_id", "_f").agg(
        F.max_by(F.struct(F.col("_val").alias("v")), F.col(seq)).alias("_v"),
        F.max(seq).alias("_s"))
    changes = last.groupBy("documento_id").agg(
        F.map_from_entries(F.collect_list(F.struct("_f", F.struct("_v", "_s")))).alias("_chg"))

    out = current.join(changes, "documento_id", "left")

    has = lambda f: f"coalesce(map_contains_key(_chg, '{f}'), false)"
    val = lambda f: f"element_at(_chg, '{f}')._v.v"
    at = lambda f: f"element_at(_chg, '{f}')._s"
    news = {f: f"CASE WHEN {has(f)} THEN try_cast({val(f)} AS {current.schema[f].dataType.simpleString()}) ELSE `{f}` END" for f in fields}
    out = out.selectExpr(*[f"`{c}`" for c in current.columns if c not in news], "_chg", *[f"{v} AS `{k}`" for k, v in news.items()],
                         *[f"`{k}` AS `_o_{k}`" for k in news], f"{has(_DOB_SET)} AND (NOT {has('edad')} OR {at(_DOB_SET)} >= {at('edad')}) AS _recompute",
                         f"CAST({val(_DOB_SET)} AS DATE) AS _born")
    out = out.withColumn("edad", F.when(F.col("_recompute"), S.age_years("_born", S.local_today(as_of)).cast(current.schema["edad"].dataType)).otherwise(F.col("edad")))
    changed = F.expr(" OR ".join(f"NOT (`{f}` <=> `_o_{f}`)" for f in fields))
    if "updated_at" in current.columns:
        out = out.withColumn("updated_at", F.when(F.col("_chg").isNotNull() & changed, as_of)
                             .otherwise(F.col("updated_at")))
    return out.select(*current.columns), rejected


def encounter_outcomes(patients: DataFrame, batch: DataFrame, users: DataFrame, as_of_utc,
                       seq: str = "seq", clinician: str = "clinician_id", random_ids: bool = False) -> DataFrame:
    """Every new-encounter command with its outcome, in one frame and one
    pass over the commands: ``estado`` (``aceptado`` or ``rechazado``),
    ``motivo``, and for accepted ones the encounter row.

    Checks, in the order of the request's: the signer (column ``clinician``)
    must be a known user and a clinician; required fields and the length of
    ``tipo_atencion``; the patient must exist. Accepted rows get the encounter
    time (``as_of``), the signature ``Dr. {nombre} {apellido}`` (``None`` for
    a missing part), a NULL professional reference (the reference's user rows
    carry no professional id) and NULL for optional fields that were blank.
    The encounter key is a content hash of (documento_id, seq, clinician) so
    reruns are idempotent, or a random UUID with ``random_ids=True``.
    """
    as_of = S.ntz_lit(as_of_utc)
    signers = users.select(F.col("documento_id").alias("_by"), F.col("tipo_usuario").alias("_role"), F.lit(True).alias("_user"),
                           F.col("primer_nombre").alias("_n"), F.col("primer_apellido").alias("_a"))
    missing = F.lit(False)
    for c in ENCOUNTER_REQUIRED:
        missing = missing | F.col(c).isNull()
    df = batch.join(signers, F.col(clinician) == F.col("_by"), "left")
    df = exists_flag(df, patients.select("documento_id"), "documento_id", "_known", unique=True)
    why = (F.when(F.col("_user").isNull(), REASON_NO_USER).when(~S.role_in("_role", ["medico"]), REASON_ROLE)
           .when(missing, REASON_MISSING).when(_too_long(batch, ATENCION_LENGTHS), REASON_TOO_LONG)
           .when(~F.col("_known"), REASON_NO_PATIENT))
    ok = F.col("motivo").isNull()
    blank = {c: S.blank_to_null(c) for c, t in batch.dtypes if c in ENCOUNTER_OPTIONAL and t == "string"}
    key = S.random_key() if random_ids else S.content_key("documento_id", seq, clinician)
    made = {"atencion_id": key, "fecha_hora_atencion": as_of, "profesional_responsable": F.lit(None).cast("string"),
            "responsable_registro": S.signature("_n", "_a"), "created_at": as_of, "updated_at": as_of}
    return (df.withColumn("motivo", why).withColumns({**blank, **{c: F.when(ok, v) for c, v in made.items()}})
            .withColumn("estado", F.when(ok, "aceptado").otherwise("rechazado"))
            .drop("_by", "_role", "_user", "_n", "_a", "_known"))


def insert_encounters(patients: DataFrame, batch: DataFrame, users: DataFrame, as_of_utc, **options) -> tuple[DataFrame, DataFrame]:
    """:func:`encounter_outcomes` as (accepted encounter rows, rejected rows
    as (documento_id, seq, motivo))."""
    out = encounter_outcomes(patients, batch, users, as_of_utc, **options)
    return (out.filter("estado = 'aceptado'").drop("estado", "motivo"),
            out.filter("estado = 'rechazado'").select("documento_id", options.get("seq", "seq"), "motivo"))


def cascade_delete(tables: dict[str, DataFrame], ids: DataFrame, folder: str | None = None) -> dict[str, DataFrame]:
    """Delete patients and, following the cascading foreign keys, their
    encounters and the encounters' diagnoses, technologies and discharges.
    Every patient-rooted table carries ``documento_id``, so each table is one
    anti join against the distinct ids, which are written first: the joins
    then read them through exchanges of their own, and AQE can split a patient
    with very many rows. ``folder`` names where, if the caller is to delete it."""
    keys = shared_table(ids.select("documento_id").distinct(), folder)
    out = {}
    for name, df in tables.items():
        out[name] = df.join(keys, "documento_id", "left_anti") if "documento_id" in df.columns else df
    return out


def delete_encounters(tables: dict[str, DataFrame], keys: DataFrame, folder: str | None = None) -> dict[str, DataFrame]:
    """I5 on the composite key: deleting encounters removes their child rows
    (diagnostico, tecnologia_salud, egreso)."""
    k = shared_table(keys.select("documento_id", "atencion_id").distinct(), folder)
    out = dict(tables)
    for name in ("atencion", "diagnostico", "tecnologia_salud", "egreso"):
        if name in tables:
            out[name] = tables[name].join(k, ["documento_id", "atencion_id"], "left_anti")
    return out
