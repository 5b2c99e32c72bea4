"""What each role reads, for many requests at once: the clinician's lookup,
the admissions lookup, the patient's own page and the history export.

Each function composes the operators of :mod:`ehrflow.operators.history`,
:mod:`ehrflow.operators.access` and :mod:`ehrflow.operators.documents`;
``tables`` holds ``usuario``, ``atencion`` and ``profesional_salud``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ehrflow.functions import scalars as S
from ehrflow.operators import history as H
from ehrflow.operators.access import visible_columns, visible_rows
from ehrflow.operators.documents import history_documents
from ehrflow.operators.lookup import patients_by_id
from ehrflow.session import shared_table
from ehrflow.sources.schemas import PUBLIC_ENCOUNTER_FIELDS


def _history(tables: dict[str, DataFrame], patients: DataFrame, policy: str | None, local: bool = True,
             parsed: bool = True) -> DataFrame:
    """Nested history as the views return it, the timeline ordered by the
    stored UTC instant (local wall time repeats an hour when daylight saving
    ends). ``policy``: whose name of the professional is shown (None: no
    name); ``local``: local times in place of the stored ones; ``parsed``:
    parsed vitals (invalid text becomes ``{}``) in place of the stored text."""
    enc = tables["atencion"].withColumn("_orden", F.col("fecha_hora_atencion"))
    name = F.lit(None).cast("string")
    if policy:
        enc, name = H.with_professional(enc, tables["profesional_salud"], policy), F.col("profesional_nombre")
    shown = {"profesional_responsable_nombre": name}
    if local:
        shown["fecha_hora_atencion"] = S.to_local("fecha_hora_atencion")
    if parsed:
        shown["signos_vitales"] = S.parse_vitals("signos_vitales")
    enc = enc.withColumns(shown)
    fields = [c for c in PUBLIC_ENCOUNTER_FIELDS if c in enc.columns]
    hist = H.patient_history(patients, enc.select("documento_id", "_orden", *fields), order=("_orden", "atencion_id"), keys=tables["atencion"])
    return hist.withColumn("atenciones", F.transform("atenciones", lambda a: a.dropFields("_orden")))


def clinician_lookup(tables: dict[str, DataFrame], ids: DataFrame, as_of_date) -> DataFrame:
    """Clinician lookup by document, as the application returns it:
    demographics with the recomputed age and the nested history (local times,
    vitals as stored, ``clinician`` name policy)."""
    pats = H.patient_view(patients_by_id(tables["usuario"], ids), as_of_date)
    return visible_columns(_history(tables, pats, "clinician", parsed=False), "medico")


def admission_lookup(tables: dict[str, DataFrame], ids: DataFrame, masked: bool = False) -> DataFrame:
    """Admissions lookup, as the application returns it: demographics with the
    stored age, and the nested history as stored (UTC times, vitals text, no
    professional's name). With ``masked``, demographics only."""
    pats = patients_by_id(tables["usuario"], ids)
    if masked:
        return visible_columns(pats, "admisionista")
    return visible_columns(_history(tables, pats, None, local=False, parsed=False), "admisionista", parity=True)


def patient_page(tables: dict[str, DataFrame], principals: DataFrame, as_of_date) -> DataFrame:
    """Each patient's own page: recomputed age, the nested history with the
    ``patient`` name policy; principals whose role is not ``paciente`` get
    nothing."""
    users = tables["usuario"]
    own = users.join(principals.select("documento_id"), "documento_id", "left_semi") \
        .filter(F.col("tipo_usuario") == "paciente")
    return visible_columns(_history(tables, H.patient_view(own, as_of_date), "patient"), "paciente")


def export_documents(tables: dict[str, DataFrame], requests: DataFrame, as_of_date, as_of_utc) -> DataFrame:
    """History export for export requests (solicitud_id, principal_id,
    documento_id) that pass the row rule: one document per allowed request
    and target patient. The allowed requests are written first: they are read
    three times."""
    allowed = shared_table(visible_rows(requests, tables["usuario"]).select("solicitud_id", "documento_id"))
    targets = allowed.select("documento_id").distinct()
    pats = H.patient_view(tables["usuario"].join(targets, "documento_id", "left_semi"), as_of_date)
    enc = tables["atencion"].join(targets, "documento_id", "left_semi")
    docs = history_documents(pats, enc, tables["profesional_salud"], as_of_utc)
    return allowed.join(docs, "documento_id", "inner")
