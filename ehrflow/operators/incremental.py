"""C1/D2/D3 kept up to date: month lists and counts of stored histories merged
with a change set of encounters, without reading the encounters again.

A change is an encounter row with ``borrado`` (true: the encounter goes); a row
that is not deleted replaces the stored encounter with its key or is new. Only
the (patient, month) lists that hold a changed encounter, or get one, are made
anew: a changed time moves an encounter from one list to another. Of several
changes of one encounter the last by ``seq`` counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ehrflow.operators.history import month_of
from ehrflow.operators.lookup import first_per

KEY = ["documento_id", "atencion_id"]
ORDER = ("fecha_hora_atencion", "atencion_id")


def month_lists(encounters: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """(documento_id, mes, atenciones): a patient's encounters of a month,
    newest first, as in :func:`ehrflow.operators.history.patient_history`."""
    rest = [c for c in encounters.columns if c not in (*order, "documento_id")]
    lists = F.sort_array(F.collect_list(F.struct(*order, *rest)), asc=False)
    return encounters.groupBy("documento_id", month_of(order[0]).alias("mes")).agg(lists.alias("atenciones"))


def counts(lists: DataFrame) -> DataFrame:
    """(documento_id, n_atenciones) of the patients that have encounters."""
    return lists.groupBy("documento_id").agg(F.sum(F.size("atenciones")).cast("long").alias("n_atenciones"))


def last_changes(changes: DataFrame, seq: str = "seq") -> DataFrame:
    """One change an encounter, the last."""
    return first_per(changes, KEY, [seq], descending=True).drop(seq)


def affected(stored: DataFrame, changes: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """(documento_id, mes) of the lists that hold a changed encounter or get
    one. Of the stored lists only the keys of changed patients are read."""
    held = (stored.join(changes.select("documento_id").distinct(), "documento_id", "left_semi")
            .select("documento_id", "mes", F.explode("atenciones.atencion_id").alias("atencion_id"))
            .join(changes.select(*KEY), KEY, "left_semi").select("documento_id", "mes"))
    return held.unionByName(changes.filter("NOT borrado").select("documento_id", month_of(order[0]).alias("mes"))).distinct()


def rebuilt(stored: DataFrame, changes: DataFrame, months: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """The new lists of ``months``: what they held, less changed encounters,
    and the changed ones that are not deleted. A list left empty is gone."""
    same = stored["documento_id"].eqNullSafe(F.col("_d")) & stored["mes"].eqNullSafe(F.col("_m"))
    old = (stored.join(months.select(F.col("documento_id").alias("_d"), F.col("mes").alias("_m")), same, "left_semi")
           .select("documento_id", F.explode("atenciones").alias("_x")).select("documento_id", "_x.*")
           .join(changes.select(*KEY), KEY, "left_anti"))
    return month_lists(old.unionByName(changes.filter("NOT borrado").select(*old.columns)), order)


def merge(stored: DataFrame, changes: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """All month lists after the changes (:func:`last_changes`): equal to a
    full rebuild. Lists that are not affected pass as they are."""
    months = affected(stored, changes, order)
    same = stored["documento_id"].eqNullSafe(F.col("_d")) & stored["mes"].eqNullSafe(F.col("_m"))
    untouched = stored.join(months.select(F.col("documento_id").alias("_d"), F.col("mes").alias("_m")), same, "left_anti")
    return untouched.unionByName(rebuilt(stored, changes, months, order).select(*stored.columns))


def merge_counts(old: DataFrame, stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Counts after the changes, from the old counts and the differences; a
    patient whose last encounter goes has no row, as in :func:`counts`."""
    gone = (stored.join(changes.select("documento_id").distinct(), "documento_id", "left_semi")
            .select("documento_id", F.explode("atenciones.atencion_id").alias("atencion_id"))
            .join(changes.select(*KEY), KEY, "left_semi").select("documento_id", F.lit(-1).alias("n")))
    came = changes.filter("NOT borrado").select("documento_id", F.lit(1).alias("n"))
    every = old.select("documento_id", F.col("n_atenciones").alias("n")).unionByName(gone.unionByName(came))
    return every.groupBy("documento_id").agg(F.sum("n").cast("long").alias("n_atenciones")).filter("n_atenciones > 0")
