"""Longitudinal history: patient ⟕ encounters ⟕ professional, counts,
foreign-key resolution and child rows.

Layout notes (see :mod:`ehrflow.plans.layout`): patients, encounters and
child tables are bucketed by ``documento_id`` so every join below on that
key is shuffle-free; whether the professionals table is broadcast is left to
Spark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ehrflow.functions import scalars as S

# The three name policies for the responsible professional:
# (fallback when the reference is empty, fallback when it matches nothing,
#  whether the empty case first falls back to responsable_registro)
NAME_POLICIES = {
    "clinician": (S.NO_PROFESSIONAL, S.UNKNOWN_PROFESSIONAL, False),
    "patient": (S.STAFF_PROFESSIONAL, S.UNKNOWN_PROFESSIONAL, True),
    "export": (S.ON_DUTY_PROFESSIONAL, S.PENDING_SIGNATURE, True),
}


def with_professional(encounters: DataFrame, professionals: DataFrame, policy: str | dict[str, str] = "clinician",
                      out: str = "profesional_nombre") -> DataFrame:
    """The responsible professional's display name under ``policy``, as
    column ``out``; with a mapping of column names to policies, several
    names from the same join.

    One left join replaces the per-encounter lookups. A reference that
    matches a professional whose name is NULL yields NULL (the test is "row
    matched", not "name present").
    """
    prof = professionals.select(
        F.col("id_personal_salud").alias("_pid"),
        F.col("nombre_completo").alias("_pname"),
        F.lit(True).alias("_matched"))
    fk = F.nullif(F.col("profesional_responsable"), F.lit(""))
    names = {}
    for name, chosen in (policy if isinstance(policy, dict) else {out: policy}).items():
        if_empty, if_unmatched, use_registro = NAME_POLICIES[chosen]
        empty_name = S.falsy_or("responsable_registro", if_empty) if use_registro else F.lit(if_empty)
        names[name] = (F.when(fk.isNull(), empty_name)
                       .when(F.col("_matched").isNull(), F.lit(if_unmatched))
                       .otherwise(F.col("_pname")))
    return encounters.join(prof, fk == prof["_pid"], "left").withColumns(names).drop("_pid", "_pname", "_matched")


def encounter_view(encounters: DataFrame, professionals: DataFrame | None = None,
                   policy: str = "clinician", zone: str = S.LOCAL_ZONE) -> DataFrame:
    """Encounters as a history shows them: local wall time, parsed vitals
    and (when professionals are given) the professional's name."""
    df = encounters.withColumn("fecha_hora_local", S.to_local("fecha_hora_atencion", zone))
    if "signos_vitales" in df.columns:
        df = df.withColumn("signos_vitales_json", S.parse_vitals("signos_vitales"))
    if professionals is not None:
        df = with_professional(df, professionals, policy)
    return df


def patient_view(patients: DataFrame, as_of, recompute_age: bool = True) -> DataFrame:
    """Patients with the displayed age."""
    return patients.withColumn("edad", S.display_age("fecha_nacimiento", "edad", as_of, recompute_age))


def patient_history_rows(patients: DataFrame, encounters: DataFrame, keys: DataFrame | None = None,
                         count: str | None = None) -> DataFrame:
    """C1 in long form: one row per (patient, encounter); a patient with no
    encounters appears once with NULL encounter columns. With ``count``, each
    row also has its patient's number of encounters (D2). ``keys`` is the
    encounter table to count in, when ``encounters`` has been joined to others
    before (the counts then need none of that).

    The counts are joined to the patients, one row each. Patients that have
    encounters are joined to them on the complement of the key: that is the
    same equality, but both sides get an exchange of their own for it, and
    those AQE can split for a patient with very many encounters (it cannot
    split the output of the aggregate).
    """
    n = count or "_n"
    enc_cols = [c for c in encounters.columns if c != "documento_id"]
    clash = set(enc_cols) & set(patients.columns)
    enc = encounters.select(F.bitwise_not("documento_id").alias("_key"),
                            *[F.col(c).alias(f"atencion_{c}" if c in clash else c) for c in enc_cols])
    counted = encounter_counts(patients, keys if keys is not None else encounters, n)
    with_enc = (counted.filter(F.col(n) > 0).withColumn("_key", F.bitwise_not("documento_id"))
                .join(enc, "_key").drop("_key"))
    empty = counted.filter(F.col(n) == 0).withColumns(
        {f.name: F.lit(None).cast(f.dataType) for f in enc.schema.fields if f.name != "_key"})
    out = with_enc.unionByName(empty)
    return out if count else out.drop(n)


def encounter_counts(patients: DataFrame, encounters: DataFrame, out: str = "n_atenciones") -> DataFrame:
    """Encounters per patient, 0 when none. Counted with a partial
    (map-side) aggregate, then one join on the bucketing key."""
    counts = encounters.groupBy("documento_id").agg(F.count(F.lit(1)).alias(out))
    return (patients.join(counts, "documento_id", "left")
            .withColumn(out, F.coalesce(F.col(out), F.lit(0).cast("long"))))


def month_of(ts) -> Column:
    """The first day of a time's calendar month; NULL for NULL."""
    t = F.col(ts) if isinstance(ts, str) else ts
    return F.make_date(F.year(t), F.month(t), F.lit(1))


def patient_history(patients: DataFrame, encounters: DataFrame, fields: Sequence[str] | None = None,
                    order: Sequence[str] = ("fecha_hora_atencion", "atencion_id"), keys: DataFrame | None = None) -> DataFrame:
    """C1 nested (D3, F3): one row per patient and calendar month ``mes`` (of
    the first ``order`` column) with the list ``atenciones`` of that month's
    encounter structs, newest first by ``order`` (time, then ``atencion_id``
    to break ties). A patient without encounters has one row with ``mes``
    NULL and ``[]``.

    Every patient has this shape, whatever the number of encounters: read by
    ``mes``, newest first, the lists are the whole timeline in order. The
    encounters of one patient are gathered by (patient, month), so by many
    tasks, and no row holds more than a month; the lists are joined to their
    patients on a key of its own, which AQE can split (see
    :func:`patient_history_rows`, also for ``keys``).
    """
    fields = list(fields or [c for c in encounters.columns if c != "documento_id"])
    order_first = list(order)
    struct_fields = order_first + [c for c in fields if c not in order_first]
    collected = F.collect_list(F.struct(*struct_fields))
    types = {f.name: f.dataType.typeName() for f in encounters.schema.fields}
    if any(types.get(c) in ("variant", "map") for c in struct_fields):
        # Structs holding VARIANT or MAP values are not orderable as a whole:
        # compare the order fields only.
        def newest_first(x, y):
            out = F.lit(0)
            for c in reversed(order_first):
                out = F.when(x[c] > y[c], -1).when(x[c] < y[c], 1).otherwise(out)
            return out
        ordered = F.array_sort(collected, newest_first)
    else:
        ordered = F.sort_array(collected, asc=False)
    lists = encounters.groupBy("documento_id", month_of(order_first[0]).alias("mes")).agg(ordered.alias("atenciones"))
    lists = lists.select(F.bitwise_not("documento_id").alias("_key"), "mes", "atenciones")
    any_ = (keys if keys is not None else encounters).select("documento_id", F.lit(True).alias("_any")).distinct()
    known = patients.join(any_, "documento_id", "left")
    with_any = known.filter("_any").withColumn("_key", F.bitwise_not("documento_id")).join(lists, "_key").drop("_key")
    none = known.filter("_any is null").withColumns({"mes": F.lit(None).cast("date"), "atenciones": F.array().cast(lists.schema["atenciones"].dataType)})
    return with_any.unionByName(none).drop("_any")


def resolve_fk(df: DataFrame, dim: DataFrame, on: str, dim_name: str, dim_key: str,
               out: str) -> DataFrame:
    """Scalar-subquery ``(SELECT key FROM dim WHERE name = x LIMIT 1)``
    as one join. The dimension is reduced to one key per name (lowest key)
    first; no match -> NULL."""
    one = dim.groupBy(dim_name).agg(F.min(dim_key).alias(out))
    return df.join(one, df[on] == one[dim_name], "left").drop(one[dim_name])


def with_children(encounters: DataFrame, children: DataFrame, how: str = "left") -> DataFrame:
    """Child rows on the composite key (``documento_id``, ``atencion_id``);
    with equal bucketing of both tables the join needs no exchange."""
    return encounters.join(children, ["documento_id", "atencion_id"], how)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``count(*)`` per table as one (tabla, n) frame."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tabla"), "n")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
