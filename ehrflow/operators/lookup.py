"""Lookups, existence tests and first-match.

The reference answers these one key at a time; here every lookup takes a
table of keys and runs as one semi/anti join. Which side is broadcast is left
to Spark: its size statistics before, and adaptive execution during the run.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ehrflow.functions.scalars import role_in

def _keys_frame(df: DataFrame, ids, key: str) -> DataFrame:
    if isinstance(ids, DataFrame):
        return ids.select(F.col(ids.columns[0]).alias(key)) if key not in ids.columns else ids.select(key)
    spark = df.sparkSession
    return spark.createDataFrame([(int(i),) for i in ids], f"{key} long")


def patients_by_id(patients: DataFrame, ids, key: str = "documento_id") -> DataFrame:
    """B1: rows whose key is in ``ids`` (a DataFrame of keys or a short
    list). A list becomes an ``isin`` filter that reaches the parquet scan;
    a key table becomes a left-semi join."""
    if not isinstance(ids, DataFrame):
        return patients.filter(F.col(key).isin([int(i) for i in ids]))
    return patients.join(_keys_frame(patients, ids, key).distinct(), key, "left_semi")


def encounters_of(encounters: DataFrame, ids, key: str = "documento_id") -> DataFrame:
    """All encounters of the given patients."""
    return patients_by_id(encounters, ids, key)


def first_per(df: DataFrame, by: Sequence[str], order: Sequence[str], descending: bool = False) -> DataFrame:
    """One row per ``by`` group, the first by the ``order`` columns
    (lexicographic, ascending unless ``descending``). The reference takes
    an arbitrary first row; ours is deterministic.

    The smallest (largest) struct of the order columns, a hash of the row and
    the row: a partial aggregate, so a group holding a large share of the rows
    is reduced map-side instead of being buffered in one task the way a
    ``row_number`` window would. Rows equal in all order columns are decided by
    the hash and then by their values, so the result does not depend on the
    partitioning or on retried tasks. Columns without an order (VARIANT, maps)
    count through the hash of the others alone.
    """
    rest = [c for c in df.columns if c not in by]
    bare = [c for c, t in df.dtypes if not ("variant" in t or "map<" in t)]
    hashed = F.xxhash64(*bare).alias("_h")
    if set(bare) == set(df.columns):
        rows = F.struct(F.struct(*order).alias("_o"), hashed, F.struct(*rest).alias("_row"))
        best = (F.max if descending else F.min)(rows)["_row"].alias("_row")
    else:
        best = (F.max_by if descending else F.min_by)(F.struct(*rest), F.struct(F.struct(*order), hashed, F.struct(*bare))).alias("_row")
    return df.groupBy(*by).agg(best).select(*by, *[F.col("_row")[c].alias(c) for c in rest])


def patients_by_email(patients: DataFrame, emails: DataFrame, email_col: str = "correo_electronico",
                      key: str = "documento_id") -> DataFrame:
    """B2: per requested e-mail, the first matching patient (lowest key);
    e-mail is not unique in the store."""
    req = emails.select(F.col(emails.columns[0]).alias(email_col)).distinct()
    matches = patients.join(req, email_col, "left_semi")
    return first_per(matches, [email_col], [key])


def with_role(df: DataFrame, roles: Iterable[str], role_col: str = "tipo_usuario") -> DataFrame:
    """Rows whose role is one of ``roles``; a NULL role never is."""
    return df.filter(role_in(role_col, roles))


def prefix_count(df: DataFrame, col: str, prefix: str) -> DataFrame:
    """B6 + D1: ``count(*) WHERE col LIKE 'prefix%'`` (pushed to the scan
    as StartsWith)."""
    return df.filter(F.col(col).startswith(prefix)).agg(F.count(F.lit(1)).alias("n"))


def missing_in(df: DataFrame, other: DataFrame, on) -> DataFrame:
    """Rows without a match in ``other``. The right side is reduced to
    distinct keys first (partial aggregation collapses hot keys before the
    shuffle)."""
    keys = [on] if isinstance(on, str) else list(on)
    return df.join(other.select(*keys).distinct(), keys, "left_anti")


def exists_flag(df: DataFrame, other: DataFrame, on, out: str, null_safe: bool = False,
                unique: bool = False) -> DataFrame:
    """C3/C4 as one column: ``out`` is true when the row has a match in
    ``other`` (``EXISTS``), false otherwise. One left join against the
    distinct keys of ``other`` (reduced map-side) replaces a semi join plus
    an anti join. With ``null_safe`` a NULL key matches a NULL key. Pass
    ``unique=True`` when the keys are ``other``'s primary key (J1 checks it):
    the distinct step, an aggregation over all of ``other``, is skipped."""
    keys = [on] if isinstance(on, str) else list(on)
    right = other.select(*[F.col(k).alias(f"_r_{k}") for k in keys])
    if not unique:
        right = right.distinct()
    right = right.withColumn(out, F.lit(True))
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(right[f"_r_{k}"]) if null_safe else (F.col(k) == right[f"_r_{k}"])
        cond = c if cond is None else cond & c
    joined = df.join(right, cond, "left").drop(*[f"_r_{k}" for k in keys])
    return joined.withColumn(out, F.coalesce(F.col(out), F.lit(False)))


def nth_row(df: DataFrame, n: int, order: Sequence[Column | str]) -> DataFrame:
    """``ORDER BY order LIMIT 1 OFFSET n`` (an order is mandatory here;
    the reference's is storage order). A top-(n+1) sort, not a full one."""
    return df.orderBy(*order).offset(n).limit(1)
