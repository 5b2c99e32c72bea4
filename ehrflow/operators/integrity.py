"""Integrity rules as violation reports: primary keys, NOT NULL, foreign
keys, text lengths, required command fields, and one union of them all.

Every report has the columns (regla, tabla, clave, detalle) so reports can
be unioned. The rules on single rows share one scan of their table; repeated
keys are one aggregation, and each foreign key is one anti join. No rule
collects rows to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPORT_COLUMNS = ["regla", "tabla", "clave", "detalle"]


def _key_text(keys: Sequence[str]):
    return F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("NULL")) for k in keys])


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key groups that occur more than once, with their size. A partial
    (map-side) count, so a hot key costs one row per task in the shuffle."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def repeated_keys(df: DataFrame, keys: Sequence[str], table: str) -> DataFrame:
    """Duplicate primary keys, one row per key group."""
    return duplicate_keys(df, keys).select(
        F.lit("pk_duplicada").alias("regla"), F.lit(table).alias("tabla"),
        _key_text(keys).alias("clave"), F.concat(F.lit("n="), F.col("n").cast("string")).alias("detalle"))


def pk_violations(df: DataFrame, keys: Sequence[str], table: str) -> DataFrame:
    """Duplicate primary keys (one row per key group) and rows with a
    NULL key part."""
    return repeated_keys(df, keys, table).unionByName(row_violations(df, keys, table))


def row_violations(df: DataFrame, keys: Sequence[str], table: str, not_null: Sequence[str] = (),
                   limits: dict[str, int] | None = None) -> DataFrame:
    """J1, J2, J4 in one pass: rows with a NULL key part, NULL in a NOT NULL
    column, and text over its limit (in characters)."""
    any_null = F.lit(False)
    for k in keys:
        any_null = any_null | F.col(k).isNull()

    def found(test, rule, detail):
        return F.when(test, F.struct(F.lit(rule).alias("regla"), F.lit(detail).alias("detalle")))

    tests = [found(any_null, "pk_nula", "clave nula"), *(found(F.col(c).isNull(), "no_nulo", c) for c in not_null),
             *(found(F.char_length(c) > n, "longitud", c) for c, n in (limits or {}).items() if c in df.columns)]
    return (df.select(_key_text(keys).alias("clave"), F.explode(F.array(*tests)).alias("x")).filter("x is not null")
            .select("x.regla", F.lit(table).alias("tabla"), "clave", "x.detalle"))


def _per_column(df: DataFrame, keys: Sequence[str], table: str, rule: str,
                tests: dict[str, object]) -> DataFrame:
    """One output row per (row, failing column): a single pass explodes the
    array of column names (NULL where the test passes) and keeps the
    non-NULL ones; no per-element lambda, so it stays in generated code."""
    names = F.array(*[F.when(t, F.lit(c)) for c, t in tests.items()])
    return (df.select(_key_text(keys).alias("clave"), F.explode(names).alias("detalle"))
            .filter(F.col("detalle").isNotNull())
            .select(F.lit(rule).alias("regla"), F.lit(table).alias("tabla"), "clave", "detalle"))


def null_violations(df: DataFrame, cols: Sequence[str], keys: Sequence[str], table: str) -> DataFrame:
    """NOT NULL columns that hold NULL."""
    return _per_column(df, keys, table, "no_nulo", {c: F.col(c).isNull() for c in cols})


def missing_required(df: DataFrame, cols: Sequence[str], keys: Sequence[str], table: str) -> DataFrame:
    """Required command fields that are absent (NULL). Empty text
    passes, as in the API."""
    return _per_column(df, keys, table, "requerido", {c: F.col(c).isNull() for c in cols})


def length_violations(df: DataFrame, limits: dict[str, int], keys: Sequence[str], table: str) -> DataFrame:
    """Text longer than its column's limit (in characters)."""
    tests = {c: F.char_length(F.col(c)) > n for c, n in limits.items() if c in df.columns}
    return _per_column(df, keys, table, "longitud", tests)


def fk_violations(child: DataFrame, parent: DataFrame, child_cols: Sequence[str],
                  parent_cols: Sequence[str], child_keys: Sequence[str], table: str,
                  parent_table: str) -> DataFrame:
    """Child rows whose (all non-NULL) reference has no parent row. A
    NULL in any reference column passes. The parent columns are its primary
    key, so the anti join reads them as they are (repeated parent keys would
    not change an anti join's result anyway)."""
    renamed = parent.select(*[F.col(p).alias(c) for p, c in zip(parent_cols, child_cols)])
    all_set = F.lit(True)
    for c in child_cols:
        all_set = all_set & F.col(c).isNotNull()
    orphans = child.filter(all_set).join(renamed, list(child_cols), "left_anti")
    return orphans.select(F.lit("fk").alias("regla"), F.lit(table).alias("tabla"),
                          _key_text(child_keys).alias("clave"),
                          F.concat(F.lit(f"{parent_table}("), _key_text(child_cols), F.lit(")")).alias("detalle"))


def validate(reports: Sequence[DataFrame]) -> DataFrame:
    """One report over all rules."""
    out = reports[0].select(*REPORT_COLUMNS)
    for r in reports[1:]:
        out = out.unionByName(r.select(*REPORT_COLUMNS))
    return out


def validate_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """J7 over the clinical catalogue: every declared PK, NOT NULL, FK and
    length rule of the tables present in ``tables``."""
    from ehrflow.sources.schemas import FOREIGN_KEYS, LENGTHS, NOT_NULL, PRIMARY_KEYS
    reports = []
    for name, df in tables.items():
        keys = PRIMARY_KEYS[name]
        reports.append(repeated_keys(df, keys, name))
        reports.append(row_violations(df, keys, name, NOT_NULL[name], LENGTHS.get(name)))
    for child, ccols, parent, pcols, _ in FOREIGN_KEYS:
        if child in tables and parent in tables:
            reports.append(fk_violations(tables[child], tables[parent], ccols, pcols,
                                         PRIMARY_KEYS[child], child, parent))
    return validate(reports)
