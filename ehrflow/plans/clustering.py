"""Z-order: one sort key that clusters rows by several columns at once.

Every column's values are ranked by range bounds (quantiles of a bounded
sample; the bounds steer where rows lie in the files, never what they hold),
and the bits of the ranks are interleaved. Files sorted by that key have short
ranges of every one of the columns in each row group, so the min/max
statistics skip row groups whichever column a filter names; a plain sort only
does that for its first column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 64                           # ranges of a column: 6 bits
SAMPLE_PER_BIN = 64                 # sampled rows for each of them


def range_bounds(df: DataFrame, columns: list[str], bins: int = BINS, rows: int | None = None) -> dict[str, list[str]]:
    """For each column the values that part it into ``bins`` ranges of about
    equally many rows, as text, in the column's own order; fewer where a value
    is frequent. ``rows`` is the number of rows, if known. About ``bins *
    SAMPLE_PER_BIN`` rows are sampled."""
    rows = df.count() if rows is None else rows
    share = min(1.0, bins * SAMPLE_PER_BIN / max(rows, 1))
    sample = df.select(*columns)
    if share < 1:
        sample = sample.sample(share, seed=7)
    row = sample.agg(*[F.array_sort(F.collect_list(c)).cast("array<string>").alias(c) for c in columns]).first()
    out = {}
    for c in columns:
        values = row[c]
        out[c] = list(dict.fromkeys(values[len(values) * i // bins] for i in range(1, bins))) if values else []
    return out


def rank(column: Column, dtype, bounds: list[str]) -> Column:
    """The number of bounds at or below the value; NULL counts as above all.
    A balanced tree of comparisons, which stays in generated code."""
    cuts = [F.lit(b).cast(dtype) for b in bounds]

    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(column < cuts[mid], between(low, mid)).otherwise(between(mid + 1, high))

    return between(0, len(cuts))


def z_value(df: DataFrame, columns: list[str], bins: int = BINS, rows: int | None = None) -> Column:
    """The interleaved ranks of ``columns`` as a whole number."""
    bounds = range_bounds(df, columns, bins, rows)
    bits = max(1, (bins - 1).bit_length())
    out = F.lit(0).cast("long")
    for i, c in enumerate(columns):
        place = rank(F.col(c), df.schema[c].dataType, bounds[c]).cast("long")
        for b in range(bits):
            bit = F.shiftright(place, b).bitwiseAND(F.lit(1).cast("long"))
            out = out.bitwiseOR(F.shiftleft(bit, b * len(columns) + len(columns) - 1 - i))
    return out
