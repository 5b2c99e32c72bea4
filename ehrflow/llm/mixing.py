"""Mixing sources to target weights by Pareto order sampling.

The sources, by code point (null last), weigh 1, 2, 3 and so on in turn and
share all words by weight; a target stops at ``max_copies`` times its source's
size, and the excess is shared again by weight until none is above. A document
of a source whose target is r times its size is included floor(r) times for
certain, and once more with inclusion probability p = r - floor(r).

For the last copy, documents are ranked within their source by Pareto's
q = (u / (1 - u)) / (p / (1 - p)), u uniform from a hash of the row, and taken
from the smallest up to the fixed size: the words that are missing to the
target (the document at the bound is taken if that comes nearer). So a
source's taken words differ from its target by half of one document at most.
p is one number for each source, so within it q rises with u, and the bound is
sought on u's 48 bits: four counts of words by source and 12 bits each, none
of which needs the documents of a source in one task or in order.

Defined results: a null text has no words and size 0; a null source is a
source of its own, the last; u comes from doc_id, source and text, so rows
equal in all three share one draw and are taken together, and reruns agree; a
source without words has target 0, and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ehrflow.llm._shared import positions, written

WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
_BITS, _LEVELS = 12, 4


def n_words(text: Column) -> Column:
    """Number of words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _rank(doc_id: Column, source: Column, text: Column) -> Column:
    """u of a row as a whole number of 48 bits."""
    return F.shiftrightunsigned(F.xxhash64(doc_id, source, text, F.lit("mix")), 64 - _BITS * _LEVELS)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, source_size). Each round
    reads two sums; it ends when no target is above its bound."""
    order = [F.col("source").isNull(), F.col("source")]
    turn = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("idx") % len(weights) + 1).cast("int"))
    table = written(positions(sizes, order, tag="sources").withColumn("weight", turn).select("source", "source_size", "weight"), "weights")
    bound = F.col("source_size") * float(max_copies)
    total = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, stopped = 0.0, -1
    while True:
        above = bound < F.col("weight") * level              # words for one weight; it only rises
        row = table.agg(F.count(F.when(above, 1)), F.coalesce(F.sum(F.when(above, bound)), F.lit(0.0)),
                        F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0))).first()
        if row[0] == stopped or not row[2]:
            return table.select("source", "source_size", F.least(bound, F.col("weight") * level).alias("target"))
        stopped, level = row[0], (total - row[1]) / row[2]


def _bounds(ranked: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, target, source_size, whole, bound): the certain copies, and the
    last rank that gets one more (-1: none)."""
    ratio = F.col("target") / F.col("source_size")
    state = goals.select("*", F.coalesce(F.floor(F.when(F.col("source_size") > 0, ratio)), F.lit(0)).cast("long").alias("whole"))
    state = state.select("*", (F.col("target") - F.col("whole") * F.col("source_size")).alias("missing"),
                         F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("own"))
    for level in range(1, _LEVELS + 1):
        shift = _BITS * (_LEVELS - level)
        words = (ranked.withColumn("bin", F.shiftright("rank", shift)).groupBy("source", "bin").agg(F.sum("size").alias("words"))
                 .withColumnRenamed("source", "of"))
        inside = state.join(words, F.col("source").eqNullSafe(F.col("of")) & (F.shiftright("bin", _BITS) == F.col("prefix")))
        upto = F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy("bin"))       # 2 ** 12 rows at most
        first = F.struct((F.col("upto") < F.col("missing")).alias("short"), F.when(F.col("upto") < F.col("missing"), -F.col("bin")).otherwise(F.col("bin")).alias("bin"))
        best = (inside.withColumn("upto", upto).groupBy("source", "target", "source_size", "whole", "missing")
                .agg(F.min_by(F.struct("bin", "upto", "words"), first).alias("x")))
        state = written(best.select("source", "target", "source_size", "whole", "missing", F.col("x.bin").alias("prefix"),
                                    (F.col("x.upto") - F.col("x.words")).alias("before"), F.col("x.words").alias("own")), f"bound{level}")
    nearer = F.col("before") + F.col("own") - F.col("missing") <= F.col("missing") - F.col("before")
    bound = F.when(F.col("missing") <= 0, F.lit(-1)).when(nearer, F.col("prefix")).otherwise(F.col("prefix") - 1)
    return state.select("source", "target", "source_size", "whole", bound.cast("long").alias("bound"))


def _planned(ranked: DataFrame, weights: tuple[int, ...], max_copies: int) -> DataFrame:
    sizes = ranked.groupBy("source").agg(F.sum("size").alias("source_size"))
    return written(_bounds(ranked, written(targets(written(sizes, "sizes"), weights, max_copies), "targets")), "bounds")


def _ranked(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), _rank(F.col("doc_id"), F.col("source"), F.col("text")).alias("rank"))


def _copies() -> Column:
    return F.col("whole") + (F.col("rank") <= F.col("bound")).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """doc_id, size, source_size, target and copies of every document."""
    ranked = written(_ranked(docs), "ranked")
    plan = _planned(ranked, weights, max_copies).withColumnRenamed("source", "of")
    return (ranked.join(plan, F.col("source").eqNullSafe(F.col("of")))
            .select("doc_id", "source", "size", "source_size", "target", _copies().alias("copies")))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; all columns as
    they are. The sources' bounds are joined to the rows, which stay where
    they are if the bounds are small enough to broadcast (Spark decides)."""
    ranked = written(_ranked(docs), "ranked")
    plan = _planned(ranked, weights, max_copies).select(*(F.col(c).alias(f"__{c}") for c in ("source", "whole", "bound")))
    rank = _rank(F.col("doc_id"), F.col("source"), F.col("text"))
    copies = F.col("__whole") + (rank <= F.col("__bound")).cast("long")
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))
    return (docs.join(plan, F.col("source").eqNullSafe(F.col("__source"))).withColumn("__copies", copies)
            .filter("__copies > 0").withColumn("__copy", again).select(*(docs[c] for c in docs.columns)))
