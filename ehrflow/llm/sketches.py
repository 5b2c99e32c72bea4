"""Document fingerprints: threshold-scaled sketches. DataFrame and SQL
functions only.

A sketch keeps every shingle hash below a fixed fraction of all hashes, and of
a text with fewer than ``LEAST`` such hashes the ``LEAST`` smallest, so that a
short text's sketch is all its shingles. A sketch of fewer hashes than that is
complete; others know all hashes up to their greatest, or to the fraction's
bound. So sketches of texts of any length can be merged (by union) and
compared, up to the smaller of their bounds: the hashes in common estimate how
much of one text is contained in the other.

Shingles are ``shingle`` words (or the whole text, if it has fewer); hashes are
48 bits of XXH64. A fingerprint is the sketch's hashes, sorted, 12 hexadecimal
digits each.

Defined results: a null text is empty, and a text without words has the empty
sketch; two empty sketches have likeness 1, an empty and another 0. The next
document is that of the next greater doc_id (null first); of rows that share
one, that with the smallest hash of its text. Repeated rows each have a
result; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ehrflow.llm._shared import positions, written

SHINGLE = 5
FRACTION = 8                        # one hash in so many is kept
LEAST = 128                         # hashes that are kept in any case
_BITS = 48


def with_sketch(rows: DataFrame, text: str, name: str, shingle: int = SHINGLE, fraction: int = FRACTION) -> DataFrame:
    """``rows`` with the column ``name``, the sorted sketch of ``text``. Each
    step is a projection of its own, so that none is computed twice."""
    words, hashes, small = f"__{name}_w", f"__{name}_h", f"__{name}_s"

    def shingle_hash(i: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(*(F.get(words, i + k) for k in range(shingle))), 64 - _BITS)

    last = F.greatest(F.size(words) - shingle, F.lit(0))
    return (rows.withColumn(words, F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), ""))
            .withColumn(hashes, F.when(F.size(words) > 0, F.transform(F.sequence(F.lit(0), last), shingle_hash)).otherwise(F.array().cast("array<bigint>")))
            .drop(words)
            .withColumn(small, F.array_distinct(F.filter(hashes, lambda h: h < (1 << _BITS) // fraction)))
            .withColumn(name, F.when(F.size(small) >= LEAST, F.array_sort(small)).otherwise(F.slice(F.array_sort(F.array_distinct(hashes)), 1, LEAST)))
            .drop(hashes, small))


def _bound(sketch: Column, fraction: int) -> Column:
    """The hash up to which a (sorted) sketch has all of its text's."""
    return (F.when(F.size(sketch) < LEAST, F.lit((1 << _BITS) - 1))
            .otherwise(F.greatest(F.get(sketch, F.size(sketch) - 1), F.lit((1 << _BITS) // fraction - 1))))


def _upto(sketch: Column, bound: Column) -> Column:
    return F.filter(sketch, lambda h: h <= bound)


def fingerprint(sketch: str) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), _BITS // 4, "0")), "")


def merged(sketches: DataFrame, key: str, sketch: str, fraction: int = FRACTION) -> DataFrame:
    """The sketch of all texts of each ``key`` together, up to the least bound
    of theirs. (The outer form of explode: Spark would put a filter on the
    other's array below the projections that make it, where it is computed anew
    for every shingle.)"""
    each = sketches.select(key, _bound(F.col(sketch), fraction).alias("__bound"), F.explode_outer(sketch).alias("h"))
    all_of = each.groupBy(key, "h").agg(F.min("__bound").alias("__bound")).groupBy(key).agg(F.array_sort(F.collect_list("h")).alias(sketch), F.min("__bound").alias("__bound"))
    return all_of.select(key, _upto(F.col(sketch), F.col("__bound")).alias(sketch))


def likeness(a: str, b: str, fraction: int = FRACTION) -> Column:
    """Share of both texts' shingles that they have in common."""
    bound = F.least(_bound(F.col(a), fraction), _bound(F.col(b), fraction))
    n, m = F.size(_upto(F.col(a), bound)), F.size(_upto(F.col(b), bound))
    common = F.size(_upto(F.array_intersect(a, b), bound))
    return (F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when(n + m == 0, 0.0)
            .otherwise(common / (n + m - common)).cast("double"))


def containment(a: str, b: str, fraction: int = FRACTION) -> Column:
    """Share of the first text's shingles that the second has."""
    bound = F.least(_bound(F.col(a), fraction), _bound(F.col(b), fraction))
    n = F.size(_upto(F.col(a), bound))
    return F.when(F.size(a) == 0, 1.0).when(n == 0, 0.0).otherwise(F.size(_upto(F.array_intersect(a, b), bound)) / n).cast("double")


def with_next(docs: DataFrame) -> DataFrame:
    """(of, take, doc_id): for every doc_id, that of the document before it
    (``of``; the last one's next is the first) and a fourth of its code
    points. Only doc_ids and lengths are sorted."""
    lengths = docs.groupBy("doc_id").agg(F.max(F.coalesce(F.char_length("text"), F.lit(0))).alias("n"))
    placed = written(positions(lengths, [F.col("doc_id").asc_nulls_first()], tag="ids"), "placed")
    n = placed.count()
    before = placed.select(F.col("doc_id").alias("of"), F.floor(F.col("n") / 4).cast("int").alias("take"), F.pmod(F.col("idx") + 1, F.lit(max(n, 1))).alias("idx"))
    return written(placed.select("doc_id", "idx").join(before, "idx").select("of", "take", "doc_id"), "next")


def edited_pairs(docs: DataFrame, shingle: int = SHINGLE, fraction: int = FRACTION) -> DataFrame:
    """doc_id, n_chars, edited text, and the sketches of the text, the edited
    text and the next document (sketch, edited_sketch, next_sketch). The last
    quarter of the edited text is the beginning of the next document.

    Texts are shuffled once, by doc_id, and that exchange serves both joins
    (which therefore need the same columns of it, doc_id too); what goes to the
    document before is the beginning it needs, and the sketch."""
    key = lambda c: {"__id": F.coalesce(c, F.lit(0)), "__null": F.isnull(c)}
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns(key("doc_id"))
    nav = with_next(docs).withColumns(key("doc_id")).drop("doc_id")
    own = with_sketch(texts.join(nav, ["__id", "__null"]), "text", "next_sketch", shingle, fraction)
    sent = (own.select("of", F.struct(F.left("text", F.col("take")).alias("head"), "next_sketch").alias("x"), F.xxhash64("text", "doc_id").alias("h"))
            .select(*(c.alias(k) for k, c in key("of").items()), "x", "h")
            .groupBy("__id", "__null").agg(F.min_by("x", "h").alias("x")).select("__id", "__null", "x.head", "x.next_sketch"))
    n = F.char_length("text").cast("long")
    take = F.floor(n / 4).cast("int")
    both = (texts.join(sent, ["__id", "__null"])
            .select("doc_id", n.alias("n_chars"), "text", F.concat(F.left("text", n.cast("int") - take), F.left("head", take)).alias("edited"), "next_sketch"))
    return with_sketch(with_sketch(both, "text", "sketch", shingle, fraction), "edited", "edited_sketch", shingle, fraction)
