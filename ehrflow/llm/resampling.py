"""Importance resampling towards a target distribution of hashed word n-grams.

Words are runs of a-z, 0-9 and code points above 127, A-Z lower-cased; a
feature is a run of 1 to ``n`` consecutive words joined by a space, and its
bucket the crc32 of its bytes modulo ``buckets``. A bucket's gain is the
logarithm of how much likelier the target is to have it than the documents
(counts of all documents and all target texts, one added to each), in
thousandths, and a document's weight is the sum of its features' gains. With
Gumbel noise from a hash of the doc_id added, the highest scores are a sample
without replacement, likelier the higher the weight.

Counts and weights are made in tasks on arrays: the words of a chunk are found
at once, distinct features are hashed once, and gains are gathered by bucket.
The last drawn row is sought without sorting the scores: an approximate
quantile (a mergeable sketch) gives a bracket around the cutoff, exact counts
of the rows above and inside it say whether the cutoff is there, and if not,
a bracket twice as wide on that side is tried. Only the rows in the bracket are
sorted.

Defined results: a null text has no words, weight 0 and is never drawn; a null
doc_id is hashed as the empty text and comes after all others among equal
scores; rows equal in score and doc_id are taken by n_features; rows equal in
all of them are drawn one by one. An empty table, or fewer than
100 / ``percent`` rows with enough words, draws none. Other columns are not
read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ehrflow.llm import _text
from ehrflow.llm._shared import positions, written

N, BUCKETS, PERCENT, MIN_WORDS, SEED = 1, 10_000, 10, 20, 2024
CHUNK_BYTES = 1 << 19               # of texts that are counted together
ACCURACY = 2_000                    # the sketch's rank error is 1 / ACCURACY of the rows at most

_IN_WORD = np.ones(256, bool)
_IN_WORD[0x00:0x30] = _IN_WORD[0x3A:0x61] = _IN_WORD[0x7B:0x80] = False


def features(data: np.ndarray, offsets: np.ndarray, n: int = N, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of all features, text by text, the number of features of
    each text, and its number of words."""
    data = _text.lowered(data)
    solid = _IN_WORD[data]
    # every text and its words, with one space after each word, as one array of bytes
    opens = np.zeros(len(data) + 1, bool)
    opens[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | opens[1:-1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(solid & (np.append(~solid[1:], True) | opens[1:])) + 1
    length = ends - starts
    to = np.cumsum(length + 1)
    joined = np.full(int(to[-1]) if len(to) else 0, 0x20, np.uint8)
    joined[np.arange(int(length.sum())) + np.repeat(np.arange(len(length)), length)] = data[solid]
    begin = to - length - 1
    bounds = np.searchsorted(starts, offsets)
    words = np.diff(bounds)
    of = np.repeat(np.arange(len(words)), words)
    found, texts = [], []
    for run in range(1, n + 1):
        whole = np.arange(max(0, len(starts) - run + 1))
        whole = whole[of[whole] == of[whole + run - 1]]
        found.append(_buckets(joined, begin[whole], (to - 1)[whole + run - 1], buckets))
        texts.append(of[whole])
    text = np.concatenate(texts)
    order = np.argsort(text, kind="stable") if n > 1 else slice(None)
    return np.concatenate(found)[order], np.bincount(text, minlength=len(words)), words


def _buckets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, buckets: int) -> np.ndarray:
    """crc32 modulo ``buckets`` of each byte range; equal ranges are hashed once."""
    length = ends - starts
    to = np.concatenate(([0], np.cumsum(length)))
    copied = data[np.repeat(starts - to[:-1], length) + np.arange(int(to[-1]))]
    array = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(to.astype(np.int64)), pa.py_buffer(copied)]).dictionary_encode()
    hashed = np.array([zlib.crc32(x) % buckets for x in array.dictionary.to_pylist()], np.int64)
    return hashed[array.indices.to_numpy(zero_copy_only=False)] if len(array) else np.zeros(0, np.int64)


def counts(rows: DataFrame, n: int = N, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts each bucket holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in _text.chunks(batches, limit=CHUNK_BYTES):
            total += np.bincount(features(*_text.flat(batch.column("text")), n, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    found = rows.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()     # a row a bucket at most
    out = np.zeros(buckets, np.int64)
    for r in found:
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of how much likelier the target has a bucket."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t))))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, n: int = N) -> DataFrame:
    """doc_id, n_words, n_features and weight of every document."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.chunks(batches, limit=CHUNK_BYTES):
            found, many, words = features(*_text.flat(batch.column("text")), n, buckets)
            to = np.cumsum(many)
            weight = _text.sums(gain[found], to - many, to)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words), pa.array(many), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from a hash of the doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def _bracket(rows: DataFrame, k: int, n: int, accuracy: int) -> tuple[int, int]:
    """Two scores that the k-th highest of n is expected between."""
    margin = 2.0 / accuracy
    wanted = [min(1.0, max(0.0, 1 - k / n + side * margin)) for side in (-1, 1)]
    low, high = rows.agg(F.percentile_approx("score", wanted, accuracy).alias("q")).first().q
    return low, high


def cutoff(rows: DataFrame, k: int, low: int, high: int) -> tuple[int, int | None]:
    """Score and doc_id of the k-th of ``rows`` by score (highest first) and
    doc_id, sought from a bracket of scores."""
    while True:
        above, inside = rows.agg(F.count(F.when(F.col("score") > high, 1)), F.count(F.when(F.col("score").between(low, high), 1))).first()
        if above < k <= above + inside:
            break
        width = max(1, high - low)
        low, high = (high + 1, high + 2 * width) if above >= k else (low - 2 * width, low - 1)
    at = positions(rows.filter(F.col("score").between(low, high)), _order(), tag="bracket").filter(F.col("idx") == k - above - 1).first()
    return at.score, at.doc_id


def _order() -> list[Column]:
    return [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features")]


def resampled(docs: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS,
              seed: int = SEED, accuracy: int = ACCURACY) -> DataFrame:
    """doc_id, n_features, weight, score and rank (from 1; null: not drawn) of
    every document of ``docs``, drawn towards the texts of ``target``."""
    gain = gains(counts(docs, n, buckets), counts(target, n, buckets))
    rows = written(weighed(docs, gain, n).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores")
    enough = rows.filter(F.col("n_words") >= min_words)
    many = enough.count()
    k = percent * many // 100
    out = ["doc_id", "n_features", "weight", "score"]
    if not k:
        return rows.select(*out, F.lit(None).cast("long").alias("rank"))
    score, doc_id = cutoff(enough, k, *_bracket(enough, k, many, accuracy))
    tied = F.lit(True) if doc_id is None else F.coalesce(F.col("doc_id") <= doc_id, F.lit(False))
    upto = (F.col("n_words") >= min_words) & ((F.col("score") > score) | ((F.col("score") == score) & tied))
    rank = F.when(F.col("idx") < k, F.col("idx") + 1)
    drawn = positions(rows.filter(upto), _order(), tag="drawn").select(*out, rank.cast("long").alias("rank"))
    return drawn.unionByName(rows.filter(~upto).select(*out, F.lit(None).cast("long").alias("rank")))
