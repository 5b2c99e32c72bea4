"""Quality rules: counts of a text, and a classifier over hashed n-grams.

A text fails the base rules if it has too few words or too many words in
five-word windows that occur twice. Beyond them, a logistic regression over
hashed word 1- and 2-grams and character 3- and 4-grams (UTF-8 bytes), trained
on labelled rows, gives a calibrated probability of good quality that is held
against a fixed threshold.

The training sample is bounded: at most ``sample`` labelled documents of each
class, those with the smallest hash of their doc_id, their whole texts. Their
feature vectors (at most ``4 * BUCKETS`` entries each) go to the driver; no
other rows do. Every fifth of them is kept from the fit, for the calibration.

Defined results: a null text has no words; an empty or short text fails the
base rules; repeated rows are judged each; without labelled rows of both
classes (or an empty table of labels) the verdict is that of the base rules;
of several labels of one document the smallest counts. Other columns are not
read, so clashing names do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ehrflow.llm import _text

BUCKETS = 1 << 15
BLOCKS = 4                          # word 1-grams, word 2-grams, 3 bytes, 4 bytes
SAMPLE = 1000
ENTRIES = 1 << 16                   # of the feature vectors that the fit unpacks at once
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
KEEP_AT = 0.5                       # calibrated probability of good quality
SCALE = 40.0                        # of relative frequencies, for an even fit
DAMPING = 20                        # added to the number of n-grams, so that few of them decide little

_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True

SCORE_SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                "n_repeat_words long, base_failed boolean, probability double, kept boolean")


@dataclass
class Model:
    weights: np.ndarray             # BLOCKS x BUCKETS, for relative frequencies
    intercept: float
    slope: float                    # calibration of the raw score
    shift: float


def base_counts(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """The four counts and the number of words of each text."""
    n_words = np.diff(first)
    points = (data & 0xC0) != 0x80
    solid = ~_text._SPACE[data]
    return {
        "n_words": n_words,
        "word_chars": _text.sums((points & solid).astype(np.int64), offsets[:-1], offsets[1:]),
        "n_symbols": _text.sums(_SYMBOL[data].astype(np.int64), offsets[:-1], offsets[1:]),
        "n_dup_lines": _dup_lines(data, offsets, starts),
        "n_repeat_words": _repeat_words(_text.word_ids(data, starts, ends), np.repeat(np.arange(len(n_words)), n_words), len(n_words)),
    }


def _dup_lines(data: np.ndarray, offsets: np.ndarray, word_starts: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text. Word starts
    tell which lines have one, and only those are compared."""
    n = len(offsets) - 1
    if not len(word_starts):
        return np.zeros(n, np.int64)
    breaks = np.flatnonzero(data == 10)
    line = np.searchsorted(breaks, word_starts)
    doc = np.searchsorted(offsets, word_starts, "right") - 1
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
    line, doc = line[new], doc[new]
    lo = np.maximum(np.concatenate(([0], breaks + 1))[line], offsets[doc])
    hi = np.minimum(np.concatenate((breaks, [len(data)]))[line], offsets[doc + 1])
    keep = np.zeros(len(data) + 1, np.int64)
    np.add.at(keep, lo, 1)
    np.add.at(keep, hi, -1)
    ids = _text._ids(data[np.cumsum(keep[:-1]) > 0], np.concatenate(([0], np.cumsum(hi - lo))))
    key = np.unique(doc * (len(ids) + 1) + ids)
    return np.bincount(doc, minlength=n) - np.bincount(key // (len(ids) + 1), minlength=n)


def _repeat_words(ids: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Words in five-word windows that stand twice or more in their text.
    Windows are found by a hash and compared word by word."""
    m = len(ids) - 4
    if m <= 0:
        return np.zeros(n, np.int64)
    at = np.flatnonzero(doc[:m] == doc[4:])
    key = doc[at].astype(np.uint64)
    for k in range(5):
        key = _text.mixed(key * np.uint64(0x9E3779B97F4A7C15) + ids[at + k].astype(np.uint64))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    a, b = at[order[1:][same]], at[order[:-1][same]]
    if any((ids[a + k] != ids[b + k]).any() for k in range(5)) or (doc[a] != doc[b]).any():
        columns = [ids[at + k] for k in range(5)] + [doc[at]]     # two windows share a hash: compare all
        order = np.lexsort(columns)
        same = np.logical_and.reduce([c[order[1:]] == c[order[:-1]] for c in columns])
        a, b = at[order[1:][same]], at[order[:-1][same]]
    marks = np.zeros(len(ids) + 1, np.int64)
    hit = np.union1d(a, b)
    marks[hit] += 1
    marks[hit + 5] -= 1
    return np.bincount(doc[np.cumsum(marks[:-1]) > 0], minlength=n)


def gram_blocks(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each block: the bucket of every n-gram, and each text's range of
    them (n-grams across two texts are in no range)."""
    shift = np.uint64(64 - (BUCKETS.bit_length() - 1))
    one = _text.range_hashes(data, starts, ends)
    yield (one >> shift).astype(np.int32), first[:-1], first[1:]
    two = _text.mixed(one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:])
    yield (two >> shift).astype(np.int32), first[:-1], np.maximum(first[1:] - 1, first[:-1])
    wide = data.astype(np.uint32)
    for n in (3, 4):
        m = max(len(data) - n + 1, 0)
        gram = np.zeros(m, np.uint32)
        for k in range(n):
            gram |= wide[k:k + m] << np.uint32(8 * k)
        bucket = (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - (BUCKETS.bit_length() - 1))
        yield bucket.astype(np.int32), np.minimum(offsets[:-1], m), np.clip(offsets[1:] - n + 1, np.minimum(offsets[:-1], m), m)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Non-zero relative frequencies of each text, as packed arrays."""
    for batch in _text.chunks(batches):
        data, offsets = _text.flat(batch.column("text"))
        starts, ends, first = _text.words(data, offsets)
        where, value = [[] for _ in range(batch.num_rows)], [[] for _ in range(batch.num_rows)]
        for block, (bucket, lo, hi) in enumerate(gram_blocks(data, offsets, starts, ends, first)):
            for d in range(batch.num_rows):
                if hi[d] > lo[d]:
                    b, c = np.unique(bucket[lo[d]:hi[d]], return_counts=True)
                    where[d].append((b + block * BUCKETS).astype(np.int32))
                    value[d].append((c / (hi[d] - lo[d] + DAMPING)).astype(np.float32))
        pack = lambda parts: [b"".join(x.tobytes() for x in p) for p in parts]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(pack(where), pa.binary()), pa.array(pack(value), pa.binary())],
                                         names=["doc_id", "quality", "at", "value"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit and calibrate on at most ``sample`` labelled documents a class; of
    rows with one doc_id, on that with the smallest hash of its text."""
    known = (labels.filter("quality in (0, 1) and doc_id is not null")
             .groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")))
    order = F.xxhash64("doc_id")
    share = {r.quality: r["count"] for r in known.groupBy("quality").count().collect()}     # two rows at most
    chosen = None
    for q in (0, 1):
        part = known.filter(F.col("quality") == q).orderBy(order, "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionAll(part)
    rows = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality")      # at most 2 * sample groups
            .agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
            .mapInArrow(_features, "doc_id long, quality int, at binary, value binary").toArrow())
    y = rows.column("quality").to_numpy().astype(float)
    if len(set(y.tolist())) < 2:
        return None
    order = np.argsort(rows.column("doc_id").to_numpy())        # a doc_id has one row
    return fit(_views(rows.column("at"), np.int32, order), _views(rows.column("value"), np.float32, order), y[order], share.get(1, 0) / max(sum(share.values()), 1))


def _views(column: pa.ChunkedArray, kind: type, order: np.ndarray) -> list[np.ndarray]:
    """The packed arrays of a column in ``order``, not copied."""
    every = [np.frombuffer(x.as_buffer(), kind) for x in column]
    return [every[i] for i in order]


def fit(where: list[np.ndarray], value: list[np.ndarray], y: np.ndarray, good_share: float = 0.5,
        penalty: float = 1e-4, rounds: int = 100) -> Model:
    """Accelerated gradient descent on the log loss (classes weigh the same),
    then Platt's calibration on the rows kept from it, weighted by each
    class's share of all labelled documents. Every round goes through the rows
    in parts of at most ``ENTRIES`` entries (or one row), in their order, so
    that only the packed vectors are held whole."""
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False
    size = np.array([len(x) for x in where])
    weight = np.where(y == 1, 0.5 / max((y[~held] == 1).sum(), 1), 0.5 / max((y[~held] == 0).sum(), 1)) * ~held
    dims = BLOCKS * BUCKETS

    def parts(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Rows, and the row, bucket and frequency of each of their entries."""
        total, lo = np.concatenate(([0], np.cumsum(size[rows]))), 0
        while lo < len(rows):
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + ENTRIES, "right")) - 1)
            part = rows[lo:hi]
            yield (part, np.repeat(part, size[part]), np.concatenate([where[i] for i in part]).astype(np.intp),
                   np.concatenate([value[i] for i in part]).astype(float) * SCALE)
            lo = hi

    every, fitted = np.arange(len(y)), np.flatnonzero(~held)
    squares = np.zeros(len(y))
    for _, row, _, x in parts(every):
        squares += np.bincount(row, x * x, len(y))
    lipschitz = 0.25 * float((weight * squares).sum() + 1) + penalty
    w, b, v, c, t = np.zeros(dims), 0.0, np.zeros(dims), 0.0, 1.0
    for _ in range(rounds):
        slopes, gap = np.zeros(dims), np.zeros(len(y))
        for part, row, at, x in parts(fitted):
            z = np.bincount(row, x * v[at], len(y))[part] + c
            gap[part] = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) * weight[part]
            np.add.at(slopes, at, x * gap[row])
        w2 = v - (slopes + penalty * v) / lipschitz
        b2 = c - gap.sum() / lipschitz
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    s = np.zeros(len(y))
    for _, row, at, x in parts(every):
        s += np.bincount(row, x * w[at], len(y))
    s += b
    slope, shift = platt(s[held], y[held], good_share) if held.any() else (1.0, 0.0)
    return Model((w * SCALE).reshape(BLOCKS, BUCKETS), b, slope, shift)


def platt(score: np.ndarray, y: np.ndarray, good_share: float, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the scores, by Newton's
    method on softened targets, so separable rows stay finite."""
    good, bad = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    weight = np.where(y == 1, good_share / good, (1 - good_share) / bad) * len(y)
    spread = score.std() or 1.0
    z, theta = np.column_stack((score / spread, np.ones(len(y)))), np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (weight * p * (1 - p))[:, None]) + 1e-6 * np.eye(2), z.T @ (weight * (p - target)) + 1e-6 * theta)
        theta = theta - np.clip(step, -5, 5)
    return float(theta[0] / spread), float(theta[1])


def _judge(model: Model | None, min_words: int, max_repeat: int, keep_at: float):
    def judge(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        data, offsets = _text.flat(batch.column("text"))
        starts, ends, first = _text.words(data, offsets)
        out = base_counts(data, offsets, starts, ends, first)
        n = out["n_words"]
        out["base_failed"] = (n < min_words) | (100 * out["n_repeat_words"] > max_repeat * n)
        if model is None:
            out["probability"] = np.full(len(n), np.nan)
            out["kept"] = ~out["base_failed"]
            return out
        score = np.full(len(n), model.intercept)
        for block, (bucket, lo, hi) in enumerate(gram_blocks(data, offsets, starts, ends, first)):
            score += _text.sums(model.weights[block][bucket], lo, hi) / (hi - lo + DAMPING)
        out["probability"] = 1 / (1 + np.exp(-np.clip(model.slope * score + model.shift, -700, 700)))
        out["kept"] = ~out["base_failed"] & (out["probability"] >= keep_at)
        return out

    return judge


def judged(docs: DataFrame, model: Model | None, min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT_PERCENT, keep_at: float = KEEP_AT) -> DataFrame:
    """One row per document with its counts, probability (null without a
    model) and verdict."""
    judge = _judge(model, min_words, max_repeat, keep_at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.chunks(batches):
            out = judge(batch)
            p = out.pop("probability")
            kept, failed = out.pop("kept"), out.pop("base_failed")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in out.values()), pa.array(failed), pa.array(p, mask=np.isnan(p)), pa.array(kept)],
                names=["doc_id", *out, "base_failed", "probability", "kept"])

    return docs.select("doc_id", "text").mapInArrow(run, SCORE_SCHEMA)


def kept_rows(docs: DataFrame, model: Model | None, min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT_PERCENT, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they are."""
    judge = _judge(model, min_words, max_repeat, keep_at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.chunks(batches):
            yield batch.filter(pa.array(judge(batch)["kept"]))

    return docs.mapInArrow(run, docs.schema)
