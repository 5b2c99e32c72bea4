"""Language identification: sparse multinomial logistic regression on TF-IDF
character 2- and 3-grams (UTF-8 bytes, A-Z lower-cased, hashed), trained with
follow-the-regularised-leader under elastic-net penalties, followed by
temperature calibration.

Held-out documents (crc32 of the doc_id as text, modulo 3, is 1) and those
without a language train nothing. Document frequencies are counted over all
training documents. The gradient steps see a bounded sample: about ``sample``
documents of each language (all of a smaller one), chosen by a hash of doc_id,
one row of each; only their features go to the driver. Every fifth of a
language's sets the temperature alone, so a language with fewer than five keeps
them all. Of more than ``MAX_LANGUAGES`` values of lang the most frequent are
learned (ties by code point); the model tells how many were not, and how many
documents had them.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
so is every text if no document has taught a language. A null doc_id is not
held out and trains nothing. Repeated rows are judged each (and count each in
training); an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ehrflow.llm import _text
from ehrflow.llm._shared import written

BUCKETS = 1 << 14                   # for 2-grams, and as many for 3-grams
DIMS = 2 * BUCKETS
SAMPLE = 500
MAX_LANGUAGES = 200
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray             # languages x DIMS
    intercepts: np.ndarray
    temperature: float
    left_out: tuple[int, int] = (0, 0)      # languages that were not learned, and their documents


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 2-grams and 3-grams that start at each byte."""
    low = _text.lowered(data).astype(np.uint32)
    shift = np.uint32(32 - (BUCKETS.bit_length() - 1))
    two = low[:-1] | low[1:] << np.uint32(8)
    three = two[:-1] | low[2:] << np.uint32(16)
    hashed = lambda g: ((g * np.uint32(0x9E3779B1)) >> shift).astype(np.int64)
    return hashed(two), hashed(three) + BUCKETS


def _counts(column: pa.Array) -> Iterator[np.ndarray]:
    """For each text, how often each bucket occurs."""
    data, offsets = _text.flat(column)
    two, three = _grams(data)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        out = np.bincount(two[a:max(b - 1, a)], minlength=DIMS)
        if b - a > 2:
            out += np.bincount(three[a:b - 2], minlength=DIMS)
        yield out


def _has_letter(column: pa.Array) -> np.ndarray:
    data, offsets = _text.flat(column)
    low = _text.lowered(data)
    plain = _text.sums(((low >= 97) & (low <= 122)).astype(np.int64), offsets[:-1], offsets[1:]) > 0
    for i in np.flatnonzero(~plain & (np.diff(offsets) > 0)).tolist():
        plain[i] = any(c.isalpha() for c in column[i].as_py())
    return plain


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition: the features of the chosen documents, and at the end
    its document frequencies (bucket -1: its documents)."""
    names = ["lang", "doc_id", "at", "counts", "bucket", "n"]
    kinds = [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int64()]
    seen, docs = np.zeros(DIMS, np.int64), 0
    for batch in _text.chunks(batches):
        rows = []
        chosen = batch.column("chosen").to_pylist()
        for k, counts in enumerate(_counts(batch.column("text"))):
            docs += 1
            seen += counts > 0
            if chosen[k]:
                at = np.flatnonzero(counts)
                rows.append((batch.column("lang")[k].as_py(), batch.column("doc_id")[k].as_py(), at.astype(np.int32).tobytes(), counts[at].astype(np.int32).tobytes(), None, None))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
    if docs:
        at = np.append(np.flatnonzero(seen), -1)
        n = np.append(seen[at[:-1]], docs)
        empty = [pa.nulls(len(at), t) for t in kinds[:4]]
        yield pa.RecordBatch.from_arrays([*empty, pa.array(at, pa.int32()), pa.array(n)], names=names)


def train(docs: DataFrame, sample: int = SAMPLE, max_languages: int = MAX_LANGUAGES) -> Model | None:
    known = docs.select("doc_id", "text", "lang").filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    share = {r.lang: (r.n, min(1.0, sample / r.n)) for r in sizes.orderBy(F.desc("n"), "lang").limit(max_languages).collect()}
    if not share:
        return None
    all_languages, all_documents = sizes.agg(F.count("*"), F.sum("n")).first()
    left_out = all_languages - len(share), all_documents - sum(n for n, _ in share.values())
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("language")), 11) / float(1 << 53)
    limit = F.element_at(F.create_map(*(F.lit(x) for lang, (_, part) in share.items() for x in (lang, part))), F.col("lang"))
    rows = written(known.withColumn("chosen", F.coalesce(draw < limit, F.lit(False))).mapInArrow(_statistics, "lang string, doc_id long, at binary, counts binary, bucket int, n long"), "languages")
    total = rows.filter("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()       # DIMS + 1 rows at most
    seen = dict(zip(total.column("bucket").to_pylist(), total.column("n").to_pylist()))
    n = seen.pop(-1)
    frequency = np.zeros(DIMS)
    frequency[list(seen)] = list(seen.values())
    idf = np.log((1 + n) / (1 + frequency)) + 1
    one = rows.filter("lang is not null").groupBy("lang", "doc_id").agg(F.min(F.struct("at", "counts")).alias("x")).select("lang", "doc_id", "x.*")
    chosen = sorted(one.collect(), key=lambda r: (r.doc_id * 0x9E3779B97F4A7C15 % (1 << 64), r.lang, bytes(r["at"])))
    languages = sorted({r.lang for r in chosen})
    if not languages:
        return None
    at = [np.frombuffer(r["at"], np.int32) for r in chosen]
    x = [_unit(np.frombuffer(r["counts"], np.int32) * idf[a]) for r, a in zip(chosen, at)]
    y = np.array([languages.index(r.lang) for r in chosen])
    return Model(languages, idf, *fit(at, x, y, len(languages)), left_out)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / (np.sqrt(x @ x) or 1.0)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(at: list[np.ndarray], x: list[np.ndarray], y: np.ndarray, classes: int, passes: int = 4, alpha: float = 0.5, beta: float = 1.0,
        l1: float = 0.05, l2: float = 0.05) -> tuple[np.ndarray, np.ndarray, float]:
    """Follow-the-regularised-leader, one row at a time; the last column of
    the state is the intercepts', which the first penalty spares. Then the
    temperature with the least log loss on the rows kept from it."""
    z, n = np.zeros((classes, DIMS + 1)), np.zeros((classes, DIMS + 1))
    order = np.argsort(y, kind="stable")
    held = np.zeros(len(y), bool)
    held[order] = (np.arange(len(y)) - np.searchsorted(y[order], y[order])) % 5 == 4      # every fifth of a language

    def leader(columns: np.ndarray | slice) -> np.ndarray:
        zi, penalty = z[:, columns], np.full(DIMS + 1, l1)
        penalty[-1] = 0
        short = np.maximum(np.abs(zi) - penalty[columns], 0) * np.sign(zi)
        return -short / ((beta + np.sqrt(n[:, columns])) / alpha + l2)

    for _ in range(passes):
        for i in np.flatnonzero(~held).tolist():
            columns, value = np.append(at[i], DIMS), np.append(x[i], 1.0)
            w = leader(columns)
            p = _softmax(w @ value)
            p[y[i]] -= 1
            g = p[:, None] * value
            more = n[:, columns] + g * g
            z[:, columns] += g - (np.sqrt(more) - np.sqrt(n[:, columns])) / alpha * w
            n[:, columns] = more
    w = leader(slice(None))
    if not held.any() or classes < 2:
        return w[:, :-1], w[:, -1], 1.0
    logits = np.array([w[:, at[i]] @ x[i] + w[:, -1] for i in np.flatnonzero(held)])
    doubt = 1 / (len(logits) + 2)                             # as if one more row were wrong, so separable rows stay finite
    target = np.full((len(logits), classes), doubt / (classes - 1))
    target[np.arange(len(logits)), y[held]] = 1 - doubt
    loss = lambda t: -(target * np.log(_softmax(logits / t) + 1e-300)).sum(axis=1).mean()
    return w[:, :-1], w[:, -1], min(np.geomspace(0.05, 20, 121).tolist(), key=loss)


def predicted(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.chunks(batches):
            text, n = batch.column("text"), batch.num_rows
            best, score = np.full(n, -1), np.zeros(n)
            if model is not None:
                logits = np.tile(model.intercepts, (n, 1))
                for k, counts in enumerate(_counts(text)):
                    logits[k] += model.weights @ _unit(counts * model.idf)
                p = _softmax(logits / model.temperature)
                known = _has_letter(text)
                best, score = np.where(known, p.argmax(axis=1), -1), np.where(known, p.max(axis=1), 0.0)
            names = [*(model.languages if model else ()), UNKNOWN]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([names[b] for b in best.tolist()]), pa.array(score)],
                                             names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
