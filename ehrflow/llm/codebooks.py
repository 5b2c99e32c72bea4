"""Vector codes: product quantisation trained by exact Ball k-means.

Components become integers, floor(scale * x), and vectors are cut into equal
consecutive parts. Each part position has a codebook of its own, which starts
as that part of the vectors with the smallest ids. A round assigns every part
to its nearest entry (squared Euclidean distance, ties to the lower index) and
replaces each entry by the floor of the mean of its parts; an entry without
parts stays. After the rounds all parts are assigned once more.

From the second pass on a part knows its entry of the pass before, which is
the centre of a ball. In a block of vectors the ball's radius is its farthest
part. Entry j is a neighbour of ball i if half the distance between the two
entries is not above the radius; a part that lies nearer to its entry than half
way to any neighbour is in the stable core and keeps its entry without a
further distance. The others lie in rings between half the distances to one
neighbour and the next, and are held only against the neighbours up to their
ring. What is left out is strictly farther away, so the codes are those of the
full search. All distances are exact: products of floats where every sum stays
below 2**51, else 64-bit integers and the full search.

A pass writes the vectors with their codes, and each task's sums by entry next
to them, to the shared folder; the table of the pass before is deleted then.
Only the codebooks (entries x components) go to the driver.

Defined results: a null vector, or one with a null or non-finite component, is
dropped; so is an empty one, and one of another length than the vector with
the smallest id. Null ids come after all others, equal ids in order of their
vectors; repeated rows are coded each. With fewer vectors than entries, the
codebooks have that many entries; an empty table gives no rows. A length that
cannot be cut into equal parts, and components too large for distances in 64
bits, are errors. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ehrflow.llm._shared import shared_path, written
from ehrflow.session import drop_path

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
BLOCK = 1 << 15                     # vectors whose balls are looked at together


@dataclass
class Codebooks:
    entries: np.ndarray             # part, entry, position: integers

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


# ---- distances ----

def _full(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry and its squared distance."""
    if v.dtype.kind == "f":
        d = (v * v).sum(1)[:, None] + (c * c).sum(1) - 2 * (v @ c.T)
        best = d.argmin(1)
        return best, d[np.arange(len(v)), best]
    best, least = np.zeros(len(v), np.int64), ((v - c[0]) ** 2).sum(1)
    for j in range(1, len(c)):
        d = ((v - c[j]) ** 2).sum(1)
        nearer = d < least
        best[nearer], least[nearer] = j, d[nearer]
    return best, least


def _in_balls(v: np.ndarray, c: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The same by balls around the entries in ``own``; and how many distances
    between parts and entries it took."""
    square = (c * c).sum(1)
    between = square[:, None] + square - 2 * (c @ c.T)
    least = ((v - c[own]) ** 2).sum(1)
    best, taken = own.copy(), len(v)
    order = np.lexsort((least, own))
    bounds = np.searchsorted(own[order], np.arange(len(c) + 1))
    for i in range(len(c)):
        ball = order[bounds[i]:bounds[i + 1]]                                        # from the centre outwards
        if not len(ball):
            continue
        radius = least[ball[-1]]
        near = np.flatnonzero(between[i] <= 4 * radius)                              # the neighbours
        near = near[near != i]
        near = near[np.argsort(between[i][near], kind="stable")]
        ring = np.searchsorted(between[i][near], 4 * least[ball], "right")           # 0: the stable core
        low, high = 0, 1
        while low < len(near):
            part = ball[np.searchsorted(ring, low, "right"):np.searchsorted(ring, high, "right")]
            if len(part):
                some = np.sort(np.append(near[:high], i))
                d = (v[part] * v[part]).sum(1)[:, None] + square[some] - 2 * (v[part] @ c[some].T)
                at = d.argmin(1)
                best[part], least[part] = some[at], d[np.arange(len(part)), at]
                taken += d.size
            low, high = high, 2 * high
    return best, least, taken


def nearest(v: np.ndarray, c: np.ndarray, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of ``c`` to each row of ``v`` (integers), ties to the
    lower index, and its squared distance."""
    largest = max(int(np.abs(v).max(initial=0)), int(np.abs(c).max(initial=0)))
    bound = v.shape[1] * (2 * largest) ** 2
    if bound >= 1 << 62:
        raise ValueError("components too large for exact distances in 64 bits")
    if bound < 1 << 51:
        v, c = v.astype(np.float64), c.astype(np.float64)
        best, d = _full(v, c) if own is None else _in_balls(v, c, own)[:2]
    else:
        best, d = _full(v.astype(np.int64), c.astype(np.int64))
    return best, d.astype(np.int64)


# ---- passes ----

def integers(rows: DataFrame, vector: str, scale: int = SCALE) -> DataFrame:
    """vec_id, label and v, the integer components, of the rows whose vector
    is whole."""
    types = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            length = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = lists.flatten().cast(pa.float64())
            x = np.floor(values.to_numpy(zero_copy_only=False) * scale)              # null: NaN
            good = np.isfinite(x)
            to = np.concatenate(([0], np.cumsum(length)))
            bad = np.concatenate(([0], np.cumsum(~good)))
            keep = (length > 0) & (bad[to[1:]] == bad[to[:-1]])
            if (np.abs(x[good]) >= 2.0 ** 31).any() and (np.abs(x[np.repeat(keep, length)]) >= 2.0 ** 31).any():
                raise ValueError("components too large for exact distances in 64 bits")
            held = np.repeat(keep, length)
            out = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(length[keep]))).astype(np.int32)), pa.array(x[held].astype(np.int32)))
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask), out], names=["vec_id", "label", "v"])

    return rows.select("vec_id", "label", vector).mapInArrow(run, f"vec_id {types['vec_id']}, label {types['label']}, v array<int>")


def _first(rows: DataFrame, n: int) -> list:
    """The vectors of the n smallest ids. Tasks keep their own n smallest,
    twice, so the last step sees n rows of few tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        for batch in batches:
            ids = batch.column("vec_id")
            order = ids.to_numpy(zero_copy_only=False)
            some = np.arange(len(ids))
            if len(ids) > n and not ids.null_count:
                some = np.flatnonzero(order <= np.partition(order, n - 1)[n - 1])
            part = batch.take(pa.array(some))
            kept += zip([x is None for x in part.column("vec_id").to_pylist()], part.column("vec_id").to_pylist(), part.column("v").to_pylist())
            kept = sorted(kept, key=lambda r: (r[0], r[1] or 0, r[2]))[:n]
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in kept], pa.int64()), pa.array([r[2] for r in kept], pa.list_(pa.int32()))], names=["vec_id", "v"])

    schema = "vec_id long, v array<int>"
    rows = rows.select(F.col("vec_id").cast("long"), "v").mapInArrow(run, schema)
    rows = rows.repartition(max(1, math.isqrt(rows.rdd.getNumPartitions()))).mapInArrow(run, schema)
    return [r.v for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(n).collect()]


def _pass(state: DataFrame, books: np.ndarray, last: bool) -> DataFrame:
    """``state`` with the codes of its vectors; in the last pass with their
    errors in place of v, else with rows of the tasks' sums: part, entry, and
    the count and the sums by position."""
    parts, k, size = books.shape
    types = dict(state.dtypes)
    known = "code" in types
    out = ["vec_id", "label", "code", "error"] if last else ["vec_id", "label", "v", "code", "part", "entry", "sums"]
    types |= {"code": "binary", "error": "long", "part": "int", "entry": "int", "sums": "array<bigint>"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, kinds, empty = np.zeros((parts, k, size + 1), np.int64), None, pa.nulls
        for whole in batches:
            kinds = whole.schema
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                v = _matrix(batch.column("v")).astype(np.int64).reshape(batch.num_rows, parts, size)
                before = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64) if known else None
                code, error = np.empty((len(v), parts), np.uint8), np.zeros(len(v), np.int64)
                for p in range(parts):
                    own, d = nearest(v[:, p], books[p], None if before is None else before[:, p])
                    code[:, p] = own
                    error += d
                    if not last:
                        order = np.argsort(own, kind="stable")
                        entries, starts = np.unique(own[order], return_index=True)
                        sums[p, entries, 0] += np.diff(np.append(starts, len(own)))
                        sums[p, entries, 1:] += np.add.reduceat(v[order, p], starts)
                codes = pa.array([c.tobytes() for c in code], pa.binary())
                columns = [batch.column("vec_id"), batch.column("label"), codes, pa.array(error)] if last else \
                    [batch.column("vec_id"), batch.column("label"), batch.column("v"), codes, *(empty(len(v), t) for t in (pa.int32(), pa.int32(), pa.list_(pa.int64())))]
                yield pa.RecordBatch.from_arrays(columns, names=out)
        if not last and kinds is not None:
            p, e = np.nonzero(sums[:, :, 0])
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * (size + 1)), pa.array(sums[p, e].ravel()))
            yield pa.RecordBatch.from_arrays([empty(len(p), kinds.field("vec_id").type), empty(len(p), kinds.field("label").type), empty(len(p), kinds.field("v").type),
                                              empty(len(p), pa.binary()), pa.array(p, pa.int32()), pa.array(e, pa.int32()), rows], names=out)

    return state.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in out))


def coded(rows: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks]:
    """vec_id, label, code (a byte for each part) and error (squared distances
    summed over the parts) of the kept vectors, and the codebooks."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has a byte for each part: 1 to 256 entries")
    spark = rows.sparkSession
    folders = [shared_path(spark, "vectors")]
    integers(rows, vector, scale).write.parquet(folders[-1])
    read = lambda: spark.read.parquet(folders[-1])
    seeds = _first(read(), entries)
    length = len(seeds[0]) if seeds else parts
    if length % parts:
        raise ValueError(f"vectors of {length} components have no {parts} equal parts")
    if any(len(s) != length for s in seeds):
        seeds = _first(read().filter(F.size("v") == length), entries)
    books = np.array(seeds, np.int64).reshape(len(seeds), parts, -1).transpose(1, 0, 2) if seeds else np.zeros((parts, 1, 1), np.int64)
    state = read().filter(F.size("v") == length)
    for turn in range(rounds):
        folders.append(shared_path(spark, "codes"))
        _pass(state, books, last=False).write.parquet(folders[-1])
        drop_path(spark, folders[-2])
        found = read().filter("part IS NOT NULL").select("part", "entry", F.posexplode("sums").alias("pos", "x"))
        sums = np.zeros((books.shape[0], books.shape[1], books.shape[2] + 1), object)
        for r in found.groupBy("part", "entry", "pos").agg(F.sum("x").alias("x")).collect():        # entries x components at most
            sums[r.part, r.entry, r.pos] = r.x
        books = np.array([[[s // sum_[0] for s in sum_[1:]] if sum_[0] else old for sum_, old in zip(of, entry)] for of, entry in zip(sums.tolist(), books.tolist())], np.int64).reshape(books.shape)
        state = read().filter("part IS NULL").select("vec_id", "label", "v", "code")
    out = written(_pass(state, books, last=True), "coded")
    drop_path(spark, folders[-1])
    return out, Codebooks(books if seeds else books[:, :0])


def with_label_errors(found: DataFrame) -> DataFrame:
    """``found`` (a written table) with label_error, the errors summed over
    the rows of a label, nulls together."""
    sums = written(found.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    return found.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of")
