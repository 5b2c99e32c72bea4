"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A text is lower-cased (A-Z), cut into words and shingles of ``SHINGLE`` words;
each shingle's XXH64 votes on 64 bits. Two fingerprints are linked if they
differ in at most ``max_bits`` bits.

For a link of up to r bits there is a variant within r // 2 bits of one end
and within the rest of the other. Every distinct fingerprint emits all
variants within r // 2 bits (near), and if r is odd those with one more bit
flipped (far). For r = 3, where the far variants are pairs of bits, the two
ends of a three-bit link have different parity and two of its bits lie in the
same half of the 64: even ones flip pairs of the lower half, odd ones pairs of
the upper half, and the third bit is flipped by the other end. So 561 variants
are enough for each fingerprint, without a link lost.

Variants are dealt by their hash into buckets, packed in arrays. A bucket
holds distinct fingerprints' variants only, so copies of a text cannot make it
large, and the number of buckets grows with the number of fingerprints. At one
variant, a near fingerprint is within r bits of all others there; a star from
it links them without all pairs, and every pair within r bits is in such a
star at some variant. Each link's distance is verified.

Defined results: a text without words (null, empty, blank) has fingerprint
zero, linked like any other; with fewer words than a shingle, the whole
sequence is its one shingle. Rows with a null doc_id take part and are null
themselves; component_id is the smallest doc_id that is not null (null if
there is none). Repeated rows stay. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ehrflow.llm import _text
from ehrflow.llm._shared import written
from ehrflow.llm.components import components

SHINGLE = 3
MAX_BITS = 3
SEED = 42
BUCKET_BYTES = 8 << 20
_BATCH = 4000                       # fingerprints whose variants are made at once


def text_fingerprints(column: pa.Array, shingle: int) -> np.ndarray:
    """Unsigned 64-bit fingerprints of a column of texts."""
    data, offsets = _text.flat(column)
    data = _text.lowered(data)
    starts, ends, first = _text.words(data, offsets)
    line, lo, hi = _text.joined(data, starts, ends)
    n = np.diff(first)
    count = np.where(n >= shingle, n - shingle + 1, n > 0)
    total = np.concatenate(([0], np.cumsum(count)))
    begin = np.repeat(first[:-1], count) + np.arange(total[-1]) - np.repeat(total[:-1], count)
    end = np.minimum(begin + shingle, np.repeat(first[1:], count)) - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[a:b], SEED) for a, b in zip(lo[begin].tolist(), hi[end].tolist())), np.uint64, int(total[-1]))
    out, full = np.zeros(len(n), np.uint64), np.flatnonzero(count)
    step = 1 << 17                  # shingles whose bits are unpacked at once
    votes = np.zeros((len(n), 64), np.int64)
    for at in range(0, len(h), step):
        bits = np.unpackbits(h[at:at + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        a, b = np.clip(total[:-1] - at, 0, len(bits)), np.clip(total[1:] - at, 0, len(bits))
        here = np.flatnonzero(b > a)
        votes[here] += np.add.reduceat(bits, a[here], axis=0, dtype=np.int64)
    over = votes[full] * 2 > count[full][:, None]
    if len(full):
        out[full] = np.packbits(over, axis=1, bitorder="little").view(np.uint64).reshape(-1)
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep_hash: bool = False) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every document, and
    on demand a 64-bit hash of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.chunks(batches):
            fp = text_fingerprints(batch.column("text"), shingle).view(np.int64)
            more = [batch.column("text_hash")] if keep_hash else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp), *more], names=["doc_id", "fp", "text_hash"][:2 + keep_hash])

    read = [F.col("doc_id"), F.col("text"), *([F.xxhash64("text").alias("text_hash")] if keep_hash else [])]
    return docs.select(*read).mapInArrow(run, "doc_id long, fp long" + ", text_hash long" * keep_hash)


def _flips(bits: list[int], n: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for c in combinations(bits, n)], np.uint64)


def ball_masks(max_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flips of the near variants, and of the far ones of fingerprints with an
    even and with an odd number of bits."""
    every = list(range(64))
    near = np.concatenate([_flips(every, n) for n in range(max_bits // 2 + 1)])
    if max_bits % 2 == 0:
        none = np.zeros(0, np.uint64)
        return near, none, none
    if max_bits == 3:
        return near, _flips(every[:32], 2), _flips(every[32:], 2)
    far = _flips(every, max_bits // 2 + 1)
    return near, far, far


def _variants(max_bits: int, n_buckets: int):
    near, even, odd = ball_masks(max_bits)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(every), _BATCH):
                fp = every[at:at + _BATCH]
                odd_fp = (np.bitwise_count(fp) & 1).astype(bool)
                yield from pack(np.concatenate([(fp[:, None] ^ near).ravel(), (fp[~odd_fp][:, None] ^ even).ravel(), (fp[odd_fp][:, None] ^ odd).ravel()]),
                                np.concatenate([np.tile(np.arange(len(near)), len(fp)), np.tile(np.arange(len(even)), int((~odd_fp).sum())) + len(near), np.tile(np.arange(len(odd)), int(odd_fp.sum())) + len(near) + len(even)]))

    def pack(variant: np.ndarray, code: np.ndarray) -> Iterator[pa.RecordBatch]:
        bucket = (_text.mixed(variant) >> np.uint64(24)) % np.uint64(n_buckets)
        order = np.argsort(bucket.astype(np.uint32), kind="stable")
        bucket, variant, code = bucket[order], variant[order], code[order].astype(np.uint16)
        cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        cuts = np.append(cut, len(bucket))
        blobs = lambda x: pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer((cuts * x.itemsize).astype(np.int32)), pa.py_buffer(x)])
        yield pa.RecordBatch.from_arrays([pa.array(bucket[cut].astype(np.int64)), blobs(variant), blobs(code)], names=["bucket", "variants", "codes"])

    return emit


def _collisions(max_bits: int):
    near, even, odd = ball_masks(max_bits)
    masks = np.concatenate([near, even, odd])

    def match(table: pa.Table) -> pa.Table:
        variant = np.frombuffer(b"".join(table.column("variants").to_pylist()), np.uint64)
        code = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.uint16)
        is_near = code < len(near)
        nv, nf = variant[is_near], variant[is_near] ^ masks[code[is_near]]
        order = np.lexsort((nf, nv))
        nv, nf = nv[order], nf[order]
        new = np.ones(len(nv), bool)
        new[1:] = nv[1:] != nv[:-1]
        head = nf[new][np.cumsum(new) - 1]                      # the star's centre at each near variant
        a, b = [head[~new]], [nf[~new]]
        if not is_near.all() and len(nv):
            fv, ff = variant[~is_near], variant[~is_near] ^ masks[code[~is_near]]
            keys, centre = nv[new], nf[new]
            at = np.minimum(np.searchsorted(keys, fv), len(keys) - 1)
            hit = keys[at] == fv
            a.append(centre[at[hit]])
            b.append(ff[hit])
        a, b = np.concatenate(a), np.concatenate(b)
        good = (np.bitwise_count(a ^ b) <= max_bits) & (a != b)
        pair = np.unique(np.column_stack((np.minimum(a, b)[good], np.maximum(a, b)[good])), axis=0) if good.any() else np.zeros((0, 2), np.uint64)
        return pa.table({"a": np.ascontiguousarray(pair[:, 0]).view(np.int64), "b": np.ascontiguousarray(pair[:, 1]).view(np.int64)})

    return match


def ball_links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fp`` that connect all
    pairs within ``max_bits`` (not each pair itself is a row)."""
    masks = ball_masks(max_bits)
    each = len(masks[0]) + max(len(masks[1]), len(masks[2]))
    if each + len(masks[2]) >= 1 << 16:
        raise ValueError(f"max_bits = {max_bits}: too many variants")
    n_buckets = max(1, -(-distinct.count() * each * 10 // BUCKET_BYTES))
    n_tasks = -(-n_buckets // 8)                              # each makes as many variants as eight buckets hold
    return (distinct.select("fp").repartition(n_tasks, "fp").mapInArrow(_variants(max_bits, n_buckets), "bucket long, variants binary, codes binary")
            .groupBy("bucket").applyInArrow(_collisions(max_bits), "a long, b long").distinct())


def _grouped(each: DataFrame, max_bits: int) -> DataFrame:
    """The rows of ``each`` (doc_id, fp, ...) with their component's root."""
    distinct = written(each.select("fp").distinct(), "distinct")
    roots = components(ball_links(distinct, max_bits))
    rooted = written(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root")), "roots")
    return each.join(rooted, "fp")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp and component_id of every document."""
    each = written(fingerprints(docs, shingle), "fingerprints")
    of_fp = each.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))       # copies first, within each task
    rooted = written(_grouped(of_fp, max_bits), "rooted")
    least = written(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    named = written(rooted.join(least, "root").select("fp", "component_id"), "components")
    return each.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component of ``docs``, all columns as they are: that of
    the smallest doc_id (null only if there is no other). Of rows that share
    it, that with the smallest hash of its text stays, once."""
    key = {"__null": F.col("doc_id").isNull(), "__id": F.coalesce("doc_id", F.lit(0)), "__text": F.xxhash64("text")}
    keyed = docs.withColumns(key)
    prints = written(fingerprints(docs, shingle, keep_hash=True), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("__null"), F.coalesce("doc_id", F.lit(0)).alias("__id"), F.col("text_hash").alias("__text"))).alias("first")
    rooted = written(_grouped(prints.groupBy("fp").agg(first), max_bits), "rooted")
    keep = written(rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.*"), "keep")
    return keyed.join(keep, list(key), "left_semi").dropDuplicates(list(key)).drop(*key)
