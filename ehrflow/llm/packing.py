"""Packing documents into sequences: exact complements first, then best fit.

Only a document longer than a sequence is cut, into full pieces and a first
piece that may be shorter. Full pieces are sequences by themselves; the others
are placed by their length alone, so the plan is made from the number of
pieces of each length: at most ``capacity`` counts, whatever the size of the
corpus. From the longest length down, single lengths, pairs and triples that
fill its gap exactly are consumed as often as they are available; the rest is
placed by best fit, decreasing.

A plan is a list of runs: of the pieces of one length, those with rank lo to
hi - 1 go to the sequences from a base, at one offset. The rank of a piece is
its place among its length in the partition that made it plus the counts of
the partitions before, so a length that very many pieces have is ranked by
many tasks.

Token ids are those of the tokenizer's file, its special tokens included where
a text spells one out. They are made with tiktoken on the vocabulary in that
file, which gives the same ids several times faster, and with the file itself
for texts that hold a special token or that tiktoken gives up on.

Defined results: a null or empty text is one piece that holds only the end
id; rows with equal or null doc_ids are packed each; an empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

import json
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ehrflow.llm import _text
from ehrflow.llm._shared import written

CAPACITY = 1024
END_ID = 2
_ENCODERS: dict[str, tuple] = {}

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, part int, pos long, ids binary"


def _encoder(path: str) -> tuple:
    """tiktoken on the vocabulary of a byte-level BPE file, the file's own
    tokenizer, and the texts of its added tokens."""
    if path not in _ENCODERS:
        import tiktoken
        import public_tokenizers
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        # the file writes bytes as letters: printable ones as themselves, the others from 256 up
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if all(c in letters for c in token) and not token.startswith("<|")}
        fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        whole = Tokenizer.from_file(path)
        _ENCODERS[path] = fast, whole, tuple(t.content for t in whole.get_added_tokens_decoder().values())
    return _ENCODERS[path]


def token_ids(text: str | None, path: str) -> np.ndarray:
    """The ids of a text, without an end id."""
    if not text:
        return np.zeros(0, np.uint32)
    fast, whole, added = _encoder(path)
    try:
        if not any(t in text for t in added):
            return fast.encode_to_numpy(text)
    except BaseException as e:  # the Rust code's panics are no Exceptions
        if isinstance(e, (KeyboardInterrupt, SystemExit)):
            raise
    return np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document: doc_id, piece, start (ids before it),
    length, its ids (little-endian unsigned 32 bits), and part and pos, its
    place among the pieces of its length in its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in _text.chunks(batches):
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.append(token_ids(text, tokenizer), end_id).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    rows.append((doc, k, a, b - a, part, int(seen[b - a]), ids[a:b].tobytes()))
                    seen[b - a] += 1
            columns = list(zip(*rows))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "part", "pos", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECE_SCHEMA)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, lo, hi, first sequence, offset) that place all pieces,
    given the number of pieces of each length."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    filled: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: tuple[int, ...]) -> None:
        need = {x: lengths.count(x) for x in lengths}
        n = min(int(left[x]) // k for x, k in need.items())
        if n > 0:
            for x, k in need.items():
                left[x] -= n * k
            filled.append((lengths, n))

    full = int(left[capacity])
    if full:
        take((capacity,))
    longest = range(capacity - 1, 0, -1)
    for a in longest:                                         # one length fills the gap
        if left[a]:
            b = capacity - a
            take((a, b))
    for a in longest:                                         # two do
        gap = capacity - a
        for b in range(min(a, gap - 1), (gap + 1) // 2 - 1, -1):
            if left[a] and left[b] and left[gap - b]:
                take((a, b, gap - b))
    for a in longest:                                         # three do
        gap = capacity - a
        for b in range(min(a, gap - 2), 0, -1):
            if not left[a]:
                break
            if left[b]:
                rest = gap - b
                c = np.arange(min(b, rest - 1), (rest + 1) // 2 - 1, -1)
                for x in c[(left[c] > 0) & (left[rest - c] > 0)].tolist() if len(c) else ():
                    if left[a] and left[b] and left[x] and left[rest - x]:
                        take((a, b, x, rest - x))
    open_gaps: list[int] = []                                 # best fit: the smallest gap that holds the length
    by_gap: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(lengths: tuple[int, ...], n: int) -> None:
        gap = capacity - sum(lengths)
        if not gap:
            filled.append((lengths, n))
            return
        if gap not in by_gap:
            by_gap[gap] = []
            insort(open_gaps, gap)
        by_gap[gap].append((lengths, n))

    for a in longest:
        while left[a]:
            at = bisect_left(open_gaps, a)
            if at < len(open_gaps):
                gap = open_gaps[at]
                lengths, n = by_gap[gap].pop()
                if not by_gap[gap]:
                    del by_gap[gap]
                    open_gaps.pop(at)
                m = min(n, int(left[a]))
                if n > m:
                    put(lengths, n - m)
                left[a] -= m
                put((*lengths, a), m)
            else:
                k = capacity // a                             # as many of it as one sequence holds
                whole, rest = divmod(int(left[a]), k)
                left[a] = 0
                if whole:
                    put((a,) * k, whole)
                if rest:
                    put((a,) * rest, 1)
    filled += [x for group in by_gap.values() for x in group]
    runs, used, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for lengths, n in filled:
        offset = 0
        for x in lengths:
            runs.append((x, int(used[x]), int(used[x]) + n, sequence, offset))
            used[x] += n
            offset += x
        sequence += n
    return runs


def placed(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``made`` (a written table of ``pieces``) with sequence_id and offset in
    place of part and pos."""
    counts = written(made.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    total = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}      # at most ``capacity`` rows
    runs = sorted(plan(total, capacity))
    key = np.array([(r[0] << 44) + r[1] for r in runs], np.int64)
    sequence, offset, lo = (np.array([r[k] for r in runs], np.int64) for k in (3, 4, 1))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = made.join(before, ["part", "length"]).withColumn("pos", F.col("pos") + F.col("before")).drop("part", "before")
    kept = [c for c in ranked.columns if c != "pos"]
    schema = ", ".join(f"`{c}` {t}" for c, t in ranked.dtypes if c != "pos") + ", sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rank = batch.column("pos").to_numpy(zero_copy_only=False)
                at = np.searchsorted(key, (batch.column("length").to_numpy(zero_copy_only=False) << 44) + rank, "right") - 1
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence[at] + rank - lo[at]), pa.array(offset[at])],
                                                 names=[*kept, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id, offset of every piece;
    without ``keep_ids``, ids_crc32 (unsigned) in place of ids."""
    made = pieces(docs, tokenizer, capacity, end_id)
    if not keep_ids:
        made = made.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return placed(written(made, "pieces"), capacity)
