from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ehrflow.llm import mixing
from tests.llm.conftest import documents, words


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        rest, share = total - sum(fixed.values()), sum(w[s] for s in free)
        above = [s for s in free if rest * w[s] / share > most * sizes[s]]
        if not above:
            return {s: fixed.get(s, rest * w[s] / share if s in free else 0.0) for s in order}
        fixed.update({s: float(most * sizes[s]) for s in above})
        if len(fixed) == len(order):
            return fixed


def brute_copies(rows, targets):
    """rows: (rank, size) of each document of a source, with its target."""
    out = {}
    for s, docs in rows.items():
        total = sum(z for _, z in docs)
        whole = int(targets[s] // total) if total else 0
        missing, bound, words_in = targets[s] - whole * total, -1, 0
        for rank in sorted({r for r, _ in docs}):
            if missing <= 0:
                break
            own = sum(z for r, z in docs if r == rank)
            if words_in + own < missing:
                words_in, bound = words_in + own, rank
                continue
            if words_in + own - missing <= missing - words_in:
                bound = rank
            break
        out[s] = whole, bound
    return out


def _check(docs):
    ranked = mixing._ranked(docs).collect()
    sizes, rows = defaultdict(int), defaultdict(list)
    for r in ranked:
        sizes[r.source] += r.size
        rows[r.source].append((r["rank"], r.size))
    want = brute_targets(dict(sizes))
    copies = brute_copies(rows, want)
    found = mixing.mix(docs).collect()
    assert len(found) == len(ranked)
    taken = defaultdict(int)
    for r in found:
        assert r.target == pytest.approx(want[r.source], abs=1e-6) and r.source_size == sizes[r.source]
        taken[r.source] += r.copies * r.size
    for s, (whole, bound) in copies.items():
        assert taken[s] == sum(z * (whole + (r <= bound)) for r, z in rows[s])
        assert abs(taken[s] - want[s]) <= max(z for _, z in rows[s]) / 2 + 1e-6
    assert max(r.copies for r in found) <= 3
    return found


def test_equals_brute_force(spark):
    docs = documents(spark, "0.01").withColumn("source", F.when(F.col("doc_id") % 17 == 0, None).otherwise(F.col("source")))
    found = _check(docs)
    again = mixing.mix(docs.repartition(7)).collect()
    assert {(r.doc_id, r.copies) for r in found} == {(r.doc_id, r.copies) for r in again}
    counts = {r.doc_id: r.copies for r in found if r.copies}
    rows = mixing.mixed(docs)
    assert rows.columns == docs.columns
    assert {r.doc_id: r["count"] for r in rows.groupBy("doc_id").count().collect()} == counts


def test_sizes_are_words(spark):
    docs = documents(spark)
    found = {r.doc_id: r["size"] for r in mixing.mix(docs).collect()}
    assert found == {r.doc_id: len(words(r.text)) for r in docs.collect()}


def test_edges(spark, edge_docs, no_docs):
    found = mixing.mix(edge_docs).collect()
    assert len(found) == 12 and all(r["size"] == 0 for r in found if r.doc_id in (1, 2, 3))
    assert mixing.mixed(edge_docs).columns == edge_docs.columns
    assert mixing.mixed(edge_docs).count() == sum(r.copies for r in found)
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed(no_docs).count() == 0


def test_targets_stop_at_three_times_the_size(spark):
    sizes = {"a": 1000, "b": 10, "c": 10, "d": 0, "é": 500, None: 5}
    found = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    assert {r.source: r.target for r in found} == pytest.approx(brute_targets(sizes))


def test_one_source_and_one_document(spark):
    rows = [(1, "a b c", None, "s", 5)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    assert [(r["size"], r.target, r.copies) for r in found] == [(3, 3.0, 1)]
