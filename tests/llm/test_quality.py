import tracemalloc
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

import pyarrow as pa
from ehrflow.llm import _text, quality
from tests.llm.conftest import WORD, documents, words


def brute(text):
    text = text or ""
    w = words(text)
    windows = Counter(zip(*(w[k:] for k in range(5))))
    marked = {j for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(marked)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab# \n\té\u00a0😀", max_size=60), max_size=8))
def test_counts_equal_brute_force(texts):
    data, offsets = _text.flat(pa.array(texts, pa.string()))
    found = quality.base_counts(data, offsets, *_text.words(data, offsets))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert [tuple(int(found[n][i]) for n in names) for i in range(len(texts))] == [brute(t) for t in texts]


def test_edges_and_clashing_columns(spark, edge_docs, edge_rows):
    out = quality.judged(edge_docs, None).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.kept) for r in out)
    want = Counter()
    for row in edge_rows:
        n, *rest, repeat = brute(row[1])
        want[(row[0], n, *rest, repeat, not (n < 10 or 100 * repeat > 20 * n))] += 1
    assert got == want
    kept = quality.kept_rows(edge_docs, None)
    assert kept.columns == edge_docs.columns and kept.count() == sum(n for k, n in want.items() if k[-1])


def test_without_labels_or_rows(spark, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.train(documents(spark), labels) is None
    assert quality.judged(no_docs, quality.train(no_docs, labels)).count() == 0
    odd = spark.createDataFrame([(1, None, 0), (None, 1, 0), (2, 7, 0)], "doc_id long, quality int, toxic int")
    assert quality.train(documents(spark), odd) is None


def test_held_out_accuracy(spark):
    """Trained on the labels of even ids, held against those of odd ids."""
    docs, labels = documents(spark, "0.1"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = quality.train(docs, labels.filter("doc_id % 2 = 0"), sample=300)
    rows = quality.judged(docs.join(labels.filter("doc_id % 2 = 1").select("doc_id"), "doc_id"), model).join(labels, "doc_id").collect()
    right = np.mean([r.kept == bool(r.quality) for r in rows if not r.base_failed])
    assert len(rows) > 1000 and right > 0.985
    p = np.array([r.probability for r in rows])
    assert abs(p.mean() - np.mean([r.quality for r in rows])) < 0.03


def test_platt_is_monotone_and_finite():
    slope, shift = quality.platt(np.array([-2.0, -1.0, 1.0, 2.0]), np.array([0.0, 0.0, 1.0, 1.0]), 0.5)
    assert slope > 0 and np.isfinite([slope, shift]).all()


def test_repeated_labelled_rows_stay_bounded(spark, monkeypatch):
    """Two labelled doc_ids, 1,500 rows each: one row of each is fitted."""
    texts = {1: "good words in a row of some length here", 2: "bad bad bad stuff of another kind there"}
    docs = spark.createDataFrame([(k, f"{texts[k]} {i}") for i in range(1500) for k in (1, 2)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda where, value, y, share: seen.append(len(y)))
    quality.train(docs, labels, sample=1)
    quality.train(docs.repartition(7), labels, sample=1)
    assert seen == [2, 2]


def test_fit_holds_little_beside_the_vectors(monkeypatch):
    """The fit unpacks some rows at a time, and gives the same however many."""
    rng = np.random.default_rng(1)
    where = [np.unique(rng.integers(0, quality.BLOCKS * quality.BUCKETS, n)).astype(np.int32) for n in [0, 1, 40_000, *[20_000] * 97]]
    value = [rng.random(len(x)).astype(np.float32) / 1000 for x in where]
    y = rng.integers(0, 2, len(where)).astype(float)
    tracemalloc.start()
    model = quality.fit(where, value, y, rounds=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < sum(x.nbytes + v.nbytes for x, v in zip(where, value))
    for entries in (1, 1 << 30):
        monkeypatch.setattr(quality, "ENTRIES", entries)
        other = quality.fit(where, value, y, rounds=2)
        assert (other.weights == model.weights).all() and (other.intercept, other.slope, other.shift) == (model.intercept, model.slope, model.shift)
