import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ehrflow.llm import _text, resampling
from tests.llm.conftest import documents

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def feats(text, n, buckets):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = WORD.findall(text)
    return [zlib.crc32(" ".join(w[i:i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)], len(w)


def model(docs, bench, n=1, buckets=10_000, percent=10, least=20):
    s, t = [0] * buckets, [0] * buckets
    for of, rows in ((s, [d[1] for d in docs]), (t, bench)):
        for text in rows:
            for b in feats(text, n, buckets)[0]:
                of[b] += 1
    gain = [math.floor(1000 * math.log((tt + 1) * (sum(s) + buckets) / ((ss + 1) * (sum(t) + buckets)))) for ss, tt in zip(s, t)]
    rows = []
    for doc_id, text in docs:
        f, words = feats(text, n, buckets)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        rows.append([doc_id, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words])
    enough = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = enough[:percent * len(enough) // 100]
    return sorted(([*r[:4], k + 1] for k, r in enumerate(drawn)), key=repr) + sorted(([*r[:4], None] for r in rows if not any(r is d for d in drawn)), key=repr)


def rows_of(df):
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"] and all(t == "bigint" for _, t in df.dtypes)
    got = [list(r) for r in df.collect()]
    return sorted((r for r in got if r[4] is not None), key=repr) + sorted((r for r in got if r[4] is None), key=repr)


def by_rank(rows):
    return sorted((r for r in rows if r[4] is not None), key=lambda r: r[4]), sorted((r for r in rows if r[4] is None), key=repr)


@pytest.mark.parametrize("n,buckets,percent", [(1, 10_000, 10), (2, 500, 33)])
def test_brute_force(spark, n, buckets, percent):
    docs, bench = documents(spark), spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = model([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in bench.collect()], n, buckets, percent)
    got = rows_of(resampling.resampled(docs, bench, n=n, buckets=buckets, percent=percent))
    assert by_rank(got) == by_rank(want)
    assert rows_of(resampling.resampled(docs.repartition(7), bench, n=n, buckets=buckets, percent=percent, accuracy=50)) == got


def test_edges(spark, edge_docs, edge_rows, no_docs):
    bench = spark.createDataFrame([(1, None), (2, "the same text"), (3, "")], "item_id long, text string")
    want = model([r[:2] for r in edge_rows], [None, "the same text", ""], percent=60, least=3)
    got = rows_of(resampling.resampled(edge_docs, bench, percent=60, min_words=3))
    assert by_rank(got) == by_rank(want)
    nothing = bench.limit(0)
    assert resampling.resampled(no_docs, bench).count() == 0 and resampling.resampled(no_docs, nothing).count() == 0
    got = rows_of(resampling.resampled(edge_docs, nothing))                           # one row in ten of too few: none
    assert len(got) == len(edge_rows) and all(r[4] is None for r in got)


def test_words_of_odd_bytes():
    rng = random.Random(3)
    texts = ["".join(rng.choice(" \n\x00aZ09/:@[`{\x7f\x80éß漢😀") for _ in range(rng.randint(0, 30))) for _ in range(300)] + ["", "A", "é", None]
    found, many, words = resampling.features(*_text.flat(pa.array(texts)), 3, 1000)
    to = np.concatenate(([0], np.cumsum(many)))
    for k, t in enumerate(texts):
        want, w = feats(t, 3, 1000)
        assert sorted(found[to[k]:to[k + 1]].tolist()) == sorted(want) and words[k] == w


def test_bracket_is_widened_until_it_holds_the_cutoff(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(400)]), rng.choice([-50, 0, 0, 0, 7, rng.randint(-1000, 1000)]), 1) for _ in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, score long, n_features long").repartition(5).persist()
    ordered = sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0] or 0))
    for k, low, high in ((1, -1000, -990), (1500, 900, 1000), (700, -3, -2), (700, 5, 5), (700, -1000, 1000), (900, 2000, 2001)):
        assert resampling.cutoff(df, k, low, high) == (ordered[k - 1][1], ordered[k - 1][0])


def test_ties_go_to_the_smaller_doc_id(spark, monkeypatch):
    monkeypatch.setattr(resampling, "noise", lambda doc_id, seed: F.lit(0).cast("long"))
    docs = spark.createDataFrame([(i, "same words here") for i in range(300, 0, -1)], "doc_id long, text string").repartition(6)
    got = rows_of(resampling.resampled(docs, docs.limit(0), percent=15, min_words=1))
    assert [(r[0], r[4]) for r in by_rank(got)[0]] == [(i, i) for i in range(1, 46)]
