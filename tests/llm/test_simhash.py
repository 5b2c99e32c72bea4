import numpy as np
import xxhash

from ehrflow.llm import simhash
from ehrflow.llm.components import components
from tests.llm.conftest import documents, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text, n=3):
    w = words((text or "").translate(LOWER))
    shingles = [" ".join(w[i:i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] * bool(w)
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if votes[b] * 2 > len(shingles))


def groups(fps, bits):
    """Smallest reachable index of each, by all pairs."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= bits:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(fps))]


def test_equals_brute_force(spark):
    docs = documents(spark)
    rows = sorted(docs.select("doc_id", "text").collect())
    fps = [fingerprint(r.text) for r in rows]
    ids = [r.doc_id for r in rows]
    want = {i: (f"{f:016x}", ids[g]) for i, f, g in zip(ids, fps, groups(fps, 3))}
    found = simhash.near_duplicates(docs).select("doc_id", simhash.hex_fingerprint().alias("h"), "component_id").collect()
    assert {r.doc_id: (r.h, r.component_id) for r in found} == want


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_of_every_distance(spark):
    rng = np.random.default_rng(5)
    for bits in (0, 1, 2, 3):
        fps = []
        for _ in range(12):
            base = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
            fps.append(base)
            for d in (1, 2, 3, 4, 5):
                for half in (range(32), range(32, 64), range(64)):
                    fps.append(base ^ sum(1 << int(b) for b in rng.choice(list(half), d, replace=False)))
        fps = sorted(set(fps))
        distinct = spark.createDataFrame([(_signed(f),) for f in fps], "fp long")
        links = simhash.ball_links(distinct, bits).collect()
        assert all((r.a ^ r.b & (1 << 64) - 1).bit_count() <= 64 and ((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= bits for r in links)
        root = {f: f for f in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for r in links:
            x, y = sorted((find(r.a % (1 << 64)), find(r.b % (1 << 64))))
            root[y] = x
        assert [fps.index(find(f)) for f in fps] == groups(fps, bits)


def test_edges(spark, edge_docs, edge_rows, no_docs):
    found = simhash.near_duplicates(edge_docs).select("doc_id", simhash.hex_fingerprint().alias("h"), "component_id").collect()
    assert sorted((r.h for r in found)) == sorted(f"{fingerprint(r[1]):016x}" for r in edge_rows)
    zero = [r for r in found if r.h == "0" * 16]
    assert len(zero) == 4 and {r.component_id for r in zero} == {1}
    assert {r.component_id for r in found if r.doc_id in (6, 7)} == {6}
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.one_of_each(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 4, 5, 6, 8, 9]
    assert simhash.one_of_each(no_docs).count() == 0


def test_long_chain_is_one_component(spark):
    chain = [(i, i + 1) for i in range(0, 200)] + [(1000, 1001), (7, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
