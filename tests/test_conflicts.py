import random
import tempfile

import pytest
from pyspark.sql import functions as F

from ehrflow.operators import conflicts as C
from ehrflow.operators import lookup
from ehrflow.operators import writes as W
from ehrflow.session import release, scratch_path
from tests.test_writes import AS_OF, BATCH, PAT, run_insert, sequential


def test_a_chain_of_thousands_takes_few_jobs(spark):
    """Each row shares its document with the row before and its e-mail with
    the row after, so a rule by rounds needs a round for every second one."""
    n = 5000
    batch = [(100 + s // 2, f"m{(s + 1) // 2}", s) for s in range(n)]
    random.Random(3).shuffle(batch)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("chain", "chain")
    try:
        got, _ = run_insert(spark, [(1, "a")], batch)
        jobs = len(tracker.getJobIdsForGroup("chain"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == sequential([(1, "a")], batch) and sum(v == "aceptado" for v in got.values()) == n // 2
    assert jobs < 400


@pytest.mark.parametrize("max_component", [1, 4, 1000])
def test_components_and_rounds_together(spark, max_component):
    rnd = random.Random(max_component)
    for _ in range(2):
        current = [(rnd.randint(0, 6), rnd.choice([None, "a", "b"])) for _ in range(2)]
        batch = [(rnd.randint(0, 40), rnd.choice([None, *"abcdefghijklmnopqrstuvwxyz"]), s) for s in rnd.sample(range(1000), 90)]
        cur = spark.createDataFrame([(d, m, "x", None, "h") for d, m in current], PAT)
        acc, rej = W.insert_patients(cur, spark.createDataFrame([(d, m, "y", None, "h", s) for d, m, s in batch], BATCH), AS_OF, max_component=max_component)
        got = {r.seq: "aceptado" for r in acc.select("seq").collect()} | {r.seq: r.motivo for r in rej.collect()}
        assert got == sequential(current, batch)


def test_connected(spark):
    rnd = random.Random(11)
    edges = [(rnd.randint(0, 120), rnd.randint(0, 120)) for _ in range(90)] + [(500, k) for k in range(501, 700)] + [(k, k + 1) for k in range(1000, 1300)] + [(7, 7)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = root(u), root(v)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "u long, v long").repartition(5)
    got = {r.node: r.component for r in C.connected(df, tempfile.mkdtemp(prefix="ehrflow-graph-")).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}
    assert C.connected(df.limit(0), tempfile.mkdtemp(prefix="ehrflow-graph-")).count() == 0


def test_ties_do_not_depend_on_the_partitioning(spark):
    rows = [(k % 7, f"v{i}", 1, [str(i)]) for i, k in enumerate(range(140))]
    df = spark.createDataFrame(rows, "k long, v string, seq long, codes array<string>")
    mapped = df.withColumn("m", F.create_map(F.lit("a"), F.col("v")))
    seen, other, down = set(), set(), set()
    for n in range(1, 7):
        for seed in (1, 2):
            dealt = df.repartition(n, F.xxhash64("v", F.lit(seed)))
            seen.add(tuple(sorted((r.k, r.v) for r in W.insert_or_ignore(df.drop("seq").limit(0), dealt, ["k"])[1].collect())))
            other.add(tuple(sorted((r.k, r.v) for r in lookup.first_per(mapped.repartition(n, F.xxhash64("v", F.lit(seed))), ["k"], ["seq"]).collect())))
            down.add(tuple(sorted((r.k, r.v) for r in lookup.first_per(dealt, ["k"], ["seq"], descending=True).collect())))
    assert len(seen) == len(other) == len(down) == 1 and len(next(iter(seen))) == 7


def test_scratch_is_released(spark):
    import os
    path = scratch_path(spark, "probe")
    spark.range(3).write.parquet(path)
    at = path.removeprefix("file:")
    assert os.path.exists(at)
    release(spark)
    assert not os.path.exists(at)
