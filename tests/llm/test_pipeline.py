import re
import shutil
import subprocess
import sys
import tempfile
from pathlib import Path

import corpus_pipeline
from ehrflow.llm import queries
from ehrflow.llm._shared import positions, written
from pyspark.sql import functions as F
from tests.llm.test_packing import check, ids
from tests.llm.test_simhash import fingerprint

SF = "/root/testdata/sf0.001"
REPO = Path(__file__).parents[2]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("kept", F.lit("own"))
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, SF), name)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        kept.append((docs.collect(), out.collect()))
        docs = out
    (before, good), (_, single), (_, masked), (_, mixed) = kept
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids_good = {r.doc_id for r in good}
    assert sum(labels.get(r.doc_id) == 1 and r.doc_id in ids_good for r in before) >= 0.95 * sum(labels.get(r.doc_id) == 1 and len((r.text or "").split()) > 60 for r in before)
    assert not any(labels.get(i) == 0 for i in ids_good)
    prints = [fingerprint(r.text) for r in single]
    assert all((a ^ b).bit_count() > 3 for k, a in enumerate(prints) for b in prints[:k]) and len(single) <= len(good)
    assert {r.doc_id for r in masked} == {r.doc_id for r in single} and not any(re.search(r'token = "[0-9a-f]{40}"', r.text) for r in masked)
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in masked}
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sum(r.length for r in rows) == sum(len(ids(r.text)) for r in mixed)
    check(rows, 1024)


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0 and corpus_pipeline.ORACLE_SQL is None
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "secret_scans", "mixing_sources", "best_fit_packing"]


def test_every_operator_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in queries.QUERIES) == list(range(1, 14)) and set(queries.ORACLE) <= set(queries.QUERIES)


def test_entry_works_without_the_subpackage():
    copy = Path(tempfile.mkdtemp(prefix="ehrflow-without-")) / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [k for k in q if k.startswith('op') and k[2:3].isdigit()] and 'pipeline' not in q; assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={"PATH": "/usr/bin:/bin", "HOME": "/tmp"})


def test_positions(spark):
    rows = [(x,) for x in [5, 3, 3, None, 9, 1, 7] * 30]
    out = positions(spark.createDataFrame(rows, "v long"), [F.col("v").isNull(), F.col("v")]).collect()
    assert sorted(r.idx for r in out) == list(range(len(rows)))
    assert [r.v for r in sorted(out, key=lambda r: r.idx)] == sorted((r[0] for r in rows if r[0] is not None)) + [None] * 30
