import hashlib
import re

from pyspark.sql import functions as F

from ehrflow.llm import sketches
from tests.llm.conftest import DOCS, documents, words


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def _rows(docs):
    return sketches.edited_pairs(docs).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("sha"), sketches.fingerprint("sketch").alias("fp"), sketches.fingerprint("edited_sketch").alias("edited_fp"),
        sketches.likeness("sketch", "edited_sketch").alias("near_edited"), sketches.likeness("sketch", "next_sketch").alias("near_next"), "sketch").collect()


def test_edited_texts_and_likeness(spark):
    docs = documents(spark)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = sorted(texts)
    found = {r.doc_id: r for r in _rows(docs)}
    gap = []
    for k, i in enumerate(ids):
        text, after = texts[i], texts[ids[(k + 1) % len(ids)]]
        n = len(text) // 4
        edited = text[:len(text) - n] + after[:n]
        assert found[i].n_chars == len(text) and found[i].sha == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(text), shingles(edited)
        if len(a) > 200:
            gap.append(found[i].near_edited - len(a & b) / len(a | b))
    assert abs(sum(gap) / len(gap)) < 0.03 and max(map(abs, gap)) < 0.3
    equal = {}
    for i, t in texts.items():
        assert equal.setdefault(t, found[i].fp) == found[i].fp


def test_sketch_keeps_a_fraction_and_merges(spark):
    docs = spark.createDataFrame([(1, " ".join(f"a{i}" for i in range(20_000))), (2, " ".join(f"a{i}" for i in range(10_000))), (3, "a b")], "doc_id long, text string")
    made = sketches.with_sketch(docs, "text", "s")
    rows = {r.doc_id: r.s for r in made.collect()}
    assert abs(len(rows[1]) / 19_996 - 1 / 8) < 0.01 and all(h < (1 << 48) // 8 for h in rows[1]) and len(rows[3]) == 1
    both = sketches.merged(made.filter("doc_id < 3").withColumn("all", F.lit(1)), "all", "s").first().s
    assert both == sorted(set(rows[1]) | set(rows[2]))
    pair = made.filter("doc_id = 2").select(F.col("s").alias("b")).join(made.filter("doc_id = 1").select("s"))
    assert pair.select(sketches.containment("b", "s").alias("c")).first().c == 1.0


def test_likeness_of_short_and_middling_texts(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(n))) for i, n in enumerate([*range(10, 101)] * 2 + [*range(200, 1600, 50)])], "doc_id long, text string")
    rows = sketches.edited_pairs(docs).select("text", "edited", sketches.likeness("sketch", "edited_sketch").alias("near"), sketches.containment("edited_sketch", "sketch").alias("part")).collect()
    for r in rows:
        a, b = shingles(r.text), shingles(r.edited)
        gap = max(abs(r.near - len(a & b) / len(a | b)), abs(r.part - len(a & b) / len(b)))
        assert gap < 1e-9 if max(len(a), len(b)) < sketches.LEAST else gap < 0.2
    texts = [" ".join(f"a{j}" for j in range(n)) for n in (5000, 40)]          # a long text and its beginning
    long, short = (sketches.with_sketch(spark.createDataFrame([(1, t)], "k long, text string"), "text", c).select("k", c) for t, c in zip(texts, "ab"))
    both = long.unionAll(short)
    assert sketches.merged(both, "k", "a").first().a == long.first().a
    pair = long.join(short, "k").select(sketches.likeness("a", "b").alias("l"), sketches.containment("b", "a").alias("c")).first()
    assert pair.l < 0.05 and pair.c in (0.0, 1.0)


def test_edges(spark, edge_docs, edge_rows, no_docs):
    found = _rows(edge_docs)
    assert len(found) == len(edge_rows) and sorted(r.n_chars for r in found) == sorted(len(r[1] or "") for r in edge_rows)
    assert all(0 <= x <= 1 for r in found for x in (r.near_edited, r.near_next))
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].fp == by[2][0].fp == by[3][0].fp == "" and by[1][0].near_next == 1.0
    assert len(by[4]) == 2 and by[4][0] == by[4][1] and by[6][0].fp == by[7][0].fp
    assert _rows(no_docs) == []
    one = _rows(spark.createDataFrame([(7, "a b c d e f g h", None, None, None)], DOCS))
    assert one[0].sha == hashlib.sha256(b"a b c d e f a b").hexdigest()        # alone, its next is itself


def test_last_document_wraps(spark):
    docs = spark.createDataFrame([(10, "abcdefgh"), (20, "XY"), (5, "12345678")], "doc_id long, text string")
    want = {5: "123456ab", 10: "abcdefXY", 20: "XY"}
    assert {r.doc_id: r.edited for r in sketches.edited_pairs(docs).collect()} == want


def test_plan_has_no_python(spark, capsys):
    sketches.edited_pairs(documents(spark)).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)
