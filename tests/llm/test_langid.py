import zlib

import numpy as np

from ehrflow.llm import langid
from tests.llm.conftest import documents


def test_held_out_accuracy_and_split(spark):
    docs = documents(spark, "0.01")
    model = langid.train(docs)
    found = {r.doc_id: r for r in langid.predicted(docs.drop("lang", "source"), model).collect()}
    rows = docs.collect()
    assert all(found[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= found[r.doc_id].score <= 1 for r in rows)
    held = [r for r in rows if found[r.doc_id].held_out]
    assert np.mean([found[r.doc_id].lang_pred == r.lang for r in held]) > 0.97
    assert set(model.languages) == {"de", "en", "es", "fr"} and (model.weights == 0).mean() > 0.5


def test_held_out_rows_teach_nothing(spark):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 == 1]
    rows = [(i, "only held out", "xx") for i in ids] + [(i, "alpha beta gamma", "aa") for i in range(60) if i not in ids] + [(None, "no id", "yy")]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["aa"]


def test_edges(spark, edge_docs, no_docs):
    model = langid.train(documents(spark))
    found = langid.predicted(edge_docs, model).collect()
    assert len(found) == 12
    by = {r.doc_id: r for r in found}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1, 2, 3)) and by[4].lang_pred != "und" and by[9].lang_pred != "und"
    odd = spark.createDataFrame([(1, "123 .. 😀"), (2, "ñ"), (3, "你"), (None, "a")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in langid.predicted(odd, model).collect()}
    assert got[1] == "und" and all(got[i] in model.languages for i in (2, 3, None))
    assert langid.train(no_docs) is None and langid.predicted(no_docs, None).count() == 0
    assert {r.lang_pred for r in langid.predicted(edge_docs, None).collect()} == {"und"}


def test_gram_counts():
    import pyarrow as pa
    counts = list(langid._counts(pa.array(["abcab", None, "x", "ab"])))
    assert [int(c.sum()) for c in counts] == [4 + 3, 0, 0, 1]
    assert counts[0].max() >= 2


def test_fit_is_follow_the_regularised_leader():
    """Against the rule in plain Python, a coordinate at a time."""
    rng = np.random.default_rng(4)
    classes, rows, alpha, beta, l1, l2 = 3, 26, 0.5, 1.0, 0.05, 0.05
    at = [np.sort(rng.choice(40, 6, replace=False)).astype(np.int32) for _ in range(rows)]
    x = [rng.random(6) for _ in range(rows)]
    y = rng.integers(0, classes, rows)
    seen, held = [0] * classes, []
    for c in y:
        held.append(seen[c] % 5 == 4)
        seen[c] += 1
    z, n = [dict() for _ in range(classes)], [dict() for _ in range(classes)]

    def weight(c, k):
        zk, penalty = z[c].get(k, 0.0), 0.0 if k == langid.DIMS else l1
        return 0.0 if abs(zk) <= penalty else -(zk - np.sign(zk) * penalty) / ((beta + n[c].get(k, 0.0) ** 0.5) / alpha + l2)

    for _ in range(4):
        for i in range(rows):
            if not held[i]:
                pairs = [*zip(at[i].tolist(), x[i].tolist()), (langid.DIMS, 1.0)]
                w = [[weight(c, k) for k, _ in pairs] for c in range(classes)]
                logit = [sum(a * v for a, (_, v) in zip(w[c], pairs)) for c in range(classes)]
                top = max(logit)
                p = [np.exp(v - top) for v in logit]
                for c in range(classes):
                    for j, (k, v) in enumerate(pairs):
                        g = (p[c] / sum(p) - (y[i] == c)) * v
                        more = n[c].get(k, 0.0) + g * g
                        z[c][k] = z[c].get(k, 0.0) + g - (more ** 0.5 - n[c].get(k, 0.0) ** 0.5) / alpha * w[c][j]
                        n[c][k] = more
    weights, intercepts, temperature = langid.fit(at, x, y, classes)
    for c in range(classes):
        want = np.array([weight(c, k) for k in range(40)])
        assert np.allclose(weights[c, :40], want, atol=1e-9) and not weights[c, 40:].any() and abs(intercepts[c] - weight(c, langid.DIMS)) < 1e-9
    logits = [weights[:, a] @ v + intercepts for i, (a, v) in enumerate(zip(at, x)) if held[i]]
    assert logits and 0.05 <= temperature <= 20


def test_a_rare_language_keeps_its_rows(spark):
    """One document of a language among many of another, wherever its hash
    puts it."""
    for i in range(12):
        rows = [(k, f"the and of to in that {k}", "en") for k in range(100, 160)] + [(3 * i + 200, "zwölf große bären würden über", "de")]
        model = langid.train(spark.createDataFrame(rows[:20] + rows[-1:] if i % 2 else rows, "doc_id long, text string, lang string"))
        if zlib.crc32(str(3 * i + 200).encode()) % 3 != 1:
            assert model.languages == ["de", "en"]
            d = model.languages.index("de")
            assert (model.weights[d] != 0).any()
            return


def test_many_languages_and_repeated_rows_stay_bounded(spark):
    from pyspark.sql import functions as F
    many = spark.range(10_000).select(F.col("id").alias("doc_id"), F.lit("some words of it").alias("text"), F.concat(F.lit("l"), F.col("id").cast("string")).alias("lang"))
    common = spark.range(20_000, 20_300).select(F.col("id").alias("doc_id"), F.concat(F.lit("common words "), F.col("id").cast("string")).alias("text"), F.lit("common").alias("lang"))
    again = spark.range(3_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one row three thousand times").alias("text"), F.lit("again").alias("lang"))
    docs = many.unionAll(common).unionAll(again)
    model = langid.train(docs, sample=20, max_languages=5)
    assert len(model.languages) <= 5 and {"common", "again"} >= set(model.languages) - {x for x in model.languages if x[0] == "l"}
    teach = docs.filter(~langid.held_out(F.col("doc_id"))).groupBy("lang").count().collect()
    sizes = sorted(((-r["count"], r.lang) for r in teach))
    assert model.left_out == (len(sizes) - 5, -sum(n for n, _ in sizes[5:]))
