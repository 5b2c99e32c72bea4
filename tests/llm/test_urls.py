import numpy as np
from pyspark.sql import functions as F

from ehrflow.llm import urls

CASES = [
    ("https://a.net/x", "a.net", "/x", None, None), ("https://x.net", "x.net", "", None, None),
    ("http://net/", "net", "/", "net/", "block"), ("http://A.B.Net/q?x#y", "a.b.net", "/q", "net/", "block"),
    ("http://example.net/en/1", "example.net", "/en/1", "example.net/en/", "allow"), ("http://m.example.net/en", "m.example.net", "/en", "net/", "block"),
    ("http://badexample.com/de/", "badexample.com", "/de/", None, None), ("http://x.example.com/de/", "x.example.com", "/de/", "example.com/de/", "block"),
    ("ftp://w.org/fr/?a=://b", "w.org", "/fr/", "org/fr/", "allow"), ("no scheme.net/", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None),
    ("a://b://net/c", "b:", "//net/c", None, None), ("http://ÄB.org/fr/", "Äb.org", "/fr/", "org/fr/", "allow"),
]


def _pages(spark, rows):
    return spark.createDataFrame([(i, u, "h", "own") for i, u in enumerate(rows)], "page_id long, url string, html string, host string")


def test_rules(spark):
    pages = _pages(spark, [c[0] for c in CASES])
    empty = spark.createDataFrame([], "c string")
    found = {r.page_id: r for r in urls.judged(pages, empty).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(CASES):
        want = (host, path, "net/" if host.endswith(".net") and path.startswith("/") and rule is None else rule)
        assert (found[i].host, found[i].path, found[i].rule) == want
        if verdict:
            assert found[i].verdict == verdict
        elif want[2] is None:
            assert found[i].verdict == "allow" and not found[i].listed


def test_canonical(spark):
    same = ["http://www.site.de/a/?utm_source=x&b=2&a=1#f", "https://SITE.de:443/a?a=1&b=2", "https://site.de:80/a//?ref=q&a=1&b=2&"]
    rows = _pages(spark, same + ["https://site.de/A?a=1&b=2", "x"]).select(urls.canonical(F.col("url")).alias("c")).collect()
    assert [r.c for r in rows] == ["site.de/a?a=1&b=2"] * 3 + ["site.de/A?a=1&b=2", None]


def test_filter_has_no_false_negative_and_the_join_no_false_positive(spark, monkeypatch):
    pages = _pages(spark, [f"https://h{i % 50}.de/p/{i}" for i in range(4000)] * 2 + ["https://h1.de/p/1/"] * 500)
    listed = pages.filter("page_id % 4 = 1 and page_id < 2000").select(urls.canonical(F.col("url")))
    want = {f"h{i % 50}.de/p/{i}" for i in range(2000) if i % 4 == 1}
    for blocks in (urls.MAX_BLOCKS, 1):                       # with one block nearly every URL passes the filter
        monkeypatch.setattr(urls, "MAX_BLOCKS", blocks)
        found = urls.judged(pages, listed).collect()
        assert len(found) == 8500
        assert all((r.verdict == "block") == r.listed == (r.canonical in want) for r in found)


def test_bloom_is_sparse_enough(spark):
    table = spark.range(20_000).select(F.concat(F.lit("u"), F.col("id")).alias("canonical"))
    blocks = urls.bloom(table)
    other = spark.range(20_000, 40_000).select(F.concat(F.lit("u"), F.col("id")).alias("canonical")).select(*urls._hashes("canonical")).toPandas()
    assert np.mean(urls._may_hold(blocks, other.h1.to_numpy(), other.h2.to_numpy())) < 0.02


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert urls.judged(pages, spark.createDataFrame([(None,)], "c string")).count() == 0
