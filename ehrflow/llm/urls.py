"""URL filters: rules on hosts and paths, and a list of canonical URLs.

A rule (block or allow, host and path prefix) fits its host and all its
subdomains; the longest that fits decides. Other URLs are looked up in a list
of canonical URLs: a blocked Bloom filter lets possible hits pass, and an exact
hash join with the list removes the false positives.

The filter has 512-bit blocks, 8 bits a URL, about 16 bits for each listed URL
and at most ``MAX_BLOCKS`` blocks (8 MB), so what is sent to the tasks is
bounded. Beyond that more URLs pass to the exact join; the verdicts are the
same. Blocks are made by grouped bit_or on the executors.

Defined results: a null url or one without ``://`` has empty host and path and
no canonical URL, so no rule fits and it is not listed; an empty list blocks
nothing; repeated rows are judged each. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ehrflow.llm._shared import written

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
TRACKING = "^(utm_[^=]*|ref|fbclid|gclid)(=|$)"
MAX_BLOCKS = 1 << 17
BITS_PER_URL = 16
_PROBES = 8


def host(url: Column) -> Column:
    name = F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit(""))
    return F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.`` and default port, path without closing slashes,
    and the parameters, sorted, that do not track; null without ``://``."""
    name = F.regexp_replace(F.regexp_replace(host(url), r"^www\.", ""), ":(80|443)$", "")
    query = F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~F.regexp_like(x, F.lit(TRACKING))))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(F.contains(url, F.lit("://")), F.concat(name, F.regexp_replace(path(url), "/+$", ""), tail))


def rule(name: Column, at: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null if none does."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        of, _, prefix = text.partition("/")
        fits = ((name == of) | name.endswith(f".{of}")) & at.startswith(f"/{prefix}")
        found, verdict = F.when(fits, F.lit(text)).otherwise(found), F.when(fits, F.lit(kind)).otherwise(verdict)
    return found, verdict


def _hashes(url: str) -> list[Column]:
    return [F.xxhash64(url).alias("h1"), F.xxhash64(url, F.lit(1)).alias("h2")]


def bloom(listed: DataFrame) -> np.ndarray:
    """The blocks (rows of eight 64-bit words) of the distinct ``canonical``
    URLs listed."""
    n = max(1, min(MAX_BLOCKS, -(-listed.count() * BITS_PER_URL // 512)))
    probe = F.explode(F.sequence(F.lit(0), F.lit(_PROBES - 1)))
    bit = F.expr("shiftrightunsigned(h2, probe * 7) & 511L")
    words = (listed.select(*_hashes("canonical")).select("h1", "h2", probe.alias("probe"))
             .select(F.pmod("h1", F.lit(n)).alias("block"), bit.alias("bit"))
             .groupBy("block", F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")))
    table = words.toArrow()                                   # at most 8 * MAX_BLOCKS rows
    blocks = np.zeros((n, 8), np.uint64)
    column = [table.column(c).to_numpy() for c in ("block", "word", "bits")]
    blocks[column[0], column[1]] = column[2].view(np.uint64)
    return blocks


def _may_hold(blocks: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    block, hit = blocks[np.mod(h1, len(blocks))], np.ones(len(h1), bool)
    for k in range(_PROBES):
        bit = (h2.view(np.uint64) >> np.uint64(7 * k)) & np.uint64(511)
        hit &= (block[np.arange(len(h1)), (bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
    return hit


def judged(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, canonical and listed of every page;
    ``listed`` has one column of canonical URLs, null ones apart."""
    known = written(listed.toDF("canonical").filter("canonical is not null").distinct(), "listed")
    blocks = bloom(known)
    url = F.col("url")
    parts = pages.select("page_id", host(url).alias("host"), path(url).alias("path"), canonical(url).alias("canonical"))
    found, verdict = rule(F.col("host"), F.col("path"), rules)
    split = parts.select("page_id", "host", "path", found.alias("rule"), verdict.alias("verdict"), "canonical", *_hashes("canonical"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                column = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2")]
                hit = _may_hold(blocks, *column) & batch.column("canonical").is_valid().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(hit)], names=[*batch.schema.names[:6], "possible"])

    probed = written(split.mapInArrow(probe, "page_id long, host string, path string, rule string, verdict string, canonical string, possible boolean"), "probed")
    exact = (probed.filter("possible").join(known.withColumnRenamed("canonical", "__listed"), F.col("canonical") == F.col("__listed"), "left")
             .withColumn("listed", F.col("__listed").isNotNull()).drop("__listed"))
    every = probed.filter("not possible").withColumn("listed", F.lit(False)).unionByName(exact)
    return every.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "canonical", "listed")
