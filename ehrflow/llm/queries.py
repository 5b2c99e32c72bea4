"""The registered queries of this package, and DuckDB SQL where it can
express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ehrflow.llm import codebooks, langid, mixing, packing, passages, pieces, quality, resampling, secrets, simhash, sketches, urls, warc
from ehrflow.llm._shared import shared_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> str:
    """The tokenizer file of the packing queries, where public_tokenizers has it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.judged(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: canonical URLs of the pages on hosts with the label
    ``spam-farm``."""
    pages = _table(spark, sf_dir, "pages")
    farm = F.regexp_like(urls.host(F.col("url")), F.lit(r"(^|\.)spam-farm(\.|$)"))
    return urls.judged(pages, pages.filter(farm).select(urls.canonical(F.col("url"))))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix(_table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.predicted(docs, langid.train(docs))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "length", F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.near_duplicate_passages(_table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer(), keep_ids=False)


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = sketches.edited_pairs(_table(spark, sf_dir, "documents"))
    return pairs.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), sketches.fingerprint("sketch").alias("fingerprint"),
                        sketches.fingerprint("edited_sketch").alias("edited_fingerprint"), sketches.likeness("sketch", "edited_sketch").alias("near_edited"),
                        sketches.likeness("sketch", "next_sketch").alias("near_next"), sketches.containment("edited_sketch", "sketch").alias("contained"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "warc")
    warc.write(_table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder, keep_payload=False).drop("url")


def piece_model() -> str:
    """The SentencePiece file of the encoding query, where public_tokenizers has it."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = pieces.load(piece_model())
    listed = lambda c: F.array_join(F.col(c).cast("array<string>"), " ")
    found = pieces.encoded(_table(spark, sf_dir, "documents"), model, decode=True)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed("ids"), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"), F.sha2(F.concat_ws(";", listed("starts"), listed("ends")), 256).alias("spans_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = codebooks.coded(_table(spark, sf_dir, "embeddings"))
    return codebooks.with_label_errors(found).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error",
                                                     F.lit(books.sha256()).alias("codebooks_sha256"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_url_filters": op2_url_filters,
    "op3_mixing": op3_mixing,
    "op4_language_id": op4_language_id,
    "op5_secret_scans": op5_secret_scans,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_document_fingerprints": op8_document_fingerprints,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_warc": op10_warc,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_vector_codes": op12_vector_codes,
    "op13_importance_resampling": op13_importance_resampling,
}


def _rules_sql(pick: int) -> str:
    """CASE over the rules, the longest first: their text (1) or kind (0)."""
    whens = []
    for rule in sorted(urls.RULES, key=lambda r: (-len(r[1]), r[1])):
        of, _, prefix = rule[1].partition("/")
        whens.append(f"WHEN (host = '{of}' OR ends_with(host, '.{of}')) AND starts_with(path, '/{prefix}') THEN '{rule[pick]}'")
    return "CASE " + " ".join(whens) + " END"


def _codes_sql() -> str:
    """The rounds of op12 by the full search, a step a table."""
    steps = ["""
kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT row, p, v[p * (len(v) // 4) + 1:(p + 1) * (len(v) // 4)] AS x FROM kept, range(4) AS r(p)),
book0 AS MATERIALIZED (SELECT p, row - 1 AS e, x AS c FROM parts WHERE row <= 256)"""]
    for k in range(codebooks.ROUNDS + 1):
        steps.append(f"""
near{k} AS MATERIALIZED (
  SELECT row, parts.p, any_value(x) AS x,
         min(CAST(list_inner_product(x, x) + list_inner_product(c, c) - 2 * list_inner_product(x, c) AS BIGINT) * 256 + e) AS best
  FROM parts JOIN book{k} ON parts.p = book{k}.p GROUP BY row, parts.p)""")
        if k < codebooks.ROUNDS:
            steps.append(f"""
mean{k} AS MATERIALIZED (
  SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY pos) AS c
  FROM (SELECT p, best % 256 AS e, pos, CAST(sum(x[pos]) AS BIGINT) AS s, count(*) AS n
        FROM near{k}, unnest(range(1, len(x) + 1)) AS u(pos) GROUP BY ALL) GROUP BY p, e),
book{k + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m ON b.p = m.p AND b.e = m.e)""")
    k = codebooks.ROUNDS
    return "WITH" + ",".join(steps) + f""",
coded AS MATERIALIZED (
  SELECT row, string_agg(lower(printf('%02x', best % 256)), '' ORDER BY p) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM near{k} GROUP BY row),
all_entries AS (SELECT sha256(string_agg(CAST(CAST(c[pos] AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, pos)) AS sha FROM book{k}, unnest(range(1, len(c) + 1)) AS u(pos))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256
FROM kept JOIN coded USING (row), all_entries"""


ORACLE: dict[str, str] = {
    "op12_vector_codes": _codes_sql(),
    "op13_importance_resampling": f"""
WITH crc AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) AS r(i))),
words AS MATERIALIZED (
  SELECT 'd' AS kind, doc_id, row, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM (SELECT *, row_number() OVER () AS row FROM documents)
  UNION ALL
  SELECT 'b', NULL, 0, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))
  FROM benchmark),
hashed AS MATERIALIZED (
  SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(h) // 2), lambda k: CAST('0x' || h[2 * k + 1:2 * k + 2] AS BIGINT))),
                            lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295) % {resampling.BUCKETS} AS bucket
  FROM (SELECT DISTINCT w, hex(encode(w)) AS h FROM words), crc),
counted AS (SELECT kind, bucket, count(*) AS n FROM words JOIN hashed USING (w) GROUP BY ALL),
gain AS MATERIALIZED (
  SELECT bucket, floor(1000 * ln((t + 1) * (big_t_s + {resampling.BUCKETS}) / ((s + 1) * (big_t + {resampling.BUCKETS})))) AS g
  FROM (SELECT CAST(r.bucket AS BIGINT) AS bucket, CAST(coalesce(d.n, 0) AS DOUBLE) AS s, CAST(coalesce(b.n, 0) AS DOUBLE) AS t
        FROM range({resampling.BUCKETS}) AS r(bucket) LEFT JOIN counted d ON d.bucket = r.bucket AND d.kind = 'd' LEFT JOIN counted b ON b.bucket = r.bucket AND b.kind = 'b'),
       (SELECT CAST(count(*) FILTER (WHERE kind = 'd') AS DOUBLE) AS big_t_s, CAST(count(*) FILTER (WHERE kind = 'b') AS DOUBLE) AS big_t FROM words)),
weights AS (SELECT row, count(*) AS n, CAST(sum(g) AS BIGINT) AS weight FROM words JOIN hashed USING (w) JOIN gain USING (bucket) WHERE kind = 'd' GROUP BY row),
scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('{resampling.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM (SELECT doc_id, row_number() OVER () AS row FROM documents) LEFT JOIN weights USING (row)),
enough AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS r, count(*) OVER () AS all_n FROM scored WHERE n_features >= {resampling.MIN_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN r <= {resampling.PERCENT} * all_n // 100 THEN r END AS rank FROM enough
UNION ALL
SELECT doc_id, n_features, weight, score, NULL FROM scored WHERE n_features < {resampling.MIN_WORDS}""",
    "op2_url_filters": f"""
WITH parts AS (
  SELECT page_id, url,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
         list_sort(list_filter(string_split(regexp_extract(url, '://[^?#]*\\?([^#]*)', 1), '&'),
                               lambda x: x <> '' AND NOT regexp_matches(x, '{urls.TRACKING}'))) AS kept
  FROM pages),
named AS (
  SELECT *, CASE WHEN contains(url, '://') THEN
           regexp_replace(regexp_replace(host, '^www\\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '')
           || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canonical
  FROM parts),
listed AS (SELECT DISTINCT canonical AS c FROM named WHERE regexp_matches(host, '(^|\\.)spam-farm(\\.|$)') AND canonical IS NOT NULL)
SELECT page_id, host, path, {_rules_sql(1)} AS rule,
       coalesce({_rules_sql(0)}, CASE WHEN c IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
       canonical, c IS NOT NULL AS listed
FROM named LEFT JOIN listed ON canonical = c""",
    "op10_warc": """
WITH rows AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
best AS (SELECT h, max(page_id) AS b FROM rows WHERE strlen(h) >= 1000 GROUP BY h)
SELECT page_id, strlen(rows.h) AS payload_bytes, sha1(rows.h) AS payload_digest,
       CASE WHEN b IS NULL OR b = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN b <> page_id THEN b END AS refers_to
FROM rows LEFT JOIN best ON rows.h = best.h""",
}
