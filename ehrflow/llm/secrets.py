"""Secret scans: candidates by pattern, false positives removed by a random
forest. DataFrame and SQL functions (and Spark's own MLlib) only.

A candidate is what stands after a name of a secret and a separator, up to its
quote or white space, or as the password of an address, whatever its length
and characters; elsewhere, a whole run of at least ``MIN_LENGTH`` letters,
digits and ``_+/-`` with a digit in it, or a key id that happens to have none. Its
features: length, shares of the kinds of characters, changes between kinds,
distinct characters, the part of it that is words of the corpus (letter runs
found outside of candidates in at least ``MIN_SHARE`` of the distinct texts, so
neither copies nor the size of the corpus change a verdict), signs of a path,
and the words next to it. The forest is trained on labelled findings
and decides on every candidate.

The training sample is bounded: at most ``sample`` labelled findings of each
class, those with the smallest hash of their value. The corpus's words are
counted over all documents.

Defined results: a null or empty text has no candidates; of rows with equal
doc_id and text each has its own findings; a null doc_id stays null; if the
labelled findings do not hold both classes, the rules that label findings
decide; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ehrflow.llm._shared import written

MIN_LENGTH = 16
MIN_SHARE = 1e-4                    # of the distinct texts: a word of the corpus
SAMPLE = 5000
THRESHOLD = 0.5
BEFORE, AFTER = 40, 24              # code points of context that are kept
NEIGHBOURS = 16                     # buckets of the word before, and of the word after
MASK = "[SECRET]"
_CUT = "\x00\x01"                   # put around candidates to find and cut them in one pass

_RUN = r"(?<![A-Za-z0-9_+/\-])(?=[A-Za-z_+/\-]*+[0-9]|A[KS]IA[A-Z]{16}(?![A-Za-z0-9_+/\-]))[A-Za-z0-9_+/\-]{%d,}+"
_NAMED = r"(?i)(token|passw(or)?d|pwd|secret|credential|bearer|api[_\-]?key|access[_\-]?key)[\"']?\s*[=:]?>?\s*[\"']?$"
# the value after a name and a separator (less punctuation at its end, unless quoted), and the password of scheme://user:password@
_AFTER_NAME = r"(?<=[=:\s\"'])(?<=(?i:token|passw(?:or)?d|pwd|secret|credential|bearer|api[_\-]?key|access[_\-]?key)[\"']?\s{0,8}[=:]>?\s{0,8}[\"']?)(?:(?<=[\"'])[^\s\"']++(?=[\"'])|[^\s\"'<>=:][^\s\"'<>]*(?<![,;.)\]}]))"
_IN_ADDRESS = r"(?<=:)(?<=://[^\s/:@\"']{0,64}:)[^\s/@\"']++(?=@)"
_USER = r"://[^\s/:@\"']*:$"
_KEY_ID = r"^(AKIA|ASIA)[A-Z0-9]{16}$"
_PATH = r"(://\S*|[/\\.@]\S*)$"

SHAPE = ["length", "digits", "upper", "lower", "signs", "changes", "distinct", "hexadecimal", "covered", "slashes", "after_path", "before_dot", "assigned", "quoted"]


_NAMES = ("token", "passw", "pwd", "secret", "credential", "bearer", "api", "access")


def _pattern(min_length: int, named: bool = True) -> str:
    return "|".join((_IN_ADDRESS, *((_AFTER_NAME,) if named else ()), _RUN % min_length))


def _parts(text: Column, min_length: int) -> Column:
    """The text cut at its candidates: what is before, the first, what is
    between, the second, and so on. One pass of the pattern marks and cuts;
    a text without any of the names need not be searched for named values. A
    text that holds the mark itself is searched twice instead."""
    marked = lambda named: F.split(F.regexp_replace(text, F.lit(f"(?:{_pattern(min_length, named)})"), F.lit(f"{_CUT}$0{_CUT}")), _CUT, -1)
    low, any_name = F.lower(text), F.lit(False)
    for name in _NAMES:
        any_name = any_name | F.contains(low, F.lit(name))
    values, between = F.regexp_extract_all(text, F.lit(_pattern(min_length)), F.lit(0)), F.split(text, _pattern(min_length), -1)
    twice = F.flatten(F.transform(between, lambda x, i: F.when(i < F.size(values), F.array(x, F.get(values, i))).otherwise(F.array(x))))
    return F.when(F.contains(text, F.lit(_CUT)), twice).when(any_name, marked(True)).otherwise(marked(False))


def _odd(parts: Column, odd: int) -> Column:
    return F.filter(parts, lambda _, i: i % 2 == odd)


def candidates(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """row (a number of the document's row), doc_id, text_hash (64 bits of its
    text), k (the candidate's number in it), start and length (code points),
    value, before and after of every candidate."""
    part = lambda i: F.get("parts", i)
    one = lambda k: F.struct(k.alias("k"), part(2 * k + 1).alias("value"), F.char_length(part(2 * k)).cast("long").alias("gap"),
                             F.right(part(2 * k), F.lit(BEFORE)).alias("before"), F.left(part(2 * k + 2), F.lit(AFTER)).alias("after"))
    each = F.transform(F.sequence(F.lit(0), F.floor(F.size("parts") / 2).cast("int") - 1), one)
    found = (docs.select("doc_id", "text", _parts(F.col("text"), min_length).alias("parts")).filter(F.size("parts") > 1)
             .select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"), "parts"))
    around = written(found.select("row", "doc_id", "text_hash", F.explode(each).alias("x")).select("row", "doc_id", "text_hash", "x.*"), "candidates")
    length = F.char_length("value").cast("long")
    upto = F.sum(F.col("gap") + length).over(Window.partitionBy("row").orderBy("k"))
    return around.select("row", "doc_id", "text_hash", "k", (upto - length).alias("start"), length.alias("length"), "value", "before", "after")


def corpus_words(docs: DataFrame, min_share: float = MIN_SHARE, min_length: int = MIN_LENGTH) -> DataFrame:
    """Letter runs of four or more that stand outside of candidates in at
    least ``min_share`` of the distinct texts. Equal texts become one before
    their words are counted, in part before the shuffle."""
    prose = F.array_join(_odd(_parts(F.col("text"), min_length), 0), " ")
    runs = F.array_distinct(F.regexp_extract_all(F.lower(prose), F.lit("[a-z]{4,}+"), F.lit(0)))
    texts = docs.filter("text is not null").select(F.xxhash64("text").alias("text_hash"), runs.alias("words"))
    once = texts.groupBy("text_hash").agg(F.any_value("words").alias("words"))
    counted = written(once.select(F.explode(F.concat("words", F.array(F.lit("")))).alias("word")).groupBy("word").agg(F.count("*").alias("n")), "words")
    least = max(1.0, min_share * (counted.filter("word = ''").agg(F.sum("n")).first()[0] or 0))      # the empty word stands for the text
    return counted.filter((F.col("n") >= least) & (F.col("word") != "")).select("word")


def _share(pattern: str) -> Column:
    return F.regexp_count("value", F.lit(pattern)) / F.col("length")


def features(found: DataFrame, words: DataFrame) -> DataFrame:
    """The columns of ``found`` and those of ``SHAPE``, beside the neighbours'
    hashed words. Equal values are looked up in the corpus's words once; the
    result is written, so that AQE can split a value that very many have."""
    parts = found.select("value").distinct().select("value", F.explode(F.regexp_extract_all(F.lower("value"), F.lit("[a-z]{4,}+"), F.lit(0))).alias("word"))
    covered = written(parts.join(words, "word").groupBy(F.col("value").alias("__value")).agg(F.sum(F.char_length("word")).alias("in_words")), "covered")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("value", "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0"), "[^A-Za-z0-9]", ".")
    beside = {"word_before": F.lower(F.regexp_extract("before", r"([A-Za-z]+)[^A-Za-z]*$", 1)), "word_after": F.lower(F.regexp_extract("after", r"^[^A-Za-z]*([A-Za-z]+)", 1))}
    return (found.join(covered, F.col("value") == F.col("__value"), "left")
            .select(*found.columns, _share("[0-9]").alias("digits"), _share("[A-Z]").alias("upper"), _share("[a-z]").alias("lower"), _share("[^A-Za-z0-9]").alias("signs"),
                    ((F.regexp_count(kinds, F.lit(r"(.)\1*+")) - 1) / F.col("length")).alias("changes"),
                    (F.size(F.array_distinct(F.split("value", ""))) / F.col("length")).alias("distinct"),
                    F.regexp_like("value", F.lit("^([0-9a-f]+|[0-9A-F]+)$")).cast("double").alias("hexadecimal"),
                    (F.coalesce("in_words", F.lit(0)) / F.col("length")).alias("covered"),
                    F.regexp_count("value", F.lit("/")).cast("double").alias("slashes"),
                    F.regexp_like("before", F.lit(_PATH)).cast("double").alias("after_path"),
                    F.regexp_like("after", F.lit(r"^[.@]\w")).cast("double").alias("before_dot"),
                    F.regexp_like("before", F.lit(r"[=:]\s*[\"']?$")).cast("double").alias("assigned"),
                    F.regexp_like("before", F.lit(r"[\"']$")).cast("double").alias("quoted"),
                    *(F.pmod(F.xxhash64(w), F.lit(NEIGHBOURS)).alias(name) for name, w in beside.items())))


def rule_labels(found: DataFrame) -> DataFrame:
    """``found`` with label: 1 for key ids, passwords of addresses, and values
    that are named as secret (unless they are letters that the corpus's words
    cover, as in prose), 0 for plain numbers, parts of paths and addresses, and values made of the
    corpus's words; null for the others, which train nothing."""
    secret = F.regexp_like("value", F.lit(_KEY_ID)) | (F.regexp_like("before", F.lit(_USER)) & F.startswith("after", F.lit("@"))) | (F.regexp_like("before", F.lit(_NAMED)) & ((F.col("digits") > 0) | (F.col("covered") < 0.5)))
    harmless = F.regexp_like("value", F.lit(r"^[0-9]+([\-_/+][0-9]+)*$")) | (F.col("after_path") > 0) | (F.col("before_dot") > 0) | (F.col("covered") >= 0.5)
    return found.withColumn("label", F.when(secret, 1.0).when(harmless, 0.0))


def _inputs(found: DataFrame) -> DataFrame:
    near = {f"{name}_{k}": (F.col(name) == k).cast("double") for name in ("word_before", "word_after") for k in range(NEIGHBOURS)}
    return VectorAssembler(inputCols=[*SHAPE, *near], outputCol="inputs").transform(found.withColumns(near)).drop(*near)


def train(labelled: DataFrame, sample: int = SAMPLE):
    """A forest fitted on at most ``sample`` findings of each class, in one
    task, so that reruns agree; None without both classes."""
    parts = [labelled.filter(F.col("label") == y).orderBy(F.xxhash64("value", "before", "after"), "value", "before", "after").limit(sample) for y in (0.0, 1.0)]
    rows = written(_inputs(parts[0].unionAll(parts[1])).select("inputs", "label", "value").repartition(1).sortWithinPartitions("label", "value"), "labelled").coalesce(1)
    if rows.select("label").distinct().count() < 2:
        return None
    return RandomForestClassifier(featuresCol="inputs", labelCol="label", numTrees=20, maxDepth=6, seed=7).fit(rows)


def scan(docs: DataFrame, labelled=rule_labels, min_length: int = MIN_LENGTH, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """Every candidate with probability and is_secret. ``labelled`` takes the
    candidates with their features and adds label (1, 0 or null)."""
    found = written(features(candidates(docs, min_length), corpus_words(docs, min_length=min_length)), "features")
    model = train(labelled(found).filter("label is not null"), sample)
    if model is None:
        probability = F.coalesce(F.col("label"), F.lit(0.0))
        scored = rule_labels(found)
    else:
        probability = F.element_at(vector_to_array("probability"), 2)
        scored = model.transform(_inputs(found))
    return (scored.select("row", "doc_id", "text_hash", "k", "start", "length", "value", probability.alias("score"))
            .withColumn("is_secret", F.col("score") >= threshold))


def masked(docs: DataFrame, mask: str = MASK, **options) -> DataFrame:
    """``docs`` with every found secret replaced by ``mask`` in its text, and
    n_chars (if there is such a column) counted anew; other rows and columns
    as they are. Rows with a candidate are joined to their findings by doc_id
    and a hash of the text; the others stay where they are. A value of at least
    ``min_length`` is replaced everywhere in its text, a shorter one only where
    it was found."""
    min_length = options.get("min_length", MIN_LENGTH)
    found = scan(docs, **options)
    has = F.coalesce(F.size("__parts") > 1, F.lit(False))
    cut = docs.withColumn("__parts", _parts(F.col("text"), min_length))
    decided = F.array_sort(F.collect_set(F.struct("k", "is_secret")))["is_secret"]           # by k, copies of a row once
    again = F.collect_set(F.when(F.col("is_secret") & (F.col("length") >= min_length), F.col("value")))
    values = written(found.groupBy(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash")).agg(decided.alias("__secret"), again.alias("__values"))
                     .filter(F.array_contains("__secret", True)), "secrets")
    placed = F.array_join(F.transform("__parts", lambda p, i: F.when((i % 2 == 1) & F.get("__secret", F.floor(i / 2).cast("int")), F.lit(mask)).otherwise(p)), "")
    longest = F.array_sort("__values", lambda a, b: F.char_length(b) - F.char_length(a))
    text = F.aggregate(longest, F.col("__placed"), lambda t, v: F.replace(t, v, F.lit(mask)))
    joined = (cut.filter(has).join(values, docs["doc_id"].eqNullSafe(F.col("__doc")) & (F.xxhash64(docs["text"]) == F.col("__hash")), "left")
              .withColumn("__placed", placed))
    new = {"text": F.when(F.col("__values").isNull(), F.col("text")).otherwise(text)}
    changed = joined.withColumns(new)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.col("__values").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return cut.filter(~has).select(*docs.columns).unionAll(changed.select(*docs.columns))
