import os
import re
import uuid
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ehrflow.functions import scalars as S
from ehrflow.operators import history as H
from ehrflow.operators.lookup import patients_by_email
from ehrflow.plans import catalog, clustering
from ehrflow.plans import layout as L

N = 60_000


def suffix():
    return "_" + uuid.uuid4().hex[:8]


@pytest.fixture(scope="module")
def people(spark):
    i = F.col("id")
    mail = F.concat(F.lit("p"), F.pmod(i * 7919, F.lit(N)).cast("string"), F.lit("@hce.test"))
    mobile = F.concat(F.lit("3"), F.lpad(F.pmod(i * 104729, F.lit(N)).cast("string"), 9, "0"))
    return spark.range(N).select(i.alias("documento_id"), F.when(i % 10 > 0, mail).alias("correo_electronico"), F.when(i % 7 > 0, mobile).otherwise("").alias("celular"))


@pytest.fixture(scope="module")
def saved(spark, people, tmp_path_factory):
    layout = L.save_layout({"usuario": people}, 2, location=str(tmp_path_factory.mktemp("layout")), suffix=suffix(), fanout=1, row_group_bytes=16 << 10, bloom_bytes=4 << 10)
    yield layout
    layout.drop(spark)


def test_every_access_path_reads_a_fraction(spark, people, saved):
    """One sort column would serve one of the three lookups only."""
    t = saved.whole(spark, "usuario")
    assert L.scanned_rows(t) == N
    row = people.filter("documento_id = 12345").first()
    for column in ("correo_electronico", "celular", "documento_id"):
        found = L.lookup(t, column, [row[column]])
        assert L.scanned_rows(found) < N / 6, column
        assert [r.documento_id for r in found.collect()] == [12345]
    first = patients_by_email(L.lookup(t, "correo_electronico", [row.correo_electronico]), spark.createDataFrame([(row.correo_electronico,)], "correo_electronico string"))
    assert L.scanned_rows(first.select("documento_id")) < N / 8


def test_a_key_that_is_not_there_reads_nothing(spark, saved):
    t = saved.whole(spark, "usuario")
    for column, value in (("correo_electronico", "p12345x@hce.test"), ("celular", "3000012345x")):
        assert L.scanned_rows(L.lookup(t, column, [value])) == 0, column
    assert L.scanned_rows(L.lookup(t, "correo_electronico", [f"p{k}y@hce.test" for k in range(30)])) < N
    spark.conf.set("spark.hadoop.parquet.filter.bloom.enabled", "false")
    try:                                                                     # what the Bloom filters spare, beside the statistics
        plain = spark.read.option("parquet.filter.bloom.enabled", "false").parquet(saved.paths[0])
        assert L.scanned_rows(plain.filter("celular = '3000012345x'")) > 0
    finally:
        spark.conf.unset("spark.hadoop.parquet.filter.bloom.enabled")


def test_z_order_of_ranks(spark):
    rows = [(a, b) for a in range(16) for b in range(16)]
    df = spark.createDataFrame(rows, "a long, b long")
    got = df.select("a", "b", clustering.z_value(df, ["a", "b"], bins=16, rows=1).alias("z")).collect()
    want = lambda a, b: sum(((a >> k) & 1) << (2 * k + 1) | ((b >> k) & 1) << (2 * k) for k in range(4))
    assert all(r.z == want(r.a, r.b) for r in got)
    odd = spark.createDataFrame([(None, "x"), (1, None), (None, None), (1, "x")], "a int, b string")
    assert [r.z for r in odd.select(clustering.z_value(odd, ["a", "b"]).alias("z")).collect()]
    none = odd.limit(0)
    assert none.select(clustering.z_value(none, ["a", "b"]).alias("z")).count() == 0


def _hot(spark, n=4000):
    """A third of the encounters are one patient's."""
    return spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id") % 97).alias("documento_id"), F.col("id").cast("string").alias("atencion_id"))


def test_heavy_patients_lie_apart(spark, tmp_dir):
    enc, pats = _hot(spark), spark.range(97).select(F.col("id").alias("documento_id"))
    layout = L.save_layout({"usuario": pats, "atencion": enc}, 8, location=tmp_dir, suffix=suffix(), fanout=2)
    assert [r.documento_id for r in spark.table(layout.heavy["atencion"]).select("documento_id").distinct().collect()] == [5]
    assert spark.table(layout.names["atencion"]).filter("documento_id = 5").count() == 0
    files = lambda p: [f for f in os.listdir(p) if f.endswith(".parquet")]
    assert len(files(os.path.join(tmp_dir, "atencion_pesados"))) > 4         # the heavy patient is dealt to many files
    per_task = defaultdict(set)
    for f in files(os.path.join(tmp_dir, "atencion")):
        task, bucket = re.match(r"part-(\d+)-.*_(\d{5})\.", f).groups()
        per_task[task].add(bucket)
    assert all(len(b) == 1 for b in per_task.values()) and len(files(os.path.join(tmp_dir, "atencion"))) <= 8 * 2
    counts = lambda t: H.encounter_counts(t["usuario"].select("documento_id"), t["atencion"].select("documento_id"))
    got = Counter({r.documento_id: r.n_atenciones for r in layout.per_patient(spark, counts).collect()})
    assert got == Counter({r.documento_id: r.n_atenciones for r in counts({"usuario": pats, "atencion": enc}).collect()})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert L.exchange_count(counts(layout.tables(spark))) == 0           # the others still join without a shuffle
        assert L.exchange_count(counts(layout.heavy_tables(spark))) > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert layout.whole(spark, "atencion").count() == 4000 and L.ORDER not in layout.whole(spark, "atencion").columns
    layout.drop(spark)
    assert not os.path.exists(os.path.join(tmp_dir, "atencion"))


def test_no_heavy_patient_no_side_table(spark, tmp_dir):
    enc = spark.range(500).select((F.col("id") % 100).alias("documento_id"), F.col("id").cast("string").alias("atencion_id"))
    layout = L.save_layout({"atencion": enc, "profesional_salud": spark.range(3).select(F.col("id").cast("string").alias("id_personal_salud"))},
                           4, location=tmp_dir, suffix=suffix())
    assert not layout.heavy and {k: v.count() for k, v in layout.tables(spark).items()} == {"atencion": 500, "profesional_salud": 3}
    layout.drop(spark)


VITALS = ['{"ta":"120/80","fc":78,"temp":36.5}', '{"fc":"78"}', '{"fc":0,"ta":""}', "no es json", "", None, '{"fc":1,"fc":2}', "null", "[1]", '{"otro":{"a":[1,2]}}', '"{\\"fc\\":5}"']


def test_vitals_are_shredded_and_read_by_themselves(spark, tmp_dir):
    import glob

    import pyarrow.parquet as pq
    rows = [(i, str(i), VITALS[i % 50] if i % 50 < len(VITALS) else VITALS[0]) for i in range(3000)]
    enc = spark.createDataFrame(rows, "documento_id long, atencion_id string, signos_vitales string")
    layout = L.save_layout({"atencion": enc}, 2, location=tmp_dir, suffix=suffix(), fanout=1)
    t = layout.whole(spark, "atencion")
    assert dict(t.dtypes)["signos_vitales"] == "variant"
    schema = str(pq.ParquetFile(glob.glob(os.path.join(tmp_dir, "atencion", "*.parquet"))[0]).schema)
    assert "typed_value" in schema
    read = lambda v: [S.vital(v, "fc", "bigint").alias("fc"), S.vital(v, "ta").alias("ta"), v.isNotNull().alias("some")]
    at_rest = t.select("atencion_id", *read(F.col("signos_vitales")))
    parsed = enc.withColumn("signos_vitales", S.parse_vitals("signos_vitales")).select("atencion_id", *read(F.col("signos_vitales")))
    assert sorted(map(tuple, at_rest.collect())) == sorted(map(tuple, parsed.collect()))
    plan = L.plan_text(t.select(S.vital("signos_vitales", "fc", "bigint").alias("fc")))
    assert "ReadSchema: struct<signos_vitales:struct<0:bigint>>" in plan       # one typed column, no JSON is parsed
    layout.drop(spark)


def test_queries_on_the_layout(spark):
    from tests.oracle_check import canon, duck
    sf = "/root/testdata/sf0.001"
    con = duck(sf)
    for name in ("layout_lookups", "layout_email_first", "vitals_at_rest"):
        df = catalog.QUERIES[name](spark, sf)
        want = con.execute(catalog.ORACLE[name])
        assert canon(df.columns, [tuple(r) for r in df.collect()])[1:] == canon([c[0] for c in want.description], want.fetchall())[1:], name
