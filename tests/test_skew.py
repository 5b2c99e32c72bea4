"""A patient holding a third of all encounters: AQE splits the joins of the
whole registered plans, and histories and documents are cut by time."""

import contextlib

from pyspark.sql import functions as F

from ehrflow.operators import history as H
from ehrflow.plans.layout import plan_text


def skewed(spark, n=30000):
    enc = spark.range(0, n).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 5000 + 100).alias("documento_id"),
        F.col("id").cast("string").alias("atencion_id"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval((F.col("id") % 4001).cast("int"), F.lit(0), (F.col("id") % 9999).cast("int")))
        .alias("fecha_hora_atencion"),
        F.repeat(F.lit("x"), 50).alias("motivo_consulta"))
    pats = spark.range(0, 5200).select(F.col("id").alias("documento_id"), F.lit("p").alias("primer_nombre"))
    return pats, enc


@contextlib.contextmanager
def small_partitions(spark):
    """No broadcasts, and skew found from a few kB on."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1024",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4096",
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def split(df):
    df.collect()
    return "skew=true" in plan_text(df)                     # the executed, re-optimised plan


def hot_tables(spark, tmp_dir, monkeypatch):
    """The driver's tables with a third of the orders on one customer, behind
    the registered queries."""
    from ehrflow.plans import driver_model as M
    sf = "/root/testdata/sf0.01"
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    hot = orders.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(7).cast("long")).otherwise(F.col("o_custkey")))
    hot.repartition(6).write.parquet(f"{tmp_dir}/orders.parquet")
    monkeypatch.setattr(M, "read", lambda s, d, name: s.read.parquet(f"{tmp_dir if name == 'orders' else sf}/{name}.parquet"))


def test_flagship_and_documents_are_split(spark, tmp_dir, monkeypatch):
    from ehrflow.plans import catalog
    hot_tables(spark, tmp_dir, monkeypatch)
    with small_partitions(spark):
        rows = catalog.QUERIES["patient_history"](spark, tmp_dir)
        assert split(rows)
        assert rows.filter("documento_id = 7").select("n_atenciones").distinct().first()[0] > 4000
        assert split(catalog.QUERIES["history_documents"](spark, tmp_dir))
        assert split(catalog.QUERIES["patient_page"](spark, tmp_dir))


def test_deletes_and_conflicts_are_split(spark, tmp_dir):
    from ehrflow.operators import lookup
    from ehrflow.operators import writes as W
    with small_partitions(spark):
        pats, enc = skewed(spark)
        enc = enc.withColumn("note", F.sha2("atencion_id", 512))
        left = W.cascade_delete({"atencion": enc}, spark.createDataFrame([(8,), (9,)], "documento_id long"))
        assert split(left["atencion"])
        rows = enc.select(F.when(F.col("documento_id") != 7, F.col("documento_id").cast("string")).alias("mail"), "note")
        flagged = lookup.exists_flag(rows, pats.select(F.nullif(F.col("documento_id").cast("string"), F.lit("7")).alias("mail")), "mail", "f", null_safe=True)
        assert split(flagged)


def test_history_of_a_patient_with_10000_encounters(spark):
    """The same shape as everyone's, and in time order."""
    pats, enc = skewed(spark)
    h = H.patient_history(pats, enc.select("documento_id", "atencion_id", "fecha_hora_atencion"))
    want = sorted(((r.fecha_hora_atencion, r.atencion_id) for r in enc.filter("documento_id = 7").collect()), reverse=True)
    parts = sorted(h.filter("documento_id = 7").collect(), key=lambda r: r.mes, reverse=True)
    assert len(want) == 10000 and [(a.fecha_hora_atencion, a.atencion_id) for p in parts for a in p.atenciones] == want
    assert len(parts) == len({t.strftime("%Y-%m") for t, _ in want}) > 100
    assert all(a.fecha_hora_atencion.strftime("%Y-%m") == p.mes.strftime("%Y-%m") for p in parts for a in p.atenciones)
