import datetime as dt
import os
import uuid

from pyspark.sql import functions as F

from ehrflow.operators import history as H
from ehrflow.operators.writes import insert_encounters
from ehrflow.plans import layout as L
from ehrflow.sources.commands import read_commands, tagged
from ehrflow.streaming.encounters import encounter_results, encounter_stream

USERS = "documento_id long, primer_nombre string, primer_apellido string, tipo_usuario string"


def test_bucketed_join_has_no_exchange(spark, tmp_dir):
    pats = spark.range(0, 200).select(F.col("id").alias("documento_id"), F.lit("x").alias("correo_electronico"))
    enc = spark.range(0, 1000).select((F.col("id") % 200).alias("documento_id"),
                                      F.col("id").cast("string").alias("atencion_id"))
    t = L.save_layout({"usuario": pats, "atencion": enc}, 4, location=tmp_dir, suffix="_" + uuid.uuid4().hex[:8]).tables(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = H.encounter_counts(t["usuario"].select("documento_id"), t["atencion"].select("documento_id"))
        assert L.exchange_count(j) == 0
        plain = H.encounter_counts(pats.select("documento_id"), enc.select("documento_id"))
        assert L.exchange_count(plain) > 0
        assert j.agg(F.sum("n_atenciones")).first()[0] == 1000
        one = t["atencion"].filter(F.col("documento_id") == 7).groupBy("documento_id").count()
        assert "SelectedBucketsCount: 1 out of 4" in L.plan_text(one)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_stream_equals_batch(spark, tmp_dir):
    from ehrflow.sources.commands import NEW_ENCOUNTER
    pats = spark.createDataFrame([(1, "Ana", "Ruiz", "medico")], USERS)
    rows = [{"documento_id": d, "tipo_atencion": "C", "motivo_consulta": "m", "enfermedad_actual": "e",
             "impresion_diagnostica": "i", "conducta_plan_manejo": "c", "clinician_id": 1, "seq": s}
            for s, d in enumerate([1, 2, 1])]
    batch = spark.createDataFrame(rows, NEW_ENCOUNTER)
    in_dir = os.path.join(tmp_dir, "in")
    batch.write.json(in_dir)
    as_of = dt.datetime(2024, 1, 1, 12)
    q = encounter_stream(spark, in_dir, lambda: (pats, pats), os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck"), as_of)
    q.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(os.path.join(tmp_dir, "out"))
                 .select("seq", "estado", "atencion_id").collect())
    lines = tagged(spark.read.text(in_dir).withColumnRenamed("value", "linea"), "encounter")
    want = sorted(tuple(r) for r in encounter_results(lines, pats, pats, as_of).select("seq", "estado", "atencion_id").collect())
    assert got == want and [g[1] for g in got] == ["aceptado", "rechazado", "aceptado"]


ODD_LINES = ['{"documento_id":1,"tipo_atencion":5,"motivo_consulta":{"a":1},"enfermedad_actual":"e","impresion_diagnostica":"i","conducta_plan_manejo":"c","clinician_id":1,"seq":1}',
             '{"documento_id":"1","tipo_atencion":"C","motivo_consulta":"m","enfermedad_actual":"e","impresion_diagnostica":"i","conducta_plan_manejo":"c","clinician_id":"1","seq":2}',
             "no es json", "", "[1]", "null", '{"documento_id":1,"tipo_atencion":"C"', '{"documento_id":1,"clinician_id":1,"seq":3}',
             '{"documento_id":1,"tipo_atencion":"%s","motivo_consulta":"m","enfermedad_actual":"e","impresion_diagnostica":"i","conducta_plan_manejo":"c","clinician_id":1,"seq":4}' % ("x" * 81),
             '{"documento_id":1,"tipo_atencion":7,"tipo_atencion":"C","motivo_consulta":"m","enfermedad_actual":"e","impresion_diagnostica":"i","conducta_plan_manejo":"c","codigos_cie10":["a",null],"clinician_id":1,"seq":5}',
             '{"documento_id":1,"tipo_atencion":"C","motivo_consulta":"m","enfermedad_actual":"e","impresion_diagnostica":"i","conducta_plan_manejo":"c","clinician_id":1}',
             '{"documento_id":2,"tipo_atencion":"C","motivo_consulta":"m","enfermedad_actual":"e","impresion_diagnostica":"i","conducta_plan_manejo":"c","clinician_id":1,"seq":6}',
             '{"documento_id":1,"tipo_atencion":"C","motivo_consulta":"m","enfermedad_actual":"e","impresion_diagnostica":"i","conducta_plan_manejo":"c","clinician_id":9,"seq":7}']


def test_stream_and_commands_follow_the_same_rules(spark, tmp_dir):
    """The same file read as a table and as a stream."""
    in_dir, out = os.path.join(tmp_dir, "in"), os.path.join(tmp_dir, "out")
    spark.createDataFrame([(x,) for x in ODD_LINES], "value string").coalesce(1).write.text(in_dir)
    pats = spark.createDataFrame([(1, "Ana", "Ruiz", "medico")], USERS)
    as_of = dt.datetime(2024, 1, 1)
    encounter_stream(spark, in_dir, lambda: (pats, pats), out, os.path.join(tmp_dir, "ck"), as_of).awaitTermination()
    got = spark.read.parquet(out).collect()
    accepted, refused = read_commands(spark, in_dir, "encounter")
    stored, rejected = insert_encounters(pats, accepted, pats, as_of)
    assert sorted(r.seq for r in got if r.estado == "aceptado") == sorted(r.seq for r in stored.collect()) == [2, 5]
    lines = {r.linea for r in refused.collect()}
    assert lines <= {r.linea for r in got} and all((r.linea is None) == (r.estado == "aceptado") for r in got) and len(got) == len(ODD_LINES)
    why = {r.linea: r.motivo for r in got if r.linea is not None}
    assert [why.get(x) for x in ODD_LINES] == ["tipo_invalido", None, "json", "json", "json", "json", "json", "campo_requerido", "longitud", None, "campo_requerido",
                                               "paciente_no_existe", "no_autenticado"]
    assert {(r.seq, r.motivo) for r in rejected.collect()} == {(r.seq, r.motivo) for r in got if r.seq in (6, 7)}


def test_stream_dedup_opt_in(spark, tmp_dir):
    from ehrflow.sources.commands import NEW_ENCOUNTER
    pats = spark.createDataFrame([(1, "Ana", "Ruiz", "medico")], USERS)
    row = {"documento_id": 1, "tipo_atencion": "C", "motivo_consulta": "m", "enfermedad_actual": "e",
           "impresion_diagnostica": "i", "conducta_plan_manejo": "c", "clinician_id": 1}
    batch = spark.createDataFrame([dict(row, seq=1), dict(row, seq=2), dict(row, seq=3, motivo_consulta="otro")],
                                  NEW_ENCOUNTER)
    batch.write.json(os.path.join(tmp_dir, "in"))
    q = encounter_stream(spark, os.path.join(tmp_dir, "in"), lambda: (pats, pats), os.path.join(tmp_dir, "out"),
                         os.path.join(tmp_dir, "ck"), dt.datetime(2024, 1, 1), dedup_within="1 hour")
    q.awaitTermination()
    assert spark.read.parquet(os.path.join(tmp_dir, "out")).count() == 2


def test_stream_restart_resumes_from_checkpoint(spark, tmp_dir):
    from ehrflow.sources.commands import NEW_ENCOUNTER
    pats = spark.createDataFrame([(1, "Ana", "Ruiz", "medico")], USERS)
    row = {"documento_id": 1, "tipo_atencion": "C", "motivo_consulta": "m", "enfermedad_actual": "e",
           "impresion_diagnostica": "i", "conducta_plan_manejo": "c", "clinician_id": 1}
    in_dir, out, ck = (os.path.join(tmp_dir, x) for x in ("in", "out", "ck"))
    spark.createDataFrame([dict(row, seq=1), dict(row, seq=2)], NEW_ENCOUNTER).coalesce(1).write.json(os.path.join(in_dir, "a"))
    as_of = dt.datetime(2024, 1, 1)
    encounter_stream(spark, os.path.join(in_dir, "*"), lambda: (pats, pats), out, ck, as_of).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    spark.createDataFrame([dict(row, seq=3)], NEW_ENCOUNTER).coalesce(1).write.json(os.path.join(in_dir, "b"))
    encounter_stream(spark, os.path.join(in_dir, "*"), lambda: (pats, pats), out, ck, as_of).awaitTermination()
    seqs = sorted(r.seq for r in spark.read.parquet(out).select("seq").collect())
    assert seqs == [1, 2, 3]                       # the first file is not processed again


def test_key_filter_reaches_both_scans(spark, tmp_dir):
    pats = spark.range(0, 100).select(F.col("id").alias("documento_id"), F.lit("x").alias("nombre"))
    enc = spark.range(0, 500).select((F.col("id") % 100).alias("documento_id"), F.col("id").alias("n"))
    pats.write.parquet(os.path.join(tmp_dir, "p"))
    enc.write.parquet(os.path.join(tmp_dir, "e"))
    p = spark.read.parquet(os.path.join(tmp_dir, "p"))
    e = spark.read.parquet(os.path.join(tmp_dir, "e"))
    plan = L.plan_text(p.filter(F.col("documento_id") == 7).join(e, "documento_id"))
    assert plan.count("EqualTo(documento_id,7)") == 2          # inferred for the encounters scan too


def test_stream_sees_patients_registered_since_it_started(spark, tmp_dir):
    """One micro-batch per file; a patient is added after the first."""
    from ehrflow.sources.commands import NEW_ENCOUNTER
    in_dir, out, store = (os.path.join(tmp_dir, x) for x in ("in", "out", "usuario"))
    row = {"documento_id": 2, "tipo_atencion": "C", "motivo_consulta": "m", "enfermedad_actual": "e",
           "impresion_diagnostica": "i", "conducta_plan_manejo": "c", "clinician_id": 1}
    for seq in (1, 2):
        spark.createDataFrame([dict(row, seq=seq)], NEW_ENCOUNTER).coalesce(1).write.mode("append").json(in_dir)
    spark.createDataFrame([(1, "Ana", "Ruiz", "medico")], USERS).write.parquet(store)
    calls = []

    def tables():
        if calls:                                          # registered while the stream runs
            spark.createDataFrame([(2, "Luis", "Paz", "paciente")], USERS).write.mode("append").parquet(store)
        calls.append(1)
        users = spark.read.parquet(store)
        return users, users

    encounter_stream(spark, in_dir, tables, out, os.path.join(tmp_dir, "ck"), dt.datetime(2024, 1, 1), max_files_per_trigger=1).awaitTermination()
    got = sorted((r.lote, r.estado, r.motivo) for r in spark.read.parquet(out).collect())
    assert got == [(0, "rechazado", "paciente_no_existe"), (1, "aceptado", None)]
