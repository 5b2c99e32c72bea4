import datetime as dt

from pyspark.sql import functions as F

from ehrflow.operators import history as H

ENC = "atencion_id string, documento_id long, fecha_hora_atencion timestamp_ntz, profesional_responsable string, responsable_registro string"
PROF = "id_personal_salud string, nombre_completo string"


def encounters(spark):
    t = dt.datetime
    return spark.createDataFrame([
        ("a1", 1, t(2024, 1, 1, 10), None, None),        # FK null, registro null
        ("a2", 1, t(2024, 1, 3, 10), None, ""),          # FK null, registro ''
        ("a3", 1, t(2024, 1, 3, 10), "p9", "Dr. X"),     # FK unmatched
        ("a4", 2, t(2024, 1, 2, 10), "p1", None),        # matched, name present
        ("a5", 2, t(2024, 1, 2, 11), "p2", "Dr. Y"),     # matched, name NULL
        ("a6", 2, t(2024, 1, 2, 12), None, "Dr. Z"),     # FK null, registro set
    ], ENC)


def professionals(spark):
    return spark.createDataFrame([("p1", "Ana"), ("p2", None)], PROF)


def patients(spark):
    return spark.createDataFrame([(1, "uno"), (2, "dos"), (3, "tres")], "documento_id long, primer_nombre string")


def test_name_policies(spark):
    e, p = encounters(spark), professionals(spark)
    got = {}
    for pol in ("clinician", "patient", "export"):
        rows = H.with_professional(e, p, pol).select("atencion_id", "profesional_nombre").collect()
        got[pol] = {r.atencion_id: r.profesional_nombre for r in rows}
    assert got["clinician"] == {"a1": "No especificado", "a2": "No especificado", "a3": "Desconocido",
                                "a4": "Ana", "a5": None, "a6": "No especificado"}
    assert got["patient"] == {"a1": "Profesional de Staff", "a2": "Profesional de Staff", "a3": "Desconocido",
                              "a4": "Ana", "a5": None, "a6": "Dr. Z"}
    assert got["export"] == {"a1": "Profesional de Turno", "a2": "Profesional de Turno", "a3": "Firma Pendiente",
                             "a4": "Ana", "a5": None, "a6": "Dr. Z"}


def test_nested_history_order_and_empty(spark):
    h = H.patient_history(patients(spark), encounters(spark).select("atencion_id", "documento_id", "fecha_hora_atencion"))
    rows = {r.documento_id: r for r in h.collect()}
    assert [a.atencion_id for a in rows[1].atenciones] == ["a3", "a2", "a1"]   # newest first, id breaks ties
    assert [a.atencion_id for a in rows[2].atenciones] == ["a6", "a5", "a4"]
    assert rows[3].atenciones == [] and rows[3].mes is None


def test_one_row_for_each_month(spark):
    e = spark.createDataFrame([(1, "a", dt.datetime(2024, 1, 31, 23)), (1, "b", dt.datetime(2024, 2, 1, 0)), (1, "c", dt.datetime(2024, 2, 1, 0)),
                               (1, "d", None)], "documento_id long, atencion_id string, fecha_hora_atencion timestamp_ntz")
    rows = {(r.documento_id, r.mes): [a.atencion_id for a in r.atenciones] for r in H.patient_history(patients(spark), e).collect()}
    assert rows == {(1, dt.date(2024, 1, 1)): ["a"], (1, dt.date(2024, 2, 1)): ["c", "b"], (1, None): ["d"], (2, None): [], (3, None): []}


def test_history_rows_and_counts(spark):
    e = encounters(spark).select("atencion_id", "documento_id")
    rows = H.patient_history_rows(patients(spark), e).collect()
    assert len(rows) == 7
    assert [r.atencion_id for r in rows if r.documento_id == 3] == [None]
    counts = {r.documento_id: r.n_atenciones for r in H.encounter_counts(patients(spark), e).collect()}
    assert counts == {1: 3, 2: 3, 3: 0}


def test_resolve_fk_and_children(spark):
    dim = spark.createDataFrame([("k2", "Ana"), ("k1", "Ana"), ("k3", None)], "k string, name string")
    df = spark.createDataFrame([("Ana",), ("Luis",), (None,)], "n string")
    out = {r.n: r.key for r in H.resolve_fk(df, dim, "n", "name", "k", "key").collect()}
    assert out == {"Ana": "k1", "Luis": None, None: None}
    enc = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "documento_id long, atencion_id string")
    kids = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "documento_id long, atencion_id string, v string")
    j = H.with_children(enc, kids).collect()
    assert sorted((r.documento_id, r.atencion_id, r.v) for r in j) == [(1, "a", "x"), (1, "b", None), (2, "a", None)]


def test_row_counts(spark):
    a = spark.range(5)
    b = spark.range(0)
    out = {r.tabla: r.n for r in H.row_counts({"a": a, "b": b}).collect()}
    assert out == {"a": 5, "b": 0}


def test_patient_view_age(spark):
    p = spark.createDataFrame([(dt.date(2004, 2, 29), 5), (None, 7)], "fecha_nacimiento date, edad int")
    assert [r.edad for r in H.patient_view(p, dt.date(2023, 2, 28)).collect()] == [18, 7]
    assert F is not None


def test_first_per_without_window(spark):
    from ehrflow.operators.lookup import first_per
    df = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("a", 1, "z"), ("b", 2, "w")], "g string, o int, v string")
    got = sorted(tuple(r) for r in first_per(df, ["g"], ["o", "v"]).collect())
    assert got == [("a", 1, "y"), ("b", 2, "w")]
    got = sorted(tuple(r) for r in first_per(df, ["g"], ["o", "v"], descending=True).collect())
    assert got == [("a", 3, "x"), ("b", 2, "w")]
    from ehrflow.plans.layout import plan_text
    assert "Window" not in plan_text(first_per(df, ["g"], ["o"]))


def test_exists_flag(spark):
    from ehrflow.operators.lookup import exists_flag, missing_in
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k long, m string")
    other = spark.createDataFrame([(1, None), (1, "c"), (9, "z")], "k long, m string")
    assert {r.k: r.f for r in exists_flag(df, other, "k", "f").collect()} == {1: True, 2: False, 3: False}
    assert {r.k: r.f for r in exists_flag(df, other, "m", "f", null_safe=True).collect()} == {1: False, 2: True, 3: True}
    assert {r.k: r.f for r in exists_flag(df, other, "m", "f").collect()} == {1: False, 2: False, 3: True}
    assert sorted(r.k for r in missing_in(df, other, "k").collect()) == [2, 3]
