import datetime as dt

from pyspark.sql import functions as F

from ehrflow.operators import views as V
from ehrflow.sources.schemas import ATENCION, PROFESIONAL_SALUD, USUARIO


def conform(spark, rows, schema):
    df = spark.createDataFrame(rows)
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in schema.fields])


def tables(spark):
    u = conform(spark, [
        {"documento_id": 1, "primer_nombre": "Ana", "fecha_nacimiento": dt.date(2004, 2, 29), "edad": 3,
         "tipo_usuario": "paciente", "hashed_password": "h"},
        {"documento_id": 2, "primer_nombre": "Luis", "tipo_usuario": "medico", "hashed_password": "h", "edad": 40},
    ], USUARIO)
    e = conform(spark, [
        {"atencion_id": "a1", "documento_id": 1, "fecha_hora_atencion": dt.datetime(2024, 1, 1, 0, 0),
         "tipo_atencion": "Urgencias", "signos_vitales": '{"fc": 80}', "profesional_responsable": "p1"},
        {"atencion_id": "a2", "documento_id": 1, "fecha_hora_atencion": dt.datetime(2024, 1, 2, 0, 0),
         "responsable_registro": "Dr. Ana Ruiz"},
    ], ATENCION)
    p = conform(spark, [{"id_personal_salud": "p1", "nombre_completo": "Dra. Uno"}], PROFESIONAL_SALUD)
    return {"usuario": u, "atencion": e, "profesional_salud": p}


def test_clinician_and_patient_views(spark):
    t = tables(spark)
    ids = spark.createDataFrame([(1,), (2,)], "documento_id long")
    rows = {r.documento_id: r for r in V.clinician_lookup(t, ids, dt.date(2023, 2, 28)).collect()}
    assert len(rows) == 2
    assert rows[1].edad == 18 and rows[2].atenciones == []
    assert "hashed_password" not in rows[1].asDict()
    a = rows[1].atenciones
    assert [x.atencion_id for x in a] == ["a2", "a1"]
    assert a[1].fecha_hora_atencion == dt.datetime(2023, 12, 31, 19, 0)          # local time
    assert [x.profesional_responsable_nombre for x in a] == ["No especificado", "Dra. Uno"]
    assert a[1].signos_vitales == '{"fc": 80}' and a[0].signos_vitales is None       # as stored
    page = V.patient_page(t, ids, dt.date(2023, 2, 28)).collect()
    assert [r.documento_id for r in page] == [1]                                 # the clinician has no page
    assert [x.profesional_responsable_nombre for x in page[0].atenciones] == ["Dr. Ana Ruiz", "Dra. Uno"]
    assert page[0].atenciones[1].signos_vitales.toPython() == {"fc": 80}


def test_admission_lookup(spark):
    t = tables(spark)
    ids = spark.createDataFrame([(1,)], "documento_id long")
    r = V.admission_lookup(t, ids, masked=True).first()
    assert r.edad == 3 and "atenciones" not in r.asDict()
    r = V.admission_lookup(t, ids).first()
    assert r.edad == 3 and len(r.atenciones) == 2
    assert r.atenciones[1].fecha_hora_atencion == dt.datetime(2024, 1, 1, 0, 0) and r.atenciones[1].profesional_responsable_nombre is None


def test_views_order_by_instant_across_dst_end(spark):
    """Bogota left daylight saving at 1993-02-07 04:00 UTC (local 00:00 went
    back to 23:00), so local 23:00-24:00 of Feb 6 happened twice: 04:30 UTC
    is the later instant but shows an earlier wall time than 03:50 UTC."""
    t = tables(spark)
    t["atencion"] = conform(spark, [
        {"atencion_id": "x1", "documento_id": 1, "fecha_hora_atencion": dt.datetime(1993, 2, 7, 3, 50)},
        {"atencion_id": "x2", "documento_id": 1, "fecha_hora_atencion": dt.datetime(1993, 2, 7, 4, 30)},
    ], ATENCION)
    rows = V.clinician_lookup(t, spark.createDataFrame([(1,)], "documento_id long"), dt.date(2023, 2, 28)).first()
    assert [a.atencion_id for a in rows.atenciones] == ["x2", "x1"]                 # later instant first
    assert [a.fecha_hora_atencion for a in rows.atenciones] == [dt.datetime(1993, 2, 6, 23, 30),
                                                                 dt.datetime(1993, 2, 6, 23, 50)]
    assert "_orden" not in rows.atenciones[0].asDict()
