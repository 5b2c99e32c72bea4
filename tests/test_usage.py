"""The README's usage example, run as written."""


def test_readme_usage(spark, tmp_dir):
    import datetime as dt

    from pyspark.sql import functions as F

    from ehrflow.operators import documents, history, integrity, views
    from ehrflow.sources import seed, tables

    as_of = dt.datetime(2024, 1, 31, 15, 30)            # UTC wall time of "now"
    tables.create_tables(spark, tmp_dir)                   # empty store, created only if missing
    t = tables.load_tables(spark, tmp_dir)
    t, _ = seed.seed_if_empty(spark, t, {
        "profesional_salud": [{"nombre_completo": "Dra. Ana Ruiz"}],
        "usuario": [{"documento_id": 10, "primer_nombre": "Luis", "primer_apellido": "Paz",
                     "fecha_nacimiento": dt.date(1980, 5, 1), "tipo_usuario": "paciente", "hashed_password": "h"}],
        "atencion": [{"documento_id": 10, "tipo_atencion": "Consulta", "motivo_consulta": "Control",
                      "signos_vitales": {"ta": "120/80", "fc": 72}, "profesional_nombre": "Dra. Ana Ruiz",
                      "dias_atras": 3}],
    }, as_of)
    tables.save_tables(t, tmp_dir)                          # append the seed to the store

    t = tables.load_tables(spark, tmp_dir)
    ids = spark.createDataFrame([(10,)], "documento_id long")
    clinician = views.clinician_lookup(t, ids, as_of.date())   # nested history, local times
    docs = documents.history_documents(history.patient_view(t["usuario"], as_of.date()),
                                       t["atencion"], t["profesional_salud"], as_of)
    report = integrity.validate_tables(t)                   # PK / NOT NULL / FK / length

    row = clinician.first()
    assert row.edad == 43 and row.atenciones[0].profesional_responsable_nombre == "Dra. Ana Ruiz"
    parts = docs.filter(F.col("documento_id") == 10).orderBy(F.desc_nulls_first("mes")).collect()
    body = "\n".join(p.cuerpo for p in parts)              # header, then the months from the newest on
    assert "VITALES: P. Arterial: 120/80; F. Cardíaca: 72" in body and "FIRMA: Dr/a. Dra. Ana Ruiz" in body
    assert report.count() == 0
