from ehrflow.operators import integrity as J


def test_rules(spark):
    child = spark.createDataFrame([(1, "a", "p1"), (1, "a", "p9"), (2, None, None), (None, "c", "p1")],
                                  "documento_id long, atencion_id string, prof string")
    parent = spark.createDataFrame([("p1",)], "id string")
    pk = J.pk_violations(child, ["documento_id", "atencion_id"], "t").collect()
    assert sorted((r.regla, r.clave) for r in pk) == [("pk_duplicada", "1|a"), ("pk_nula", "2|NULL"),
                                                      ("pk_nula", "NULL|c")]
    fk = J.fk_violations(child, parent, ["prof"], ["id"], ["documento_id", "atencion_id"], "t", "p").collect()
    assert [(r.clave, r.detalle) for r in fk] == [("1|a", "p(p9)")]     # NULL reference passes
    nn = J.null_violations(child, ["atencion_id", "prof"], ["documento_id"], "t").collect()
    assert sorted((r.clave, r.detalle) for r in nn) == [("2", "atencion_id"), ("2", "prof")]
    ln = J.length_violations(child, {"prof": 1}, ["documento_id"], "t").collect()
    assert sorted(r.clave for r in ln) == ["1", "1", "NULL"]
    dup = J.duplicate_keys(child, ["documento_id"]).collect()
    assert [(r.documento_id, r.n) for r in dup] == [(1, 2)]


def test_validate_tables(spark):
    from ehrflow.sources.schemas import ATENCION, PROFESIONAL_SALUD, USUARIO
    u = spark.createDataFrame([(1, None)], "documento_id long, hashed_password string")
    u = u.select(*[u[c] if c in u.columns else __import__("pyspark.sql.functions", fromlist=["lit"]).lit(None)
                   .cast(f.dataType).alias(c) for f in USUARIO.fields for c in [f.name]])
    e = spark.createDataFrame([], ATENCION)
    p = spark.createDataFrame([], PROFESIONAL_SALUD)
    rep = J.validate_tables({"usuario": u, "atencion": e, "profesional_salud": p}).collect()
    assert [(r.regla, r.tabla, r.detalle) for r in rep] == [("no_nulo", "usuario", "hashed_password")]
