import datetime as dt
import json
import random

from ehrflow.operators import writes as W

AS_OF = dt.datetime(2024, 1, 31, 15, 0)
PAT = "documento_id long, correo_electronico string, primer_nombre string, fecha_nacimiento date, hashed_password string"
BATCH = PAT + ", seq long"


def sequential(current, batch):
    """Brute-force model of the request-at-a-time rule."""
    docs = {d for d, _ in current}
    mails = [m for _, m in current]
    out = {}
    for d, m, s in sorted(batch, key=lambda r: r[2]):
        if d in docs:
            out[s] = "documento"
        elif m in mails:                      # None == None counts, as IS NULL does
            out[s] = "correo"
        else:
            out[s] = "aceptado"
            docs.add(d)
            mails.append(m)
    return out


def run_insert(spark, current, batch):
    cur = spark.createDataFrame([(d, m, "x", None, "h") for d, m in current], PAT)
    b = spark.createDataFrame([(d, m, "y", None, "h", s) for d, m, s in batch], BATCH)
    acc, rej = W.insert_patients(cur, b, AS_OF)
    got = {r.seq: "aceptado" for r in acc.select("seq").collect()}
    got.update({r.seq: r.motivo for r in rej.collect()})
    return got, acc


def test_insert_patients_edge_cases(spark):
    current = [(1, "a@x"), (2, None)]
    batch = [(1, "new@x", 1),        # same document
             (3, "a@x", 2),          # same e-mail
             (4, None, 3),           # NULL e-mail conflicts with the stored NULL
             (1, "a@x", 4),          # both at once: document wins
             (5, "c@x", 5), (5, "d@x", 6),      # in-batch document chain
             (6, "c@x", 7), (7, "e@x", 8)]      # row 7 loses to row 5's e-mail
    got, acc = run_insert(spark, current, batch)
    assert got == sequential(current, batch)
    assert got[4] == "documento" and got[3] == "correo"
    r = acc.filter("seq = 5").first()
    assert r.tipo_usuario == "paciente" and r.created_at == AS_OF


def test_insert_patients_matches_sequential_rule(spark):
    rnd = random.Random(7)
    for _ in range(4):
        current = [(rnd.randint(0, 6), rnd.choice([None, "a", "b", "c"])) for _ in range(3)]
        batch = [(rnd.randint(0, 9), rnd.choice([None, "a", "b", "c", "d", "e", "f"]), s) for s in range(25)]
        got, _ = run_insert(spark, current, batch)
        assert got == sequential(current, batch)


def test_insert_or_ignore(spark):
    cur = spark.createDataFrame([(1, "a")], "k long, v string")
    batch = spark.createDataFrame([(1, "b", 1), (2, "c", 3), (2, "d", 2)], "k long, v string, seq long")
    table, ins = W.insert_or_ignore(cur, batch, ["k"])
    assert sorted(tuple(r) for r in ins.collect()) == [(2, "d")]
    assert table.count() == 2
    table2, ins2 = W.insert_or_ignore(cur, batch, None)
    assert ins2.count() == 3 and table2.count() == 4


def test_patch_semantics(spark):
    cur = spark.createDataFrame([
        (1, "c1", "m1", dt.date(2000, 1, 1), 10, None),
        (2, "c2", "m2", dt.date(2000, 1, 1), 10, None),
        (3, "c3", "m3", None, 50, None),
    ], "documento_id long, celular string, correo_electronico string, fecha_nacimiento date, edad int, updated_at timestamp_ntz")
    # keep only the columns patch_patients touches plus the others it needs
    patches = spark.createDataFrame([
        (1, 1, json.dumps({})),                                            # absent: nothing changes
        (2, 1, json.dumps({"celular": None, "correo_electronico": ""})),   # explicit null and ''
        (2, 2, json.dumps({"celular": "new"})),                            # later patch wins
        (3, 1, json.dumps({"fecha_nacimiento": "2004-02-29"})),            # recompute age
        (3, 2, json.dumps({"edad": 7})),                                   # later explicit age wins
        (3, 3, json.dumps({"fecha_nacimiento": None})),                    # null birth date: stale age kept
        (9, 1, json.dumps({"celular": "x"})),                              # unknown id
        (1, 5, json.dumps({"edad": "abc"})),                               # wrong type
    ], "documento_id long, seq long, patch string")
    from pyspark.sql import functions as F
    full = cur
    for f in W.PATCH_FIELDS:
        if f not in full.columns:
            full = full.withColumn(f, F.lit(None).cast("string"))
    out, rej = W.patch_patients(full, patches, AS_OF)
    rows = {r.documento_id: r for r in out.collect()}
    assert (rows[1].celular, rows[1].edad, rows[1].updated_at) == ("c1", 10, None)
    assert (rows[2].celular, rows[2].correo_electronico, rows[2].updated_at) == ("new", "", AS_OF)
    assert rows[3].fecha_nacimiento is None and rows[3].edad == 7
    assert sorted((r.documento_id, r.motivo) for r in rej.collect()) == [(1, "tipo_invalido"), (9, "no_existe")]


def test_patch_recompute_after_age(spark):
    from pyspark.sql import functions as F
    cur = spark.createDataFrame([(3, None, 50)], "documento_id long, fecha_nacimiento date, edad int")
    for f in W.PATCH_FIELDS:
        if f not in cur.columns:
            cur = cur.withColumn(f, F.lit(None).cast("string"))
    patches = spark.createDataFrame([(3, 1, '{"edad": 7}'), (3, 2, '{"fecha_nacimiento": "2004-02-29"}')],
                                    "documento_id long, seq long, patch string")
    out, _ = W.patch_patients(cur, patches, dt.datetime(2023, 2, 28, 17, 0))
    assert out.first().edad == 18


def test_insert_encounters(spark):
    users = spark.createDataFrame([(1, "Ana", "Ruiz", "paciente"), (2, None, "Paz", "medico"), (3, "Eva", "Sol", None)],
                                  "documento_id long, primer_nombre string, primer_apellido string, tipo_usuario string")
    batch = spark.createDataFrame([
        (1, "Consulta", "m", "e", "i", "c", "", 2, 1),
        (5, "Consulta", "m", "e", "i", "c", "x", 2, 2),
        (1, None, "m", "e", "i", "c", "x", 2, 3),
        (1, "X" * 81, "m", "e", "i", "c", "x", 2, 4),
        (1, "Consulta", "m", "e", "i", "c", "x", 1, 5),       # a patient signs
        (1, "Consulta", "m", "e", "i", "c", "x", 3, 6),       # a user without a role
        (1, None, "m", "e", "i", "c", "x", 99, 7),            # nobody: before all else
        (1, "Consulta", "m", "e", "i", "c", "x", None, 8),
    ], "documento_id long, tipo_atencion string, motivo_consulta string, enfermedad_actual string, "
       "impresion_diagnostica string, conducta_plan_manejo string, alergias_conocidas string, clinician_id long, seq long")
    acc, rej = W.insert_encounters(users, batch, users, AS_OF)
    a = acc.first()
    assert acc.count() == 1 and a.responsable_registro == "Dr. None Paz" and a.alergias_conocidas is None
    assert a.fecha_hora_atencion == AS_OF and a.profesional_responsable is None and len(a.atencion_id) == 64
    assert sorted((r.seq, r.motivo) for r in rej.collect()) == [
        (2, "paciente_no_existe"), (3, "campo_requerido"), (4, "longitud"), (5, "rol_no_permitido"), (6, "rol_no_permitido"),
        (7, "no_autenticado"), (8, "no_autenticado")]


def test_cascade_delete(spark):
    tables = {
        "usuario": spark.createDataFrame([(1,), (2,)], "documento_id long"),
        "atencion": spark.createDataFrame([(1, "a"), (2, "b")], "documento_id long, atencion_id string"),
        "diagnostico": spark.createDataFrame([(1, "a", "d")], "documento_id long, atencion_id string, diagnostico_id string"),
        "tecnologia_salud": spark.createDataFrame([(1, "a", "t"), (2, "b", "u")],
                                                  "documento_id long, atencion_id string, tecnologia_id string"),
        "egreso": spark.createDataFrame([(1, "a", "e")], "documento_id long, atencion_id string, egreso_id string"),
    }
    out = W.cascade_delete(tables, spark.createDataFrame([(1,)], "documento_id long"))
    assert {k: v.count() for k, v in out.items()} == {"usuario": 1, "atencion": 1, "diagnostico": 0,
                                                       "tecnologia_salud": 1, "egreso": 0}
    out2 = W.delete_encounters(tables, spark.createDataFrame([(2, "b")], "documento_id long, atencion_id string"))
    assert out2["tecnologia_salud"].count() == 1 and out2["usuario"].count() == 2


def test_insert_patients_empty_and_all_rejected(spark):
    got, acc = run_insert(spark, [(1, "a")], [])
    assert got == {} and acc.count() == 0
    got, acc = run_insert(spark, [(1, "a")], [(1, "x", 1), (2, "a", 2)])
    assert got == {1: "documento", 2: "correo"} and acc.count() == 0


def test_insert_long_chain(spark):
    """Each row shares its document with the row before and its e-mail with
    the row after: every second one is accepted, one round for each."""
    batch = [(100 + s // 2, f"m{(s + 1) // 2}", s) for s in range(60)]
    got, _ = run_insert(spark, [(1, "a")], batch)
    assert got == sequential([(1, "a")], batch) and sum(v == "aceptado" for v in got.values()) == 30


def test_insert_rows_with_equal_or_missing_seq(spark):
    cur = spark.createDataFrame([(1, "a", "x", None, "h")], PAT)
    same = (2, "b", "y", None, "h", 1)
    rows = [same, same, (3, "c", "y", None, "h", None), (3, "c", "z", None, "h", 9), (4, None, "y", None, "h", None), (5, "e", "y", None, "h", 1),
            (None, "q", "y", None, "h", 1), (6, "f", "y", None, None, 1), (7, "g", "n" * 121, None, "h", 1)]
    acc, rej = W.insert_patients(cur, spark.createDataFrame(rows, BATCH), AS_OF)
    assert sorted((r.documento_id, r.seq) for r in acc.collect()) == sorted([(2, 1), (3, 9), (4, None), (5, 1)], key=lambda x: x[0])
    assert sorted(((r.documento_id or 0), r.seq, r.motivo) for r in rej.select("documento_id", "motivo", "seq").collect()
                  if r.documento_id != 3) == [(0, 1, "campo_requerido"), (2, 1, "documento"), (6, 1, "campo_requerido"), (7, 1, "longitud")]
    assert [(r.seq, r.motivo) for r in rej.filter("documento_id = 3").collect()] == [(None, "documento")]      # a missing seq comes last


def test_writes_check_the_role(spark):
    from pyspark.sql import functions as F
    users = spark.createDataFrame([(1, "admisionista"), (2, "medico"), (3, None)], "documento_id long, tipo_usuario string")
    cur = spark.createDataFrame([(10, "a", "x", None, "h")], PAT)
    batch = spark.createDataFrame([(20 + i, f"m{i}", "y", None, "h", i) for i in range(4)], BATCH).withColumn("principal_id", F.col("seq"))
    acc, rej = W.insert_patients(cur, batch, AS_OF, users=users)
    assert [r.seq for r in acc.collect()] == [1]
    assert sorted((r.seq, r.motivo) for r in rej.collect()) == [(0, "no_autenticado"), (2, "rol_no_permitido"), (3, "rol_no_permitido")]
    for f in W.PATCH_FIELDS:
        if f not in cur.columns:
            cur = cur.withColumn(f, F.lit(None).cast("string"))
    patches = spark.createDataFrame([(10, i, '{"celular":"1"}', i) for i in range(4)], "documento_id long, seq long, patch string, principal_id long")
    _, rej = W.patch_patients(cur, patches, AS_OF, users=users)
    assert sorted((r.seq, r.motivo) for r in rej.collect()) == [(0, "no_autenticado"), (2, "rol_no_permitido"), (3, "rol_no_permitido")]


def test_no_patch_ends_the_job(spark):
    from pyspark.sql import functions as F
    cur = spark.createDataFrame([(1, "c", 5)], "documento_id long, celular string, edad int")
    for f in W.PATCH_FIELDS:
        if f not in cur.columns:
            cur = cur.withColumn(f, F.lit(None).cast("date" if f == "fecha_nacimiento" else "string"))
    texts = ['{"celular":"a","celular":"b","edad":1,"edad":"12"}', '{"celular":5}', '{"celular":{"a":1}}', '{"celular":"' + "9" * 51 + '"}',
             '{"edad":1.5}', '{"fecha_nacimiento":"x"}', "[]", "", None, "{", '"text"', '{"documento_id":7,"nobody":{"a":[1]}}', '{"factor_rh":"123456"}']
    patches = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "documento_id long, seq long, patch string")
    out, rej = W.patch_patients(cur, patches, AS_OF)
    r = out.first()
    assert (r.documento_id, r.celular, r.edad) == (1, "b", 12)
    bad = dict.fromkeys((1, 2, 4, 5, 6, 7, 8, 9, 10), "tipo_invalido") | {3: "longitud", 12: "longitud"}
    assert {r.seq: r.motivo for r in rej.collect()} == bad


def test_scale_conf_bounds():
    from ehrflow.session import scale_conf
    big = scale_conf(100 * 2 ** 40, 8000)
    assert big["spark.sql.shuffle.partitions"] == "100000"
    assert scale_conf(10 ** 8, 8)["spark.sql.shuffle.partitions"] == "24"
    assert scale_conf(2 ** 40, 100)["spark.sql.shuffle.partitions"] == "1024"


def test_patch_matches_sequential_model(spark):
    from pyspark.sql import functions as F
    rnd = random.Random(41)
    today = dt.date(2024, 1, 31)                       # local date of AS_OF

    def age(d):
        return today.year - d.year - ((today.month, today.day) < (d.month, d.day))

    current = {k: {"celular": f"c{k}", "fecha_nacimiento": dt.date(1990, 1, 1), "edad": 40} for k in range(8)}
    patches = []
    for s in range(60):
        doc = rnd.randint(0, 9)                         # 8 and 9 do not exist
        body = {}
        for f in rnd.sample(["celular", "fecha_nacimiento", "edad"], rnd.randint(0, 3)):
            if f == "celular":
                body[f] = rnd.choice([None, "", f"n{s}"])
            elif f == "fecha_nacimiento":
                body[f] = rnd.choice([None, f"{rnd.randint(1950, 2020)}-0{rnd.randint(1, 9)}-1{rnd.randint(0, 9)}"])
            else:
                body[f] = rnd.choice([None, rnd.randint(0, 99)])
        patches.append((doc, s, body))
    model = {k: dict(v) for k, v in current.items()}
    for doc, s, body in sorted(patches, key=lambda p: p[1]):   # one request at a time
        if doc not in model:
            continue
        for f, v in body.items():
            model[doc][f] = dt.date.fromisoformat(v) if f == "fecha_nacimiento" and v else v
        if body.get("fecha_nacimiento"):
            model[doc]["edad"] = age(model[doc]["fecha_nacimiento"])
    cur = spark.createDataFrame([(k, v["celular"], v["fecha_nacimiento"], v["edad"], None) for k, v in current.items()],
                                "documento_id long, celular string, fecha_nacimiento date, edad int, updated_at timestamp_ntz")
    for f in W.PATCH_FIELDS:
        if f not in cur.columns:
            cur = cur.withColumn(f, F.lit(None).cast("string"))
    pdf = spark.createDataFrame([(d, s, json.dumps(b)) for d, s, b in patches], "documento_id long, seq long, patch string")
    out, rej = W.patch_patients(cur, pdf, AS_OF)
    got = {r.documento_id: {"celular": r.celular, "fecha_nacimiento": r.fecha_nacimiento, "edad": r.edad}
           for r in out.collect()}
    assert got == model
    assert {r.documento_id for r in rej.collect()} == {d for d, _, _ in patches if d not in current}


def test_insert_or_ignore_matches_model(spark):
    rnd = random.Random(53)
    current = {rnd.randint(0, 30) for _ in range(10)}
    batch = [(rnd.randint(0, 40), f"v{s}", s) for s in rnd.sample(range(1000), 80)]
    model = {}
    for k, v, s in sorted(batch, key=lambda r: r[2]):
        if k not in current and k not in model:
            model[k] = v
    cur = spark.createDataFrame([(k, "old") for k in current], "k long, v string")
    b = spark.createDataFrame(batch, "k long, v string, seq long")
    table, ins = W.insert_or_ignore(cur, b, ["k"])
    assert {r.k: r.v for r in ins.collect()} == model
    assert table.count() == len(current) + len(model)
