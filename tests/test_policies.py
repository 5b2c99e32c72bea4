import datetime as dt

import pytest
from pyspark.sql import functions as F

from ehrflow.functions import scalars as S
from ehrflow.plans import catalog, layout, policies


@pytest.fixture(scope="module")
def session(spark, tmp_path_factory):
    own, at = spark.newSession(), str(tmp_path_factory.mktemp("sql"))
    roles = {1: "medico", 2: "paciente", 3: "admisionista", 4: None}
    users = [(k, roles.get(k, "paciente"), f"n{k}", f"p{k}@x", f"h{k}", f"3{k}") for k in range(1, 21)]
    own.createDataFrame(users, "documento_id long, tipo_usuario string, primer_nombre string, correo_electronico string, hashed_password string, celular string").write.parquet(f"{at}/u")
    own.createDataFrame([(k % 20 + 1, str(k), "C") for k in range(100)], "documento_id long, atencion_id string, tipo_atencion string").write.parquet(f"{at}/a")
    policies.install(own, {"usuario": own.read.parquet(f"{at}/u"), "atencion": own.read.parquet(f"{at}/a")})
    return own


def test_rows_follow_the_principal(session):
    ids = lambda view: sorted({r[0] for r in session.sql(f"SELECT documento_id FROM {view}").collect()})
    for principal, seen in (("NULL", []), (1, list(range(1, 21))), (2, [2]), (3, []), (4, []), (7, [7]), (99, [])):
        session.sql(f"SET VAR principal = {principal}")
        assert ids("mis_pacientes") == seen and ids("mis_atenciones") == seen, principal
    session.sql("SET VAR principal = 2")
    assert session.sql("SELECT correo_electronico FROM mis_pacientes").first()[0] == "p2@x"
    assert len(ids("pacientes_admision")) == 20


def test_the_password_hash_is_in_no_view(session):
    for view in ("pacientes_admision", "mis_pacientes", "mis_atenciones"):
        assert not {"hashed_password", "datos_adicionales"} & set(session.table(view).columns)


def test_filters_and_columns_reach_the_scan(session):
    session.sql("SET VAR principal = 1")
    plan = layout.plan_text(session.sql("SELECT primer_nombre FROM mis_pacientes WHERE documento_id = 7"))
    assert "EqualTo(documento_id,7)" in plan and "ReadSchema: struct<documento_id:bigint,primer_nombre:string>" in plan
    plan = layout.plan_text(session.sql("SELECT tipo_atencion FROM mis_atenciones WHERE atencion_id = '5'"))
    assert "EqualTo(atencion_id,5)" in plan


def test_functions_equal_the_columns(session):
    days = [dt.date(2004, 2, 29), dt.date(1990, 12, 31), dt.date(2023, 2, 28), None]
    rows = [(d, t, u, a, w) for d, (t, u, a, w) in zip(days * 3, [("ana MARÍA", "", ["A", "B"], dt.datetime(1992, 6, 1, 4, 30)), (None, "x", [], None), ("2024-01-02T03", None, None, dt.datetime(2024, 1, 1)),
                                                                  ("", "Ñu", ["A", None], dt.datetime(1992, 5, 3, 5))] * 3)]
    df = session.createDataFrame(rows, "d date, t string, u string, a array<string>, w timestamp_ntz")
    df.createOrReplaceTempView("filas")
    today = dt.date(2023, 2, 28)
    pairs = [("edad_en(d, DATE'2023-02-28')", S.age_years("d", today)), ("edad_mostrada(d, 7, DATE'2023-02-28')", S.display_age("d", F.lit(7), today)),
             ("hora_local(w)", S.to_local("w")), ("texto_o(t, '--')", S.falsy_or("t", "--")), ("primer_texto(t, u, '--')", S.coalesce_falsy("t", "u", F.lit("--"))),
             ("firma(t, u)", S.signature("t", "u")), ("capitalizar(t)", S.capitalize("t")), ("unir_codigos(a)", S.join_codes("a")), ("fecha_iso(t)", S.iso_date_part("t")),
             ("dias_antes(w, 5)", S.days_before("w", 5))]
    assert {p[0].split("(")[0] for p in pairs} == {f[0].split("(")[0] for f in policies.FUNCTIONS}
    for text, column in pairs:
        got = [r[0] for r in session.sql(f"SELECT {text} FROM filas").collect()]
        assert got == [r[0] for r in df.select(column).collect()], text


def test_registered_queries(spark):
    from tests.oracle_check import canon, duck
    sf = "/root/testdata/sf0.001"
    con = duck(sf)
    for name in ("sql_visible_rows", "sql_public_projection"):
        df = catalog.QUERIES[name](spark, sf)
        want = con.execute(catalog.ORACLE[name])
        assert canon(df.columns, [tuple(r) for r in df.collect()])[1:] == canon([c[0] for c in want.description], want.fetchall())[1:], name
