import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from ehrflow.operators import incremental as N
from ehrflow.operators import writes as W
from ehrflow.plans import catalog
from ehrflow.plans import versions as V

AS_OF = dt.datetime(2024, 1, 31, 15)
FIELDS = ("tipo_documento primer_apellido segundo_apellido primer_nombre segundo_nombre sexo genero grupo_sanguineo factor_rh estado_civil direccion_residencia "
          "municipio_ciudad departamento telefono celular correo_electronico ocupacion entidad_afiliacion regimen_afiliacion").split()


def patients(spark, n=400):
    i = F.col("id")
    return spark.range(n).select(i.alias("documento_id"), *[F.concat(F.lit(f[:2]), i.cast("string")).alias(f) for f in FIELDS],
                                 F.lit(dt.date(2000, 1, 1)).alias("fecha_nacimiento"), F.lit(3).alias("edad"), F.lit(None).cast("timestamp_ntz").alias("updated_at"))


def rows(df):
    return sorted(map(repr, df.collect()))


def test_a_patch_rewrites_only_the_files_of_its_patients(spark, tmp_dir):
    root, pats = os.path.join(tmp_dir, "t"), patients(spark)
    V.create(pats.repartition(20, "documento_id"), root)
    before = V.files(spark, root)
    assert len(before) == 20 and rows(V.read(spark, root)) == rows(pats)
    patches = spark.createDataFrame([(k, 1, '{"celular":"nuevo"}') for k in (*range(0, 400, 160), 9999)], "documento_id long, seq long, patch string")
    patch = lambda df: W.patch_patients(df, patches, AS_OF)[0]
    version, old, new = V.change(spark, root, patches, "documento_id", patch)
    assert version == 1 and 1 <= len(old) <= 3 and set(V.files(spark, root)) == set(before) - set(old) | set(new)
    assert rows(V.read(spark, root)) == rows(patch(pats)) and rows(V.read(spark, root, 0)) == rows(pats)
    assert V.change(spark, root, patches.filter("documento_id = 9999"), "documento_id", patch) == (1, [], [])       # no file holds it
    gone = spark.createDataFrame([(k,) for k in (1, 2)], "documento_id long")
    version, old, _ = V.change(spark, root, gone, "documento_id", lambda df: W.cascade_delete({"usuario": df}, gone)["usuario"], added=patients(spark, 402).filter("documento_id >= 400"))
    assert version == 2 and V.read(spark, root).count() == 400 and V.versions(spark, root) == [0, 1, 2]
    on_disk = lambda: {f"data/{d}/{f}" for d in os.listdir(f"{root}/data") for f in os.listdir(f"{root}/data/{d}") if f.endswith(".parquet")}
    wanted = rows(V.read(spark, root))
    assert V.vacuum(spark, root) > 0 and on_disk() >= set(V.files(spark, root)) and V.versions(spark, root) == [2]
    assert {f for f in on_disk()} == set(V.files(spark, root)) and rows(V.read(spark, root)) == wanted


def test_of_two_writers_one_fails_and_leaves_nothing_visible(spark, tmp_dir):
    root, pats = os.path.join(tmp_dir, "t"), patients(spark, 50)
    V.create(pats.repartition(4, "documento_id"), root)
    key = spark.createDataFrame([(7,)], "documento_id long")

    def slow(df):                                                            # another writer commits in between
        V.change(spark, root, key, "documento_id", lambda x: x.withColumn("celular", F.lit("otro")))
        return df.withColumn("celular", F.lit("mio"))

    with pytest.raises(V.Conflict):
        V.change(spark, root, key, "documento_id", slow)
    assert V.versions(spark, root) == [0, 1] and V.read(spark, root).filter("celular = 'mio'").count() == 0
    assert V.read(spark, root).count() == 50
    with pytest.raises(V.Conflict):
        V.create(pats, root)


def test_broken_change_commits_nothing(spark, tmp_dir):
    root = os.path.join(tmp_dir, "t")
    V.create(patients(spark, 20).repartition(3, "documento_id"), root)
    key = spark.createDataFrame([(7,), (8,)], "documento_id long")
    with pytest.raises(Exception, match="alto"):
        V.change(spark, root, key, "documento_id", lambda df: df.withColumn("celular", F.raise_error(F.lit("alto")).cast("string")))
    assert V.versions(spark, root) == [0] and V.read(spark, root).count() == 20
    V.change(spark, root, key, "documento_id", lambda df: df.filter("documento_id NOT IN (7, 8)"))
    V.change(spark, root, spark.range(20).select(F.col("id").alias("documento_id")), "documento_id", lambda df: df.limit(0))
    assert V.read(spark, root).count() == 0 and V.read(spark, root).columns == patients(spark).columns


ENC = "documento_id long, atencion_id string, fecha_hora_atencion timestamp_ntz, tipo_atencion string, codigos array<string>"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_refreshed_histories_equal_a_rebuild(spark, tmp_dir, seed):
    r = random.Random(seed)

    def enc(p, a):
        when = None if r.random() < 0.05 else dt.datetime(2023, r.randint(1, 4), r.randint(1, 28), r.randint(0, 23))
        return (p, f"a{a}", when, r.choice(["x", "y", None]), r.choice([None, ["I10"], ["E11", None]]))

    state = {(p, f"a{a}"): enc(p, a) for p in range(8) for a in range(12) if r.random() < 0.6}
    stored_at = os.path.join(tmp_dir, "lists")
    N.month_lists(spark.createDataFrame(list(state.values()), ENC)).repartition(3).write.parquet(stored_at)
    stored = spark.read.parquet(stored_at)
    old_counts = N.counts(stored)
    changes, seq = [], 0
    for _ in range(60):                                                      # the same encounter several times, deletes of absent ones
        p, a, seq = r.randint(0, 10), r.randint(0, 14), seq + 1
        gone = r.random() < 0.4
        row = enc(p, a)
        changes.append((*row, gone, seq))
        state.pop((p, f"a{a}"), None)
        if not gone:
            state[p, f"a{a}"] = row
    r.shuffle(changes)
    changes = N.last_changes(spark.createDataFrame(changes, ENC + ", borrado boolean, seq int").repartition(4))
    want = N.month_lists(spark.createDataFrame(list(state.values()), ENC))
    assert rows(N.merge(stored, changes)) == rows(want)
    assert rows(N.merge_counts(old_counts, stored, changes)) == rows(N.counts(want))
    untouched = N.merge(stored, changes.limit(0))
    assert rows(untouched) == rows(stored) and N.affected(stored, changes.limit(0)).count() == 0


def test_refresh_by_whole_files(spark, tmp_dir):
    """The month lists as a versioned table: only files with a list that
    changes are written again."""
    day = lambda m: dt.datetime(2023, m, 3)
    state = [(p, f"{p}-{m}", day(m), "x", None) for p in range(40) for m in (1, 2)]
    root = os.path.join(tmp_dir, "h")
    V.create(N.month_lists(spark.createDataFrame(state, ENC)).repartition(10, "documento_id"), root)
    changes = N.last_changes(spark.createDataFrame([(3, "3-1", day(5), "z", None, False, 1), (3, "3-2", day(2), "x", None, True, 1)], ENC + ", borrado boolean, seq int"))
    _, old, _ = V.change(spark, root, changes, "documento_id", lambda lists: N.merge(lists, changes))
    assert len(old) == 1
    got = {(r.documento_id, r.mes.month): [x.atencion_id for x in r.atenciones] for r in V.read(spark, root).collect()}
    assert got == {(p, m): [f"{p}-{m}"] for p in range(40) for m in (1, 2) if p != 3} | {(3, 5): ["3-1"]}


def test_registered_queries(spark):
    from tests.oracle_check import canon, duck
    sf = "/root/testdata/sf0.001"
    con = duck(sf)
    for name in ("patch_files", "cascade_delete_files", "history_refresh"):
        df = catalog.QUERIES[name](spark, sf)
        want = con.execute(catalog.ORACLE[name])
        assert canon(df.columns, [tuple(r) for r in df.collect()])[1:] == canon([c[0] for c in want.description], want.fetchall())[1:], name
