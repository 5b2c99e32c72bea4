import datetime as dt

from pyspark.sql import functions as F

from ehrflow.functions import scalars as S


def one(spark, expr, schema, row):
    return spark.createDataFrame([row], schema).select(expr.alias("x")).first()["x"]


def test_age_rule(spark):
    df = spark.createDataFrame([
        (dt.date(2004, 2, 29), dt.date(2023, 2, 28), 18),
        (dt.date(2004, 2, 29), dt.date(2024, 2, 29), 20),
        (dt.date(2000, 6, 1), dt.date(2024, 6, 1), 24),   # birthday today
        (dt.date(2000, 6, 2), dt.date(2024, 6, 1), 23),   # day before
        (None, dt.date(2024, 6, 1), None),
    ], "dob date, asof date, want int")
    got = df.select(S.age_years("dob", F.col("asof")).alias("a"), "want").collect()
    assert [r.a for r in got] == [r.want for r in got]


def test_display_age(spark):
    df = spark.createDataFrame([(None, 40), (dt.date(2000, 1, 1), 3)], "dob date, edad int")
    out = df.select(S.display_age("dob", "edad", dt.date(2024, 1, 1)).alias("a"),
                    S.display_age("dob", "edad", dt.date(2024, 1, 1), recompute=False).alias("s")).collect()
    assert [(r.a, r.s) for r in out] == [(40, 40), (24, 3)]


def test_local_time_and_formats(spark):
    df = spark.createDataFrame([(dt.datetime(1992, 6, 1, 0, 0),), (dt.datetime(2024, 1, 1, 0, 0, 7),)],
                               "ts timestamp_ntz")
    out = df.select(S.to_local("ts").alias("l")).select(
        F.date_format("l", "yyyy-MM-dd HH:mm:ss").alias("t"), S.fmt("l", "long_date").alias("ld"),
        S.fmt("l", "clock").alias("c"), S.fmt("l", "stamp").alias("s")).collect()
    assert out[0].t == "1992-05-31 20:00:00"   # daylight saving of 1992
    assert out[1].t == "2023-12-31 19:00:07"
    assert out[1].ld == "31 de December, 2023"
    assert out[1].c == "07:00 PM"
    assert out[0].s == "31/05/1992 20:00"


def test_vitals_parsing(spark):
    rows = [('{"fc": 78}',), ('{"fc": "78"}',), ('{"fc": "abc"}',), ("not json",), ("",), (None,), ("{}",),
            ('"{\\"fc\\": 61}"',), ('{"fc": 0}',)]
    df = spark.createDataFrame(rows, "s string")
    out = df.select(S.vital(S.parse_vitals("s"), "fc", "int").alias("fc"),
                    F.to_json(S.parse_json_or_empty("s")).alias("j")).collect()
    assert [r.fc for r in out] == [78, 78, None, None, None, None, None, 61, None]
    assert out[3].j == "{}"          # invalid -> empty object
    assert out[4].j is None          # '' -> nothing shown
    assert out[5].j is None


def test_codes(spark):
    df = spark.createDataFrame([("E11.9, I10",), ("E11.9,",), ("\tA01 ,B02\t",), (None,)], "c string")
    out = df.select(S.split_codes("c").alias("a")).select("a", S.join_codes("a").alias("j")).collect()
    assert out[0].a == ["E11.9", "I10"] and out[0].j == "E11.9, I10"
    assert out[1].a == ["E11.9", ""]
    assert out[2].a == ["A01", "B02"]
    assert out[3].a is None
    empty = spark.createDataFrame([([],), (["A", None],)], "a array<string>").select(S.join_codes("a").alias("j")).collect()
    assert empty[0].j is None and empty[1].j == "A"


def test_falsy_and_names(spark):
    df = spark.createDataFrame([(None, "", "300", 0, "juan", None, "PEREZ", "<a href='x'>&")],
                               "cel string, tel string, tel2 string, edad int, n1 string, n2 string, a1 string, t string")
    r = df.select(S.coalesce_falsy("cel", "tel", default="--").alias("c1"),
                  S.coalesce_falsy("cel", "tel2", default="--").alias("c2"),
                  S.falsy_or_number("edad", "--").alias("e"),
                  S.signature("n1", "n2").alias("sig"),
                  S.full_name("n1", "n2", "a1", None).alias("fn"),
                  S.capitalize("a1").alias("cap"),
                  S.html_escape("t").alias("h"),
                  S.blank_to_null("tel").alias("b")).first()
    assert r.c1 == "--" and r.c2 == "300"
    assert r.e == "--"
    assert r.sig == "Dr. juan None"
    assert r.fn == "juan  PEREZ "
    assert r.cap == "Perez"
    assert r.h == "&lt;a href=&#39;x&#39;&gt;&amp;"
    assert r.b is None


def test_export_name_and_iso(spark):
    df = spark.createDataFrame([(7, dt.datetime(2024, 3, 5, 3, 0), "2024-01-02T10:00:00")],
                               "id long, ts timestamp_ntz, iso string")
    r = df.select(S.export_name("id", S.to_local("ts")).alias("n"), S.iso_date_part("iso").alias("d"),
                  S.days_before("ts", 5).alias("m")).first()
    assert r.n == "HC_7_20240304.pdf"     # 03:00 UTC is the previous day in Bogota
    assert r.d == "2024-01-02"
    assert r.m == dt.datetime(2024, 2, 29, 3, 0)


def test_json_build_and_clean(spark):
    df = spark.createDataFrame([("a", None)], "x string, y string")
    r = df.select(S.json_object(ta=F.col("x"), fc=F.col("y")).alias("o"),
                  S.clean_vitals(F.create_map(F.lit("ta"), F.lit("120/80"), F.lit("fc"), F.lit(""))).alias("m"),
                  S.clean_vitals(F.create_map(F.lit("fc"), F.lit(""))).alias("e")).first()
    assert r.o == '{"ta":"a","fc":null}'
    assert r.m == {"ta": "120/80"}
    assert r.e is None


def test_unicode_space_long_text_and_years(spark):
    df = spark.createDataFrame([("\u00a0E11\u3000,\u2009 I10\ufeff", "x" * 5000 + "Y", dt.datetime(1995, 3, 4, 5, 6))], "c string, t string, ts timestamp_ntz")
    r = df.select(S.split_codes("c").alias("c"), S.capitalize("t").alias("t")).first()
    assert r.c == ["E11", "I10"] and r.t == "X" + "x" * 4999 + "y"
    year = spark.sql("SELECT make_timestamp_ntz(12345, 1, 2, 3, 4, 5) AS ts, make_timestamp_ntz(7, 1, 2, 3, 4, 5) AS old")
    assert list(year.select(S.fmt("ts", "compact"), S.fmt("old", "compact")).first()) == ["123450102", "00070102"]


def test_repeated_vitals_keys_keep_the_last(spark):
    df = spark.createDataFrame([('{"fc": 1, "ta": "a", "fc": 80}',), ('{"fc": 1, }',)], "v string")
    rows = df.select(S.parse_vitals("v").alias("v"), S.vitals_struct("v", ["fc"]).alias("s")).select(S.vital("v", "fc", "bigint").alias("fc")).collect()
    assert [r.fc for r in rows] == [80, None]
