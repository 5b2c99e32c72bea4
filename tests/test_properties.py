"""Randomised comparisons of the scalar rules with plain-Python models."""

import datetime as dt
import random
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from ehrflow.functions import scalars as S


def test_age_matches_python_rule(spark):
    rnd = random.Random(11)
    base = dt.date(1900, 1, 1)
    rows = []
    for _ in range(400):
        dob = base + dt.timedelta(days=rnd.randint(0, 45000))
        asof = dob + dt.timedelta(days=rnd.randint(0, 40000))
        rows.append((dob, asof))
    rows += [(dt.date(2004, 2, 29), dt.date(y, 2, d)) for y in range(2005, 2030) for d in (28,)]
    df = spark.createDataFrame(rows, "dob date, asof date")
    got = [r.a for r in df.select(S.age_years("dob", F.col("asof")).alias("a")).collect()]
    want = [a.year - d.year - ((a.month, a.day) < (d.month, d.day)) for d, a in rows]
    assert got == want


def test_local_time_matches_zoneinfo(spark):
    rnd = random.Random(5)
    utc, bog = ZoneInfo("UTC"), ZoneInfo("America/Bogota")
    rows = [dt.datetime(1950, 1, 1) + dt.timedelta(seconds=rnd.randint(0, 80 * 365 * 86400)) for _ in range(400)]
    rows += [dt.datetime(1992, 5, 3, h) for h in range(24)] + [dt.datetime(1993, 4, 4, h) for h in range(24)]
    df = spark.createDataFrame([(r,) for r in rows], "ts timestamp_ntz")
    got = [r.l for r in df.select(S.to_local("ts").alias("l")).collect()]
    want = [r.replace(tzinfo=utc).astimezone(bog).replace(tzinfo=None) for r in rows]
    assert got == want


def test_split_codes_matches_trimmed_split(spark):
    rnd = random.Random(3)
    alphabet = ["A01", "E11.9", " ", "\t", ",", "I10", ""]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 8))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.c for r in df.select(S.split_codes("t").alias("c")).collect()]
    assert got == [[x.strip() for x in t.split(",")] for t in texts]


def test_falsy_or_and_escape(spark):
    rnd = random.Random(9)
    vals = [rnd.choice([None, "", "a", "<b>", "x&y", "'q'", '"d"']) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    out = df.select(S.falsy_or("v", "--").alias("f"), S.html_escape("v").alias("h")).collect()
    import html
    assert [r.f for r in out] == [v or "--" for v in vals]
    assert [r.h for r in out] == [None if v is None else html.escape(v).replace("&#x27;", "&#39;").replace("&quot;", "&#34;")
                                  for v in vals]


def test_results_do_not_depend_on_session_zone(spark):
    """A wall time inside New York's 1996 daylight-saving gap formats and
    converts the same whatever the session time zone."""
    df = spark.createDataFrame([(dt.datetime(1996, 4, 7, 2, 26, 7, 120),), (dt.datetime(1996, 4, 7, 7, 26),)],
                               "ts timestamp_ntz")

    def run():
        return [tuple(r) for r in df.select(
            S.fmt("ts", "stamp"), S.fmt("ts", "iso_micros"), S.fmt("ts", "clock"), S.fmt("ts", "long_date"),
            S.fmt(S.to_local("ts"), "stamp"), S.fmt(S.ntz_lit(dt.datetime(2024, 1, 31, 15, 30)), "stamp")).collect()]

    base = run()
    assert base[0][:4] == ("07/04/1996 02:26", "1996-04-07 02:26:07.000120", "02:26 AM", "07 de April, 1996")
    assert base[1][4] == "07/04/1996 02:26" and base[0][5] == "31/01/2024 15:30"
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert run() == base
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_first_per_matches_python(spark):
    from ehrflow.operators.lookup import first_per
    rnd = random.Random(31)
    rows = [(rnd.choice("abcde"), i, rnd.randint(0, 9)) for i in range(300)]     # (group, unique order, value)
    df = spark.createDataFrame(rows, "g string, o long, v long")
    for desc in (False, True):
        got = sorted(tuple(r) for r in first_per(df, ["g"], ["o"], descending=desc).collect())
        want = {}
        for g, o, v in rows:
            if g not in want or (o > want[g][0] if desc else o < want[g][0]):
                want[g] = (o, v)
        assert got == sorted((g, o, v) for g, (o, v) in want.items())
