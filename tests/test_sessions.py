import datetime as dt
import os

from ehrflow.operators.access import authorised_requests
from ehrflow.streaming import sessions

REQ, LOG = "solicitud_id long, usuario long, ts timestamp_ntz", "usuario long, login_ts timestamp_ntz"
DAY = dt.datetime(2024, 1, 1)


def at(minutes, micros=0):
    return DAY + dt.timedelta(minutes=minutes, microseconds=micros)


def run(spark, root, steps):
    """Each step appends requests and logins and runs the query to its end;
    returns the rows so far and the last progress."""
    streams = {n: spark.readStream.schema(s).parquet(os.path.join(root, n)) for n, s in (("requests", REQ), ("logins", LOG)) if not os.makedirs(os.path.join(root, n), exist_ok=True)}
    for requests, logins in steps:
        for name, schema, rows in (("requests", REQ, requests), ("logins", LOG, logins)):
            if rows:
                spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(os.path.join(root, name))
        out = sessions.authorised_stream(streams["requests"], streams["logins"], 30, delay="1 hour")
        query = sessions.write_authorised(out, os.path.join(root, "out"), os.path.join(root, "ck"))
        query.awaitTermination()
    got = {r.solicitud_id: (r.login_ts, r.autorizado) for r in spark.read.schema(out.schema).parquet(os.path.join(root, "out")).collect()}
    return got, query.recentProgress


def test_late_logins_ttl_and_state(spark, tmp_dir):
    requests = [(1, 7, at(10)), (2, 7, at(30, 900_000)), (3, 7, at(31)), (4, 8, at(5)), (5, 7, at(12)), (6, None, at(12)), (7, 7, at(0))]
    logins = [(7, at(0, 500_000)), (7, at(11)), (7, at(11))]
    late = [(8, at(4))]                                                       # arrives a run after its request, within the delay
    got, _ = run(spark, tmp_dir, [(requests, logins), ([], late), ([(8, 8, at(300))], [(9, at(300))]), ([(9, 8, at(5000))], [(9, at(5000))])])
    assert got == {1: (at(0, 500_000), True), 2: (at(11), True), 3: (at(11), True), 4: (at(4), True), 5: (at(11), True), 6: (None, False), 7: (None, False), 8: (None, False)}
    batch = authorised_requests(spark.createDataFrame([*requests, (8, 8, at(300))], REQ), spark.createDataFrame([*logins, *late, (9, at(300))], LOG), 30)
    assert got == {r.solicitud_id: (r.login_ts, r.autorizado) for r in batch.collect()}


def test_the_end_of_the_ttl_is_in_whole_seconds(spark, tmp_dir):
    got, _ = run(spark, tmp_dir, [([(1, 1, at(30, 999_999)), (2, 1, at(30) + dt.timedelta(seconds=1))], [(1, at(0))]), ([(3, 1, at(900))], [(2, at(900))])])
    assert got == {1: (at(0), True), 2: (None, False)}


def test_state_is_bounded(spark, tmp_dir):
    """Hours of events, an hour a run: what is kept does not grow."""
    steps = [([(100 * h + k, k % 5, at(60 * h + k)) for k in range(50)], [(k, at(60 * h + k)) for k in range(5)]) for h in range(7)]
    got, progress = run(spark, tmp_dir, steps)
    kept = sum(s["numRowsTotal"] for s in progress[-1]["stateOperators"])
    assert len(got) >= 200 and kept < 4 * 55


def test_equal_to_the_batch_rule(spark):
    from ehrflow.plans import catalog
    sf = "/root/testdata/sf0.001"
    rows = lambda name: sorted(map(tuple, catalog.QUERIES[name](spark, sf).select("solicitud_id", "usuario", "ts", "login_ts", "autorizado").collect()))
    assert rows("authorised_stream") == rows("authorised_asof")
