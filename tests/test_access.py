import datetime as dt
import random

from ehrflow.operators import access as A

USERS = "documento_id long, tipo_usuario string"


def test_access_outcomes_order(spark):
    users = spark.createDataFrame([(1, "medico"), (2, "paciente"), (3, "admisionista"), (4, None)], USERS)
    patients = spark.createDataFrame([(2,), (5,)], "documento_id long")
    req = spark.createDataFrame([
        (1, 99, "exportar", 2),             # unknown user
        (2, 4, "exportar", 2),              # null role
        (3, 3, "exportar", 2),              # role not allowed
        (4, 2, "exportar", 5),              # other patient's record
        (5, 2, "exportar", 2),              # own record
        (6, 1, "exportar", 7),              # clinician, no such patient
        (7, 1, "consulta_medico", 5),
        (8, 2, "pagina_paciente", 999),     # no target check
        (9, 3, "admision_consulta", 8),
    ], "solicitud_id long, principal_id long, accion string, documento_id long")
    out = {r.solicitud_id: r.estado for r in A.access_outcomes(req, users, patients).collect()}
    assert out == {1: 401, 2: 403, 3: 403, 4: 403, 5: 200, 6: 404, 7: 200, 8: 200, 9: 404}
    rows = {r.solicitud_id for r in A.visible_rows(req.filter("accion = 'exportar'"), users).collect()}
    assert rows == {5, 6}


def test_visible_columns_never_hash(spark):
    df = spark.createDataFrame([(1, "h", "x")], "documento_id long, hashed_password string, primer_nombre string")
    for role in ("medico", "admisionista", "paciente"):
        assert "hashed_password" not in A.visible_columns(df, role).columns


def brute(requests, logins, ttl):
    out = {}
    for rid, u, ts in requests:
        prior = [lt for lu, lt in logins if lu == u and lt <= ts]
        if not prior:
            out[rid] = None
            continue
        last = max(prior)
        exp = (last + dt.timedelta(minutes=ttl)).replace(microsecond=0)
        out[rid] = last if ts.replace(microsecond=0) <= exp else None
    return out


def run(spark, requests, logins, ttl=30):
    r = spark.createDataFrame(requests, "solicitud_id long, usuario long, ts timestamp_ntz")
    lg = spark.createDataFrame(logins, "usuario long, login_ts timestamp_ntz")
    return {x.solicitud_id: x.login_ts for x in A.authorised_requests(r, lg, ttl).collect()}


def test_token_window_edges(spark):
    t0 = dt.datetime(2024, 1, 1, 10, 0, 0, 500000)
    logins = [(1, t0), (2, t0), (2, t0 + dt.timedelta(minutes=20))]
    reqs = [(1, 1, t0 - dt.timedelta(seconds=1)),                      # before login
            (2, 1, t0),                                               # same instant
            (3, 1, t0 + dt.timedelta(minutes=29)),
            (4, 1, t0 + dt.timedelta(minutes=30)),                    # exactly 30 min
            (5, 1, t0 + dt.timedelta(minutes=30, microseconds=400000)),  # same whole second
            (6, 1, t0 + dt.timedelta(minutes=31)),
            (7, 2, t0 + dt.timedelta(minutes=45))]                    # second login in between
    got = run(spark, reqs, logins)
    assert got == brute(reqs, logins, 30)
    assert got[1] is None and got[4] == t0 and got[5] == t0 and got[6] is None
    assert got[7] == t0 + dt.timedelta(minutes=20)


def test_token_window_random(spark):
    rnd = random.Random(3)
    base = dt.datetime(2024, 1, 1)
    logins = [(rnd.randint(0, 3), base + dt.timedelta(seconds=rnd.randint(0, 20000))) for _ in range(40)]
    reqs = [(i, rnd.randint(0, 3), base + dt.timedelta(seconds=rnd.randint(0, 20000), microseconds=rnd.randint(0, 999999)))
            for i in range(300)]
    assert run(spark, reqs, logins) == brute(reqs, logins, 30)


def test_token_window_hot_user(spark):
    """One user with thousands of logins and requests inside one window: the
    answer is exact and no (request, login) pairs are formed."""
    import bisect
    rnd = random.Random(17)
    base = dt.datetime(2024, 1, 1, 12)
    logins = sorted(base + dt.timedelta(microseconds=rnd.randint(0, 20 * 60 * 10 ** 6)) for _ in range(3000))
    reqs = [(i, base + dt.timedelta(microseconds=rnd.randint(-10 ** 6, 40 * 60 * 10 ** 6))) for i in range(3000)]
    got = run(spark, [(i, 1, t) for i, t in reqs], [(1, t) for t in logins])
    want = {}
    for i, t in reqs:
        j = bisect.bisect_right(logins, t)
        last = logins[j - 1] if j else None
        ok = last is not None and t.replace(microsecond=0) <= (last + dt.timedelta(minutes=30)).replace(microsecond=0)
        want[i] = last if ok else None
    assert got == want


def test_token_window_second_edges(spark):
    """Requests and logins at x.999999 and x.000000 of neighbouring seconds,
    before and after 1970."""
    out = []
    for base in (dt.datetime(2024, 1, 1, 12), dt.datetime(1969, 12, 31, 23, 40)):
        login = base + dt.timedelta(microseconds=999_999)
        reqs = [(1, 1, login), (2, 1, login + dt.timedelta(microseconds=1)),
                (3, 1, login + dt.timedelta(minutes=30)), (4, 1, login + dt.timedelta(minutes=30, microseconds=1)),
                (5, 1, login - dt.timedelta(microseconds=1))]
        got = run(spark, reqs, [(1, login)])
        assert got == brute(reqs, [(1, login)], 30)
        out.append(got)
    assert out[0][3] is not None and out[0][4] is None and out[0][5] is None


def test_token_window_equals_brute_force(spark):
    """A user with very many events (also before 1970), equal times, NULL
    users: the latest login at or before the request decides."""
    from ehrflow.operators.access import authorised_requests
    rnd = random.Random(23)
    base = dt.datetime(1969, 12, 31, 22, 0)
    at = lambda: base + dt.timedelta(microseconds=rnd.choice([rnd.randrange(0, 4 * 3600 * 10 ** 6), rnd.randrange(0, 14400) * 10 ** 6]))
    logins = [(rnd.choice([1, 1, 1, 2, None]), at()) for _ in range(60)]
    requests = [(i, rnd.choice([1, 1, 2, 3, None]), rnd.choice([at(), logins[i % 60][1], logins[i % 60][1] + dt.timedelta(minutes=30)])) for i in range(300)]
    out = authorised_requests(spark.createDataFrame(requests, "solicitud_id long, usuario long, ts timestamp_ntz"),
                              spark.createDataFrame(logins, "usuario long, login_ts timestamp_ntz")).collect()
    got = {r.solicitud_id: (r.login_ts, r.autorizado) for r in out}
    for i, u, ts in requests:
        last = max((l for v, l in logins if v == u and u is not None and l <= ts), default=None)
        ok = last is not None and ts.replace(microsecond=0) <= (last + dt.timedelta(minutes=30)).replace(microsecond=0)
        assert got[i] == (last if ok else None, ok)
