import random
import re
import string

from ehrflow.llm import secrets
from tests.llm.conftest import DOCS, documents

RUN = re.compile(r"(?<![A-Za-z0-9_+/\-])(?=[A-Za-z_+/\-]*[0-9]|A[KS]IA[A-Z]{16}(?![A-Za-z0-9_+/\-]))[A-Za-z0-9_+/\-]{16,}")


def _planted(n=400):
    r = random.Random(3)
    vocabulary = ["".join(r.choice("etaoinshr") for _ in range(r.randint(2, 9))) for _ in range(300)]
    rows, secret, harmless = [], {}, {}
    for i in range(n):
        text = [r.choice(vocabulary) for _ in range(40)]
        kind = i % 8
        if kind == 0:
            v = "".join(r.choice("0123456789abcdef") for _ in range(40))
            text[20], secret[i] = f'token = "{v}"', v
        elif kind == 1:
            v = "AKIA" + "".join(r.choice(string.ascii_uppercase + "234567" * (i % 16 > 1)) for _ in range(16))
            text[20], secret[i] = v, v
        elif kind == 2:
            v = "".join(r.choice("0123456789abcdef") for _ in range(17)) + "1"
            text[20], secret[i] = f"password={v}", v
        elif kind == 3:
            text[20] = harmless[i] = "".join(r.choice(string.digits) for _ in range(16))
        elif kind == 4:
            harmless[i] = "/".join(r.choice(vocabulary) for _ in range(5)) + "/page12345678"
            text[20] = "https://host.example/" + harmless[i]
        rows.append((i, " ".join(text), "en", "s", None))
    return rows, secret, harmless


def test_planted_findings(spark):
    rows, secret, harmless = _planted()
    docs = spark.createDataFrame(rows, DOCS)
    found = secrets.scan(docs).collect()
    yes = {(r.doc_id, r.value) for r in found if r.is_secret}
    assert {d for d, v in yes} == set(secret) and all(secret[d] == v for d, v in yes)
    texts = {r[0]: r[1] for r in rows}
    assert all(texts[r.doc_id][r.start:r.start + r.length] == r.value for r in found)
    masked = {r.doc_id: r for r in secrets.masked(docs).collect()}
    assert len(masked) == len(rows)
    for i, text, *_ in rows:
        want = text.replace(secret[i], "[SECRET]") if i in secret else text
        assert masked[i].text == want and masked[i].n_chars == (len(want) if i in secret else None)


def test_named_values_of_any_length_and_characters(spark):
    rows, secret, _ = _planted()
    cases = [('password = "Tr0ub4dor&3"', "Tr0ub4dor&3"), ("api_key=hunter2hunter2", "hunter2hunter2"), ("secret: correcthorsebatterystaple,", "correcthorsebatterystaple"),
             ("PWD='a.b~c!d@e'", "a.b~c!d@e"), ("see postgres://svc:p4ss.w0rd!@db.example/x", "p4ss.w0rd!"), ("pwd=x7 and x7 again", "x7")]
    more = [(1000 + i, f"before it {text} after it", "en", "s", None) for i, (text, _) in enumerate(cases)]
    docs = spark.createDataFrame(rows + more, DOCS)
    found = {(r.doc_id, r.value) for r in secrets.scan(docs).collect() if r.is_secret}
    assert found == set(secret.items()) | {(1000 + i, v) for i, (_, v) in enumerate(cases)}
    masked = {r.doc_id: r.text for r in secrets.masked(docs).collect()}
    assert all(masked[d] == t.replace(cases[d - 1000][1], "[SECRET]", 1) for d, t, *_ in more)


def test_candidates_equal_brute_force(spark, edge_docs, edge_rows, no_docs):
    docs = documents(spark, "0.01")
    found = sorted((r.doc_id, r.start, r.value) for r in secrets.candidates(docs).collect())
    assert found == sorted((d.doc_id, m.start(), m.group()) for d in docs.collect() for m in RUN.finditer(d.text or ""))
    odd = [(1, "é😀 aaaaaaaaaaaaaaa1 x bbbbbbbbbbbbbbbb2", None, None, None), (None, "c" * 30 + "9", None, None, None), (2, "d" * 700 + "1 AKIA" + "Q" * 16 + " AKIA" + "Q" * 17, None, None, None)] * 2
    got = sorted((r.doc_id or 0, r.start, r.value) for r in secrets.candidates(spark.createDataFrame(odd, DOCS)).collect())
    assert got == sorted([(1, 3, "a" * 15 + "1"), (1, 22, "b" * 16 + "2"), (0, 0, "c" * 30 + "9"), (2, 0, "d" * 700 + "1"), (2, 702, "AKIA" + "Q" * 16)] * 2)
    assert secrets.scan(no_docs).count() == 0 and secrets.masked(no_docs).count() == 0
    kept = secrets.masked(edge_docs)
    assert kept.columns == edge_docs.columns and kept.count() == len(edge_rows)


def test_plans_have_no_python(spark, capsys):
    for df in (secrets.scan(documents(spark)), secrets.masked(documents(spark))):
        df.explain()
        assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def test_copies_do_not_change_a_verdict(spark):
    """An unnamed key in 4, 5 or 50 rows, as copies of a text and in texts of
    their own."""
    rows, *_ = _planted()
    key = "qwNvTk8sBmZpLxGh3RtYcWd5JfKv1Qa"
    seen = set()
    for n in (1, 4, 5, 50):
        for texts in ([f"see {key} there"] * n, [f"note{i} see {key} there {i}" for i in range(n)]):
            docs = spark.createDataFrame(rows + [(5000 + i, t, "en", "s", None) for i, t in enumerate(texts)], DOCS)
            found = [(r.is_secret, round(r.score, 6)) for r in secrets.scan(docs).collect() if r.value == key]
            assert len(found) == n
            seen |= set(found)
    assert len({s for s, _ in seen}) == 1 and max(p for _, p in seen) - min(p for _, p in seen) < 0.25


def test_the_mark_in_a_text(spark):
    rows, *_ = _planted()
    odd = "a \x00\x01 token=abcdefgh12345678 \x00\x01 end and abcdefgh12345678 twice"
    docs = spark.createDataFrame(rows + [(7000, odd, "en", "s", 3)], DOCS)
    assert [(r.start, r.value) for r in secrets.candidates(docs).filter("doc_id = 7000").orderBy("k").collect()] == [(11, "abcdefgh12345678"), (odd.rindex("abcdefgh"), "abcdefgh12345678")]
    assert secrets.masked(docs).filter("doc_id = 7000").first().text == odd.replace("abcdefgh12345678", "[SECRET]")


def test_very_many_secrets_in_a_text(spark):
    import time
    r = random.Random(9)
    values = ["".join(r.choice("0123456789abcdef") for _ in range(24)) for _ in range(4000)]
    rows, *_ = _planted(200)
    text = " and ".join(f"password={v} x" for v in values)
    docs = spark.createDataFrame(rows + [(9000, text, "en", "s", None)], DOCS)
    at = time.time()
    got = secrets.masked(docs).filter("doc_id = 9000").first().text
    assert got.count("[SECRET]") == len(values) and not any(v in got for v in values) and time.time() - at < 60
