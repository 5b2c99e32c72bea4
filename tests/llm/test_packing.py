import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ehrflow.llm import packing
from tests.llm.conftest import documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def ids(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_ids_are_the_tokenizers(text):
    assert packing.token_ids(text, PATH).tolist() == ids(text)[:-1]


def test_ids_of_odd_texts():
    assert packing.token_ids("a <|endoftext|> b", PATH).tolist() == [64, 220, 50256, 275]
    for text in ("<|endoftext|> x", "<|endoftext|>", "a<|endoftext|><|endoftext|>b <|endoftext", "<|endoftext|>" + "a" * 5000, "a" * 5000, " " * 3000 + "x", "\u00a0\u2003é\r\n\t 12345678", "ﬁ𝔘 ا ב"):
        assert packing.token_ids(text, PATH).tolist() == ids(text)[:-1]


def check(rows, capacity):
    """Sequences without gaps or overlaps."""
    of = defaultdict(list)
    for r in rows:
        of[r.sequence_id].append((r.offset, r.length))
    for parts in of.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(of)


def test_round_trip(spark):
    docs = documents(spark)
    rows = packing.pack(docs, PATH).collect()
    made = defaultdict(dict)
    for r in rows:
        made[r.doc_id][r.piece] = r
    for d in docs.collect():
        pieces = [made[d.doc_id][k] for k in sorted(made[d.doc_id])]
        assert np.concatenate([np.frombuffer(p.ids, "<u4") for p in pieces]).tolist() == ids(d.text)
        assert [p.start for p in pieces] == np.cumsum([0, *(p.length for p in pieces)])[:-1].tolist()
        assert all(p.length == 1024 for p in pieces[1:])
    total = sum(r.length for r in rows)
    assert check(rows, 1024) <= total / 1024 * 1.03 + 1
    digest = {(r.doc_id, r.piece): r.ids_crc32 for r in packing.pack(docs, PATH, keep_ids=False).collect()}
    assert digest == {(r.doc_id, r.piece): zlib.crc32(r.ids) for r in rows}


def test_edges(spark, edge_docs, edge_rows, no_docs):
    rows = packing.pack(edge_docs, PATH).collect()
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(r[0] for r in edge_rows)
    assert sum(r.length for r in rows) == sum(len(ids(r[1])) for r in edge_rows)
    assert [r.length for r in rows if r.doc_id == 1] == [1]
    check(rows, 1024)
    assert packing.pack(no_docs, PATH).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=40))
def test_plan_places_every_piece_once(counts):
    runs = packing.plan(counts, 40)
    at, used = defaultdict(int), defaultdict(list)
    for length, lo, hi, sequence, offset in runs:
        used[length].append((lo, hi))
        for k in range(hi - lo):
            at[sequence + k] += length
    for length, spans in used.items():
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] == counts[length]
    assert set(used) == set(counts) and all(n <= 40 for n in at.values())


def test_exact_complements_leave_no_gap():
    for lengths in ((600, 424), (500, 400, 124), (400, 300, 200, 124), (512, 512)):
        counts = Counter(lengths)
        runs = packing.plan({k: n * 1000 for k, n in counts.items()}, 1024)
        assert max(r[3] + r[2] - r[1] for r in runs) == 1000
