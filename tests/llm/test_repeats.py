import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheafwork.llm import repeats as R
from sheafwork.llm.suffixes import suffix_array, suffix_array_of_bytes
from tests.llm.helpers import corpus, documents, empty


@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array(seq):
    assert suffix_array(np.array(seq, np.int64)).tolist() == sorted(range(len(seq)), key=lambda i: seq[i:])


@settings(max_examples=300)
@given(st.lists(st.sampled_from(b"ab\xff"), max_size=80) | st.integers(0, 40).map(lambda n: [97] * n))
def test_suffix_array_of_bytes(data):
    data = bytes(data) + b"\xfe"
    order = suffix_array_of_bytes(np.frombuffer(data, np.uint8)).tolist()
    assert order == sorted(range(len(data)), key=lambda i: data[i:])


@settings(max_examples=150)
@given(st.lists(st.sampled_from(b"ab"), min_size=1, max_size=70))
def test_matching_statistics(data):
    data = bytes(data)
    got = R.RunLengthIndex(data).statistics()
    for i in range(len(data)):
        best = 0
        for j in range(len(data)):
            if i != j:
                n = 0
                while max(i, j) + n < len(data) and data[i + n] == data[j + n]:
                    n += 1
                best = max(best, n)
        assert got[i] == best


def expected(rows, length):
    seen = {}
    for _, t in rows:
        b = (t or "").encode()
        for a in range(len(b) - length + 1):
            seen[b[a : a + length]] = seen.get(b[a : a + length], 0) + 1
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for a in range(len(b) - length + 1):
            if seen[b[a : a + length]] > 1:
                gone[a : a + length] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((str(i), len(b), int(gone.sum()), len(R.runs_of(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("block", [900_000, 40])
def test_report_matches_brute_force(spark, block):
    rows = corpus(4) + [(500, "xyz" * 60), (501, "q" * 300)]
    rows.append((502, corpus(4)[-2][1][30_000:]))  # the second half of the long text
    rows += [rows[0], rows[1], (rows[2][0], "another text " * 20), (None, rows[3][1])]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in R.repeat_report(documents(spark, rows), length=90, block_bytes=block).collect())
    assert got == expected(rows, 90)


def test_identifiers_of_text(spark):
    rows = [(i, t) for i, t in corpus(4) if t is None or len(t) < 5000] + [(7, None), (None, "xyz" * 60)]
    docs = documents(spark, rows).withColumn("doc_id", F.concat(F.lit("doc "), F.col("doc_id")))
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in R.repeat_report(docs, length=90).collect())
    assert got == sorted((f"doc {i}" if i != "None" else i, *rest) for i, *rest in expected(rows, 90))


def test_parts_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(R, "PART", 37)
    rows = [(i, t) for i, t in corpus(4) if t is None or len(t) < 3000]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in R.repeat_report(documents(spark, rows), length=90).collect())
    assert got == expected(rows, 90)


def test_kept_bytes_and_spans(spark):
    rows = [(1, "-" + "abcdefghij" * 10 + "+"), (2, "abcdefghij" * 10)]
    out = {r.doc_id: r for r in R.without_repeats(documents(spark, rows), length=50).collect()}
    assert bytes(out[1].kept) == b"-+" and bytes(out[2].kept) == b""
    assert [(s.a, s.b) for s in out[1].spans] == [(1, 101)]


def test_empty_table(spark):
    assert R.repeat_report(empty(spark)).count() == 0
