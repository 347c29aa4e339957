import hashlib
import re

import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheafwork.llm import decontamination as D
from tests.llm.helpers import corpus, documents, empty, lower

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


@given(st.lists(st.integers(0, 4), max_size=50), st.lists(st.lists(st.integers(1, 6), min_size=1, max_size=4), min_size=1, max_size=5))
def test_index_finds_all_places(seq, patterns):
    index = D.FMIndex(np.array(seq, np.int64))
    width = max(map(len, patterns))
    table = np.array([p + [0] * (width - len(p)) for p in patterns])
    low, high = index.search(table, np.array(list(map(len, patterns))))
    for p, a, b in zip(patterns, low, high, strict=True):
        found = sorted(index.locate(np.arange(a, b)).tolist()) if b > a else []
        assert found == [i for i in range(len(seq) - len(p) + 1) if seq[i : i + len(p)] == p]


@given(st.lists(st.integers(0, 20), max_size=40), st.integers(0, 20))
def test_wavelet_ranks(seq, symbol):
    w = D.WaveletMatrix(np.array(seq, np.int64))
    if symbol < 1 << w.levels:
        at = np.arange(len(seq) + 1)
        assert w.rank(np.full(len(at), symbol), at).tolist() == [seq[:k].count(symbol) for k in range(len(seq) + 1)]


def benchmark(rows):
    base = [t for _, t in rows if t and len(t.split()) > 40]
    words = WORD.findall(lower(base[0]))
    return [(1, " ".join(words[3:20]).upper()), (2, " ".join(WORD.findall(lower(base[1]))[:14])), (3, "a B"), (4, "nowhere to be found at all in these texts my friend yes"), (5, None), (6, ""), (7, "one two three four five six seven eight nine ten eleven"), (2, "漢字 ünï"), (10, "in " * 12)]


def expected(rows, items, window):
    phrases = {}
    for item, t in items:
        w = WORD.findall(lower(t))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            phrases.setdefault(tuple(w[k : k + window]), set()).add(item)
    out = []
    for i, t in rows:
        w, hit, found = WORD.findall(lower(t)), set(), set()
        for n in set(map(len, phrases)):
            for k in range(len(w) - n + 1):
                if own := phrases.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        out.append((str(i), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_report_matches_brute_force(spark, monkeypatch):
    rows = corpus(5)
    rows += [rows[0], (None, rows[1][1])]
    items = benchmark(rows)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    rows_of = lambda df: sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect())
    docs = documents(spark, rows)
    want = expected(rows, items, 10)
    assert any(w[2] for w in want)
    assert rows_of(D.leak_report(docs, bench)) == want
    # The same in several blocks of items and in shards of a document each.
    monkeypatch.setattr(D, "SHARD_BYTES", 1)
    monkeypatch.setattr(D, "BLOCK_UNIT", 100)
    assert rows_of(D.leak_report(docs, bench, block_mb=1)) == want


def test_identifiers_of_text(spark):
    rows = [(1, "one two three four five"), (2, None), (3, "three four five six")]
    bench = spark.createDataFrame([("b", "two three four"), ("a", "three four five"), ("a", "three four five"), (None, "five six")], "item_id string, text string")
    docs = documents(spark, rows).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))
    out = {r.doc_id: r for r in D.find_leaks(docs, bench).collect()}
    assert out["d1"]["items"] == ["a", "b"] and out["d2"]["items"] == [] and out["d3"]["items"] == ["a"] and out["d3"].n_hit == 4
    report = {r.doc_id: r for r in D.leak_report(docs, bench).collect()}
    assert report["d1"].items_sha256 == hashlib.sha256(b"a,b").hexdigest()


def test_clean_text(spark):
    rows = [(1, "Say: One two, three FOUR five!"), (2, None), (3, "nothing")]
    bench = spark.createDataFrame([(1, "two three four")], "item_id long, text string")
    out = {r.doc_id: r for r in D.find_leaks(documents(spark, rows), bench, keep=["doc_id", "lang", "size"], clean=True).collect()}
    assert out[1].clean_text == "Say: One  five!" and out[2].clean_text is None and out[3].clean_text == "nothing"
    assert out[1].size == "clash"


def test_empty_tables(spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert D.leak_report(empty(spark), bench).count() == 0
    assert D.leak_report(documents(spark, [(1, "a b c")]), bench.filter("false")).first().n_hit == 0
