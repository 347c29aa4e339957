import hashlib

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheafwork.llm.exact_dedup import PatriciaTrie, exact_dedup, exact_owners, shared_prefix
from tests.llm.helpers import corpus, documents, empty


@given(st.lists(st.binary(max_size=6)), st.integers(1, 5000))
def test_trie_finds_equal_strings(strings, budget):
    trie, seen, out = PatriciaTrie(), {}, []
    for i, s in enumerate(strings):
        terminal, new = trie.find(s, i)
        terminal.merge(1, i, i)
        assert new == (s not in seen)
        assert terminal.copy == seen.setdefault(s, i)
        while trie.size > budget:
            before = trie.size
            for text, t in trie.spill():
                out.append((text, t.rows))
                del seen[text]
            assert trie.size < before
    out += [(text, t.rows) for text, t in trie.drain()]
    assert sum(n for _, n in out) == len(strings)
    assert {s for s, _ in out} == set(strings)


@given(st.binary(), st.binary())
def test_shared_prefix(a, b):
    n = shared_prefix(a, b)
    assert a[:n] == b[:n] and (n == min(len(a), len(b)) or a[n] != b[n])


def expected(rows, keep):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    pick = {t: keep(x for x in g if x is not None) if any(x is not None for x in g) else None for t, g in groups.items()}
    return sorted((str(i), str(pick[t or ""]), len(groups[t or ""]), i == pick[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


def rows_of(df):
    return sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in df.collect())


def test_owners_match_brute_force(spark):
    rows = corpus()
    rows += rows[:3] + [(None, "a"), (None, None)]  # repeated rows, rows without an identifier
    docs = documents(spark, rows)
    assert rows_of(exact_owners(docs, keep="largest")) == expected(rows, max)
    assert rows_of(exact_owners(docs, keep="smallest", trie_mb=0)) == expected(rows, min)


def test_identifiers_of_text(spark):
    rows = [(None if i is None else f"k\n{i:03}", t) for i, t in [*corpus(), (None, "a"), (7, "a")]]
    docs = documents(spark, corpus()[:1]).limit(0).drop("doc_id").withColumn("doc_id", F.lit(""))
    docs = docs.unionByName(spark.createDataFrame(rows, "doc_id string, text string").repartition(3), allowMissingColumns=True)
    assert rows_of(exact_owners(docs, keep="largest")) == expected(rows, max)
    assert rows_of(exact_owners(docs, keep="smallest", trie_mb=0)) == expected(rows, min)


def test_rows_that_stay(spark):
    rows = corpus()
    docs = documents(spark, rows)
    out = exact_dedup(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted({min(i for i, t in rows if (t or "") == (u or "")) for _, u in rows})


def test_empty_table(spark):
    assert exact_owners(empty(spark)).count() == 0
