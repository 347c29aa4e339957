import random

import numpy as np
import pytest
import xxhash
from hypothesis import given
from hypothesis import strategies as st

from sheafwork.llm import simhash as S
from tests.llm.helpers import corpus, documents, empty, lower


@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=4), st.integers(1, 4))
def test_masks_cover_all_pairs_in_the_radius(x, flips, radius):
    if len(flips) <= radius:
        y = x ^ sum(1 << b for b in flips)
        assert any(x & m == y & m for m in S.covering_masks(radius))


def fingerprint(text):
    import re

    w = [x.encode() for x in re.split("[\x20\x09-\x0d]+", lower(text)) if x]
    shingles = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def components(ids, linked):
    parent = dict(enumerate(range(len(ids))))
    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                S.unite(parent, i, j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(S.root(parent, i), []).append(ids[i])
    smallest = {r: min((x for x in g if x is not None), default=None) for r, g in groups.items()}
    return [smallest[S.root(parent, i)] for i in range(len(ids))]


@pytest.mark.parametrize("limit", [4096, 1])
def test_groups_match_brute_force(spark, limit):
    rows = corpus(6)
    r = random.Random(1)
    base = " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(300)).split()
    for k in range(25):  # a chain of near copies
        base[r.randrange(300)] = f"w{k}"
        rows.append((2000 + k, " ".join(base)))
    rows += rows[:2] + [(None, rows[3][1]), (None, "only this one has no number")]
    out = S.near_groups(documents(spark, rows), bucket_limit=limit).collect()
    prints = [fingerprint(t) for _, t in rows]
    want = components([i for i, _ in rows], lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    assert sorted((str(x.doc_id), x.fingerprint, str(x.component_id)) for x in out) == sorted((str(i), f"{p:016x}", str(c)) for (i, _), p, c in zip(rows, prints, want, strict=True))


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_large_buckets_by_points(spark, radius):
    r, rows = random.Random(2), []
    base = r.getrandbits(64)
    for k in range(60):
        base ^= sum(1 << b for b in r.sample(range(64), r.randint(1, 4)))
        rows.append((k, S.signed(base)))
    out = {x.node: x.component for x in S.components(S.large_buckets(spark.createDataFrame(rows, "node long, fp long"), radius)).collect()}
    want = components([i for i, _ in rows], lambda i, j: ((rows[i][1] ^ rows[j][1]) & (1 << 64) - 1).bit_count() <= radius)
    assert {i: out.get(i, i) for i, _ in rows} == dict(enumerate(want)) and len(set(want)) > 3


def edited(r, words, kind):
    n, k = len(words), len(words) // 10
    if kind == "append":
        return words + [f"new{r.random()}" for _ in range(k)]
    if kind == "truncate":
        return words[: n - k]
    at = r.randrange(k, n - 2 * k)
    if kind == "block":
        return words[:at] + [f"new{r.random()}" for _ in range(k)] + words[at + k :]
    return [f"new{r.random()}" if i % 50 == 7 else w for i, w in enumerate(words)]


@pytest.mark.parametrize("few", [16, 1])
def test_all_kinds_of_edits_are_linked(spark, few):
    r, rows = random.Random(3), corpus(7)
    for k in range(80):
        words = [f"{r.choice('abcdefghij')}{r.randrange(400)}" for _ in range(r.randint(80, 500))]
        rows += [(1000 + 2 * k, " ".join(words)), (1001 + 2 * k, " ".join(edited(r, words, ["append", "truncate", "block", "word"][k % 4])))]
    sets = [S.shingle_set(b" ".join(S.word_list((t or "").encode())), 5) for _, t in rows]
    sets = [set(x.tolist()) for x in sets]
    want = components([i for i, _ in rows], lambda i, j: (len(sets[i] & sets[j]) / len(sets[i] | sets[j]) if sets[i] | sets[j] else 1) >= 0.8)
    groups = {}
    for x in S.similar_groups(documents(spark, rows), similar=S.Similar(few=few, block=8)).collect():
        groups.setdefault(x.component, []).append(x.id)
    assert {i: min(g) for g in groups.values() for i in g} == {i: c for (i, _), c in zip(rows, want, strict=True)}
    assert sum(c != i for (i, _), c in zip(rows, want, strict=True)) > 50


def test_components_of_long_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 150)] + [(200, 201), (201, 200), (300, 300)]
    out = {r.node: r.component for r in S.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 150)} | {200: 200, 201: 200}


def test_one_of_each_group_stays(spark):
    rows = corpus(8)
    rows += [rows[0], (None, "without a number"), (None, "another without a number"), (rows[3][0], "a number that comes twice")]
    docs = documents(spark, rows)
    out = S.similar_dedup(docs)
    assert out.columns == docs.columns
    groups = {}
    for g in S.similar_groups(docs).collect():
        groups.setdefault(g.component, set()).add((g.id is None, g.id, g.key))
    least = sorted(str(min(g, key=lambda x: (x[0], x[1] or 0, x[2]))[1]) for g in groups.values())
    assert sorted(str(r.doc_id) for r in out.collect()) == least
    assert least.count("None") == 2 and least.count("3") == 2


def test_a_large_group_among_others(spark):
    """A bucket of very many copies with some texts that aren't alike, in blocks of two."""
    r = random.Random(4)
    base = [f"w{r.randrange(900)}" for _ in range(300)]
    rows = [(k, " ".join(base[:k] + [f"own{k}"] + base[k + 1 :])) for k in range(60)]
    rows += [(100 + k, " ".join(base[: 270 - k] + [f"end{r.random()}" for _ in range(30 + k)])) for k in range(0, 60, 3)]
    sets = [set(S.shingle_set(t.encode(), 5).tolist()) for _, t in rows]
    want = components([i for i, _ in rows], lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    groups = {}
    for x in S.similar_groups(documents(spark, rows), similar=S.Similar(few=2, bands=210, rows=1, block=2)).collect():
        groups.setdefault(x.component, []).append(x.id)
    assert {i: min(g) for g in groups.values() for i in g} == {i: c for (i, _), c in zip(rows, want, strict=True)}


def test_text_identifiers(spark):
    docs = spark.createDataFrame([("b", "one two three four"), ("a", "one two three four"), (None, "one two three four"), ("c", "else")], "doc_id string, text string")
    assert sorted((str(x.doc_id), x.component_id) for x in S.near_groups(docs).collect()) == [("None", "a"), ("a", "a"), ("b", "a"), ("c", "c")]
    assert {x.doc_id for x in S.similar_dedup(docs).collect()} == {"a", "c"}


def test_long_texts_are_counted_whole():
    words = [f"w{k}" for k in range(10_000)]
    hashes = np.array([xxhash.xxh64_intdigest(w.encode(), 42) for w in words], ">u8").view(np.uint8)
    assert S.majority(hashes, 64) == np.packbits(2 * np.unpackbits(hashes).reshape(-1, 64).sum(0) > len(words)).tobytes()


def test_empty_table(spark):
    assert S.near_groups(empty(spark)).count() == 0
