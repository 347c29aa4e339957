import random
import zlib

import numpy as np

from sheafwork.llm import mixing as M
from tests.llm.helpers import documents, empty, sentence


def labelled_rows(n=800):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        text = " ".join(sentence(r) for _ in range(r.randint(2, 12)))
        kind = r.choices(["good", "poor", "toxic"], [0.7, 0.15, 0.15])[0]
        if kind == "poor":
            text = text.upper().replace(" ", "!! ")
        if kind == "toxic":
            text = text.replace(" ", f" {r.choice(['vileword', 'badname'])} ", 2)
        rows.append((i, text))
        if i % 2:
            labels.append((i, int(kind != "poor"), int(kind == "toxic")))
    return rows, labels


SCHEMA = "doc_id long, quality int, toxic int"


def test_targets_are_met(spark):
    rows, labels = labelled_rows()
    rows += [(9000, None), (9001, ""), (None, "some words here")]
    targets = {"good": 0.6, "poor": 0.3, "toxic": 0.1}
    out = M.mixed(documents(spark, rows), spark.createDataFrame(labels, SCHEMA), targets).collect()
    assert len(out) == len(rows)
    total = sum(r.tokens for r in out)
    for d in M.DOMAINS:
        assert abs(sum(r.rate * r.tokens * r[d] for r in out) / total - targets[d]) < 0.02
    assert all(r.rate >= 0 and abs(r.good + r.poor + r.toxic - 1) < 1e-9 and r.copies in (int(r.rate), int(r.rate) + 1) for r in out)
    by = {r.doc_id: r for r in out}
    assert by[9000].tokens == 0 and by[9001].tokens == 0
    assert all((by[i].toxic > 0.5) == ("vileword" in t or "badname" in t) for i, t in rows[:800])


def test_posteriors_match_plain_counts(spark):
    rows, labels = labelled_rows(300)
    table = spark.createDataFrame(labels, SCHEMA)
    out = {r.doc_id: r for r in M.mixed(documents(spark, rows), table, {"good": 0.8, "poor": 0.1, "toxic": 0.1}).collect()}
    text = {i: t.encode() for i, t in rows}
    known = [x for x in sorted(labels) if zlib.crc32(str(x[0]).encode()) % 5]
    sides = [[set(M.words_of(text[i])) for i, _, toxic in known if toxic == side] for side in (0, 1)]
    weights = {}
    for w in set().union(*sides[1]):
        n0, n1 = (sum(w in words for words in side) for side in sides)
        if n1 >= max(5, -(-len(sides[1]) // 400)):
            weights[w] = np.log((n1 + 0.5) / (len(sides[1]) + 1)) - np.log((n0 + 0.5) / (len(sides[0]) + 1))
    assert {b"vileword", b"badname"} <= set(weights)
    model = M.Membership(weights, M.table_of([text[i] for i, _, _ in known], weights), np.array([float(q) for _, q, _ in known]), np.array([float(t) for _, _, t in known]))
    want = model.posteriors([t for _, t in sorted(text.items())])
    got = np.array([[out[i][d] for d in M.DOMAINS] for i in sorted(text)])
    assert np.abs(got - want).max() < 1e-6


def test_steps_find_the_least_squares(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.4] * 3, 60)
    tokens = rng.integers(5, 60, 60)
    table = spark.createDataFrame([(int(t), *map(float, x)) for t, x in zip(tokens, p, strict=True)], "tokens long, good double, poor double, toxic double")
    targets, pull = {"good": 1.5, "poor": 0.0, "toxic": 0.1}, 1e-3
    steps, scale = M.fit_rates(table, targets, pull=pull, most_steps=150, tolerance=0.0, anchor=None)
    rate = M.rates_after(p, steps, pull, scale)[0]
    # At the least squares, gradients are zero where rates are positive, and not negative where they are zero.
    total = tokens.sum()
    g = p @ (((rate * tokens) @ p - np.array([targets[d] for d in M.DOMAINS]) * total) / total) + pull * (rate - 1)
    assert (rate >= 0).all() and np.abs(g[rate > 1e-9]).max() < 2e-3 and g[rate <= 1e-9].min(initial=0) > -2e-3


def test_rows_are_taken(spark):
    rows, labels = labelled_rows()
    docs = documents(spark, rows)
    out = M.take_mixed(docs, spark.createDataFrame(labels, SCHEMA), {"good": 0.998, "poor": 0.0, "toxic": 0.002}, anchor="good", tolerance=2e-4)
    assert out.columns == docs.columns
    kept = [r.doc_id for r in out.collect()]
    toxic = {i for i, t in rows if "vileword" in t or "badname" in t}
    clean = {i for i, t in rows if i not in toxic and "!!" not in t}
    assert not toxic & set(kept) and len(kept) == len(set(kept)) and len(clean & set(kept)) > 0.99 * len(clean)


def test_steps_go_on_from_written_rates(spark, monkeypatch):
    rng = np.random.default_rng(2)
    table = spark.createDataFrame([(int(t), *map(float, x)) for t, x in zip(rng.integers(5, 60, 50), rng.dirichlet([0.5] * 3, 50), strict=True)], "tokens long, good double, poor double, toxic double")
    found = []
    for replayed in (2, 100):
        monkeypatch.setattr(M, "REPLAYED", replayed)
        found.append(M.fit_rates(table, {"good": 0.8, "poor": 0.1, "toxic": 0.1}, pull=1e-3, most_steps=9, tolerance=0.0, anchor=None)[0])
    assert len(found[0]) == 9
    for (a, *x), (b, *y) in zip(*found, strict=True):
        assert np.allclose(a, b, rtol=1e-9, atol=1e-12) and x == y


def test_long_and_repeated_texts(spark):
    rows, labels = labelled_rows(300)
    rows += [(5000, "plain words here. " * 20_000), (5001, rows[0][1]), rows[0]]
    out = M.mixed(documents(spark, rows), spark.createDataFrame(labels, SCHEMA), {"good": 0.8, "poor": 0.1, "toxic": 0.1}).collect()
    assert len(out) == len(rows)
    by = [(r.doc_id, r.tokens, r.good, r.rate) for r in out]
    assert [x[1] for x in by if x[0] == 5000] == [60_000]
    same = {x[1:] for x in by if x[0] in (0, 5001)}
    assert len(same) == 1 and sum(x[0] == 0 for x in by) == 2


def test_no_labels_and_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert M.mixed(documents(spark, [(1, "a b c"), (2, None)]), none, {"good": 0.5, "poor": 0.25, "toxic": 0.25}).count() == 2
    assert M.mixed(empty(spark), none, {"good": 0.5, "poor": 0.25, "toxic": 0.25}).count() == 0
