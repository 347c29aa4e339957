import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from sheafwork.llm import quality as Q
from tests.llm.helpers import corpus, documents, empty, sentence


def labelled_rows(n=600, seed=3):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        text = " ".join(sentence(r) for _ in range(r.randint(2, 12)))
        good = r.random() < 0.7
        if not good:
            text = r.choice([text.upper().replace(" ", "!! "), " | ".join(text.split()), text.replace(" ", "%%% "), (text.split()[0] + " ") * 60])
        rows.append((i, text))
        labels.append((i, int(good)))
    return rows, labels


def test_model_learns_single_effects_and_pairs():
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 1, (6000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5) | (x[:, 2] > 0.9)).astype(float)
    model = Q.AdditiveModel().fit(x[:4000], y[:4000])
    assert (0, 1) in model.pair_tables
    assert ((model.score(x[4000:]) > 0.5) == y[4000:]).mean() > 0.95
    raw = model.base + sum(t[np.searchsorted(e, x[5000, i], "right")] for i, (t, e) in enumerate(zip(model.tables, model.edges, strict=True)))
    at = [np.searchsorted(e, x[5000, i], "right") for i, e in enumerate(model.pair_edges)]
    raw += sum(t[at[i], at[j]] for (i, j), t in model.pair_tables.items())
    assert abs(model.score(x[5000:5001])[0] - 1 / (1 + np.exp(-raw))) < 1e-12


class PlainModel(Q.AdditiveModel):
    """The same trees, each cut tried by itself with sums over the rows."""

    @staticmethod
    def gain(rows, g, h):
        return g[rows].sum() ** 2 / (h[rows].sum() + 1.0)

    def _tree(self, at, raw, y, size, cuts=3):
        g, h = self._slopes(raw, y)
        leaves = [(0, size)]
        for _ in range(cuts):
            tried = []
            for n, (a, b) in enumerate(leaves):
                for c in range(a + 1, b):
                    left, right = (at >= a) & (at < c), (at >= c) & (at < b)
                    tried.append((self.gain(left, g, h) + self.gain(right, g, h) - self.gain(left | right, g, h), n, c))
            best = max(tried, key=lambda t: round(t[0], 9), default=(0, 0, 0))
            if best[0] <= 1e-6:
                break
            a, b = leaves.pop(best[1])
            leaves += [(a, best[2]), (best[2], b)]
        out = np.zeros(size)
        for a, b in leaves:
            rows = (at >= a) & (at < b)
            out[a:b] = self.rate * g[rows].sum() / (h[rows].sum() + 1.0)
        return out

    def parts(self, a, b, i, j):
        return [(a < i) & (b < j), (a < i) & (b >= j), (a >= i) & (b < j), (a >= i) & (b >= j)]

    def best(self, a, b, raw, y, shape):
        g, h = self._slopes(raw, y)
        every = np.ones(len(a), bool)
        tried = [(sum(self.gain(p, g, h) for p in self.parts(a, b, i, j)) - self.gain(every, g, h), i, j) for i in range(1, shape[0]) for j in range(1, shape[1])]
        return max(tried, key=lambda t: round(t[0], 9), default=(0.0, 0, 0))

    def _grid_tree(self, a, b, raw, y, shape):
        g, h = self._slopes(raw, y)
        won, i, j = self.best(a, b, raw, y, shape)
        out = np.zeros(shape)
        if won > 1e-6:
            rows, columns = np.indices(shape)
            for cells, p in zip(self.parts(rows, columns, i, j), self.parts(a, b, i, j), strict=True):
                out[cells] = self.rate * g[p].sum() / (h[p].sum() + 1.0)
        return out

    def _choose(self, near, raw, y):
        wide = range(len(near))
        found = [(-self.best(near[i], near[j], raw, y, (len(self.pair_edges[i]) + 1, len(self.pair_edges[j]) + 1))[0], i, j) for i in wide for j in wide if i < j]
        return [(i, j) for won, i, j in sorted(found)[: self.pairs] if won < 0]


def test_fitting_matches_plain_trees():
    rng = np.random.default_rng(7)
    x = np.round(rng.uniform(0, 1, (400, 4)), 2)
    x[:, 3] = 0.5  # a feature without cuts
    y = (rng.uniform(0, 1, 400) < 0.1 + 0.8 * ((x[:, 0] > 0.4) ^ (x[:, 1] > 0.6))).astype(float)
    how = {"bins": 9, "pair_bins": 5, "rounds": 12, "pair_rounds": 8, "pairs": 2}
    got, want = Q.AdditiveModel(**how).fit(x, y), PlainModel(**how).fit(x, y)
    assert list(got.pair_tables) == list(want.pair_tables) and len(got.pair_tables) == 2
    assert all(np.allclose(a, b, atol=1e-9) for a, b in zip([*got.tables, *got.pair_tables.values()], [*want.tables, *want.pair_tables.values()], strict=True))


def test_repeated_rows_and_labels(spark):
    """A labelled identifier is one training row, however many rows of documents or labels have it."""
    rows, labels = labelled_rows(200)
    plain = spark.createDataFrame(labels, "doc_id long, quality int")
    again = spark.createDataFrame(labels + labels[:50] + [labels[1]] * 300, "doc_id long, quality int")
    a = {r.doc_id: r.score for r in Q.score_quality(documents(spark, rows), plain).collect()}
    out = Q.score_quality(documents(spark, rows + [rows[1]] * 300 + rows[:20]), again).collect()
    assert len(out) == 520 and all(r.score == a[r.doc_id] for r in out)


def test_held_out_rows(spark):
    rows, labels = labelled_rows()
    table = spark.createDataFrame(labels + [(5, None), (6, 7), (None, 1)], "doc_id long, quality int").withColumn("toxic", F.lit(0)).withColumn("text", F.lit("clash"))
    out = Q.score_quality(documents(spark, rows + corpus()[-16:] + [(None, "x")]), table).collect()
    truth = dict(labels)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    first = {r.doc_id: r for r in out}
    held = [first[i] for i in truth if first[i].held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.93


def test_held_out_labels_are_not_read(spark):
    rows, labels = labelled_rows(200)
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in labels]
    scores = [sorted((r.doc_id, r.score) for r in Q.score_quality(documents(spark, rows), spark.createDataFrame(x, "doc_id long, quality int")).collect()) for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_rows_that_stay(spark):
    rows, labels = labelled_rows(300)
    docs, table = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")
    out = Q.keep_quality(docs, table)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in Q.score_quality(docs, table).collect() if r.predicted)


def test_no_labels_and_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in Q.score_quality(documents(spark, [(1, "a"), (2, None)]), none).collect()} == {0.5}
    assert Q.score_quality(empty(spark), none).count() == 0
    one = spark.createDataFrame([(k, 1) for k in range(20)], "doc_id long, quality int")
    assert all(r.score > 0.8 for r in Q.score_quality(documents(spark, [(k, "a b") for k in range(20)]), one).collect())


def test_sample_is_bounded(spark):
    from sheafwork.llm.common import training_rows

    labels = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    assert 700 < training_rows(labels, ["quality"], 1000).count() < 1300


def test_texts_alone_go_to_python(spark):
    rows, labels = labelled_rows(60)
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    docs = documents(spark, rows + [(None, None), (99, "")]).withColumn("wide", F.repeat("text", 40))
    out = Q.keep_quality(docs, table)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("ArrowEvalPython") == 1
    kept = {r.doc_id for r in Q.score_quality(docs, table).collect() if r.predicted}
    assert out.columns == docs.columns and out.count() > 0 and {r.doc_id for r in out.collect()} == kept
