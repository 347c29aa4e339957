"""Mixing sources to target weights: soft-membership mixing.

A document belongs to each domain to a degree. The domains are `good`, `poor` and `toxic`; a classifier that is fitted to the
labelled table (quality and toxic) predicts each document's posteriors, so documents without labels are mixed too:

1. Words of toxic labelled documents are counted by document, and those that are in enough of them are counted in the other
   labelled documents; the log-ratio of the two shares is a word's weight. The words kept are bounded: a word counts if it
   is in at least 1 of 400 toxic documents, and so there are at most 400 times as many as a document has different words.
2. Features of all documents: those of the quality classifier, and sums, maxima and counts of word weights.
3. Two additive models, for quality and toxic, give posteriors: poor is 1 - q, toxic is q t, good is q (1 - t).

Then nonnegative document rates are fitted: over all r >= 0, least squares of the domains' expected token totals,
sum of r x tokens x posterior, against their targets, with a small pull of each rate to 1. Projected gradient with momentum,
distributed: a step needs one sum over all documents of a number for each domain, and a rate depends on a document's own
posteriors and the past steps' residuals alone. So a step is one pass over narrow rows without a join; every `REPLAYED` steps
the rates reached are written, and later steps go on from there.

A rate is a weight; whole copies follow from it by a hash of the identifier: floor(rate + u), with u between 0 and 1 and alike
for each run. Rates within `snap` of 0 or 1 count as 0 or 1.

Training rows are labelled rows whose crc32(identifier as text) mod 5 is not 0, about `sample_rows` of them at most, chosen by
hash; word counts take all labelled rows of those folds.

Defined results: null and empty texts have no tokens; they get a rate and add nothing to totals. A domain that no document
belongs to keeps its target unmet, and the others reach theirs. Without labels all posteriors are the same. Repeated rows are
documents of their own. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafwork.llm.common import binary_column, id_key, one_of_each, training_rows, written
from sheafwork.llm.decontamination import words_of
from sheafwork.llm.quality import FEATURES, AdditiveModel, features_of

DOMAINS = ("good", "poor", "toxic")
REPLAYED = 8
WORD_FEATURES = 5
WIDE = len(FEATURES) + WORD_FEATURES


def labelled(docs: DataFrame, labels: DataFrame, broadcast_rows: int) -> DataFrame:
    """Texts with labels of the training folds. A labelled table of a small, counted size is sent to the documents; else both are exchanged."""
    known = training_rows(labels, ["quality", "toxic"], 1 << 62)
    if known.count() <= broadcast_rows:
        known = F.broadcast(known)
    return docs.join(known, "id")


def word_weights(marked: DataFrame, share: int = 400) -> dict[bytes, float]:
    """Log-ratios of words' shares of toxic and other documents."""
    sizes = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return {}

    def counted(wanted: frozenset[bytes] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: Counter = Counter()
            for batch in batches:
                for text in binary_column(batch, "text"):
                    words = set(words_of(text))
                    found.update(words if wanted is None else words & wanted)
                if len(found) > 200_000:
                    yield out(found)
            yield out(found)

        def out(found: Counter) -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
            found.clear()
            return made

        return run

    least = max(5, -(-n1 // share))
    toxic = {bytes(r["word"]): r["n"] for r in marked.filter("toxic = 1").select("text").mapInArrow(counted(None), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).collect()}
    other = {bytes(r["word"]): r["n"] for r in marked.filter("toxic = 0").select("text").mapInArrow(counted(frozenset(toxic)), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return {w: float(np.log((n + 0.5) / (n1 + 1)) - np.log((other.get(w, 0) + 0.5) / (n0 + 1))) for w, n in sorted(toxic.items())}


def word_features(text: bytes, weights: dict[bytes, float]) -> list[float]:
    found = sorted((weights[w] for w in set(words_of(text)) & weights.keys()), reverse=True)
    if not found:
        return [0.0] * WORD_FEATURES
    return [found[0], found[1] if len(found) > 1 else 0.0, float(sum(w > 1 for w in found)), float(sum(w > 2.5 for w in found)), float(sum(w for w in found if w > 0.5))]


def table_of(texts: list[bytes], weights: dict[bytes, float]) -> np.ndarray:
    return np.array([features_of(t) + word_features(t, weights) for t in texts], np.float32).astype(float).reshape(len(texts), WIDE)


class Membership:
    """Word weights and the two models."""

    def __init__(self, weights: dict[bytes, float], x: np.ndarray, quality: np.ndarray, toxic: np.ndarray):
        self.weights = weights
        self.quality = AdditiveModel(rounds=100, pair_rounds=40).fit(x[:, : len(FEATURES)], quality)
        self.toxic = AdditiveModel(rounds=100, pair_rounds=40).fit(self._words(x), toxic)

    @staticmethod
    def _words(x: np.ndarray) -> np.ndarray:
        return np.concatenate((x[:, len(FEATURES) :], x[:, 1:2]), axis=1)

    def posteriors(self, texts: list[bytes]) -> np.ndarray:
        """A column for each domain."""
        x = table_of(texts, self.weights)
        q, t = self.quality.score(x[:, : len(FEATURES)]), self.toxic.score(self._words(x))
        return np.stack((q * (1 - t), 1 - q, q * t), axis=1)


def fit_membership(docs: DataFrame, labels: DataFrame, sample_rows: int, broadcast_rows: int) -> Membership:
    """docs: id, text."""
    weights = word_weights(labelled(docs, labels, broadcast_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = table_of(binary_column(batch, "text"), weights).astype(np.float32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), WIDE).cast(pa.list_(pa.float32()))], ["id", "quality", "toxic", "x"])

    known = training_rows(labels, ["quality", "toxic"], sample_rows)
    marked = docs.join(F.broadcast(known), "id").select("id", "quality", "toxic", "text")
    featured = marked.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, quality int, toxic int, x array<float>")
    got = one_of_each(featured, ["id", "quality", "toxic"]).toPandas().sort_values(["id", "quality", "toxic"])  # about sample_rows rows
    return Membership(weights, np.array(got["x"].tolist(), float).reshape(-1, WIDE), got["quality"].to_numpy(float), got["toxic"].to_numpy(float))


def member_table(docs: DataFrame, model: Membership) -> DataFrame:
    """id, tokens, good, poor, toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = binary_column(batch, "text")
            p = model.posteriors(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(words_of(t)) for t in texts], pa.int64()), *(pa.array(p[:, k].copy()) for k in range(len(DOMAINS)))], ["id", "tokens", *DOMAINS])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, tokens long, good double, poor double, toxic double")


def snapped(rate: np.ndarray, snap: float) -> np.ndarray:
    return np.where(rate < snap, 0.0, np.where(np.abs(rate - 1) < snap, 1.0, rate))


def chance(c: str) -> Column:
    """A number from 0 to 1 by a hash of the identifier."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(id_key(c), F.lit(""))), 11) / float(1 << 53)


def rates_after(p: np.ndarray, steps: list[tuple[np.ndarray, float, float]], pull: float, scale: float, rate: np.ndarray | None = None, look: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rates after these steps, and the point at which the next step looks, from given ones or from 1. steps: residual, step size and momentum of each."""
    if rate is None or look is None:
        rate = look = np.ones(len(p))
    for residual, size, momentum in steps:
        new = np.maximum(0.0, look - size * (scale * (p @ residual) + pull * (look - 1)))
        look, rate = new + momentum * (new - rate), new
    return rate, look


def fit_rates(members: DataFrame, targets: dict[str, float], *, pull: float, most_steps: int, tolerance: float, anchor: str | None) -> tuple[list, float]:
    """Steps of the projected gradient, and its scale. members: tokens and posteriors.

    Targets are shares of a whole, by default the corpus's tokens; with an anchor, the whole of which the anchor domain's
    share is what that domain has now.
    """
    have = members.agg(*[F.sum(F.col("tokens") * F.col(d)).alias(d) for d in DOMAINS], F.sum("tokens").alias("all")).first()
    total = float(have["all"] or 0)
    if not total:
        return [], 0.0
    whole = total if anchor is None else float(have[anchor]) / targets[anchor]
    target = np.array([targets[d] for d in DOMAINS]) * whole
    scale = total / whole if whole else 1.0
    # In the norm that weighs a document by its tokens, the gradient is scale x (posteriors x residual) + pull x (rate - 1);
    # its slope is at most scale squared times the largest eigenvalue of the mean outer product of posteriors, which 1 bounds.
    size = 1.0 / (scale**2 + pull)
    steps: list[tuple[np.ndarray, float, float]] = []
    state = members.select("tokens", *DOMAINS, F.lit(1.0).alias("rate"), F.lit(1.0).alias("look"))
    at = 0  # steps that the state has taken
    t = 1.0
    before = np.inf

    def arrays(batch: pa.RecordBatch, done: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        tokens, *p, rate, look = (c.to_numpy() for c in batch.columns)
        p = np.stack(p, axis=1)
        return tokens.astype(float), p, *rates_after(p, done, pull, scale, rate, look)

    def summed(done: list):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(2 * len(DOMAINS))
            for batch in batches:
                tokens, p, rate, look = arrays(batch, done)
                sums += np.concatenate(((look * tokens) @ p, (rate * tokens) @ p))
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in sums], [f"s{i}" for i in range(len(sums))])

        return run

    def moved(done: list):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, _, rate, look = arrays(batch, done)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(rate), pa.array(look)], batch.schema.names)

        return run

    for _ in range(most_steps):
        if len(steps) - at == REPLAYED:
            state, at = written(state.mapInArrow(moved(steps[at:]), state.schema), "mix-state"), len(steps)
        got = state.mapInArrow(summed(steps[at:]), ", ".join(f"s{i} double" for i in range(2 * len(DOMAINS)))).agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(2 * len(DOMAINS))]).first()
        look, rate = np.array(got[: len(DOMAINS)]), np.array(got[len(DOMAINS) :])
        now = float(np.abs(rate - target).max() / whole)
        if now < tolerance or abs(before - now) < tolerance / 50 and len(steps) > 20:
            break
        if now > before:
            t = 1.0  # the momentum has carried too far
        before = now
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        steps.append(((look - target) / whole, size, (t - 1) / after))
        t = after
    return steps, scale


def fitted(narrow: DataFrame, labels: DataFrame, targets: dict[str, float], pull: float, most_steps: int, tolerance: float, anchor: str | None, sample_rows: int, broadcast_rows: int) -> tuple[DataFrame, Membership, list, float]:
    model = fit_membership(narrow, labels, sample_rows, broadcast_rows)
    members = written(member_table(narrow, model), "mix-members")
    return members, model, *fit_rates(members, targets, pull=pull, most_steps=most_steps, tolerance=tolerance, anchor=anchor)


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", *, pull: float = 1e-4, most_steps: int = 60, tolerance: float = 2e-3, snap: float = 0.02, anchor: str | None = None, sample_rows: int = 20_000, broadcast_rows: int = 200_000) -> DataFrame:
    """One row for each row of docs: id, tokens, good, poor, toxic (posteriors), rate, copies."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    members, _, steps, scale = fitted(narrow, labels, targets, pull, most_steps, tolerance, anchor, sample_rows, broadcast_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.stack([batch.column(i + 2).to_numpy() for i in range(len(DOMAINS))], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(snapped(rates_after(p, steps, pull, scale)[0], snap))], [*batch.schema.names, "rate"])

    found = members.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, tokens long, good double, poor double, toxic double, rate double")
    return found.withColumn("copies", F.floor(F.col("rate") + chance("id")).cast("int")).withColumnRenamed("id", id_col)


def take_mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", *, pull: float = 1e-4, most_steps: int = 60, tolerance: float = 2e-3, snap: float = 0.02, anchor: str | None = None, sample_rows: int = 20_000, broadcast_rows: int = 200_000) -> DataFrame:
    """The rows of docs, each as often as its copies say, with all their columns. Rates are computed where the rows stand; no text is exchanged."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    _, model, steps, scale = fitted(narrow, labels, targets, pull, most_steps, tolerance, anchor, sample_rows, broadcast_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = batch.column(batch.num_columns - 1).to_numpy()
            rate = snapped(rates_after(model.posteriors(binary_column(batch, text_col)), steps, pull, scale)[0], snap)
            copies = np.floor(rate + u).astype(np.int64)
            yield batch.take(pa.array(np.repeat(np.arange(len(copies)), copies))).select(names)

    names = docs.columns
    return docs.withColumn("__chance", chance(id_col)).mapInArrow(run, docs.schema)
