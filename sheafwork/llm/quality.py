"""Quality classifier: generalised additive model with pairwise interactions.

Features are taken from the whole text alone. Each feature is cut in bins at quantiles of the training rows. Boosting goes
round the features; each step fits one shallow tree of one feature to the loss's gradient and adds its leaves to that
feature's lookup table. Then pairs of features whose residuals fall most on a coarse grid get tables of their own, boosted in
the same way by trees with one cut on each of the two. A score is a sum of looked-up table entries through the logistic
function, for a whole batch at once.

Training rows are labelled rows whose crc32(identifier as text) mod 5 is not 0, at most about `sample_rows` of them: beyond
that, rows are taken by a hash of the identifier. Features and scores cover all rows.

Defined results: null and empty texts have all-zero features and get the model's score for them. Labels other than 0 and 1,
null too, are not used. Without training rows every score is 0.5; with one class only, the score is its smoothed share. Null
identifiers count as empty text for the fold. Repeated rows are scored each; a labelled identifier is one
training row, whatever rows share it. Empty tables give an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafwork.llm.common import binary_column, fold, one_of_each, training_rows

FEATURES = (
    "log_bytes", "log_words", "upper", "digit", "space", "newline", "beyond_ascii", "stop_marks", "commas", "loud_marks", "bars", "symbols", "brackets",
    "word_length", "short_words", "long_words", "different_words", "top_word", "repeats", "marked_words", "words_a_sentence", "repeated_lines",
)


def byte_set(chars: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(chars)] = True
    return found


SETS = np.stack([
    byte_set(bytes(range(65, 91))), byte_set(b"0123456789"), byte_set(b" \t\r"), byte_set(b"\n"), byte_set(bytes(range(128, 256))), byte_set(b".?"), byte_set(b",;:"),
    byte_set(b"!"), byte_set(b"|"), byte_set(b"%&$#*@^~=+_<>\\/"), byte_set(b"()[]{}\"'`"),
]).astype(float)


def features_of(text: bytes) -> list[float]:
    if not text:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = (SETS @ counts / len(text)).tolist()
    words = text.lower().split()
    n = len(words)
    if not n:
        return [np.log1p(len(text)), 0.0, *shares, *[0.0] * (len(FEATURES) - 2 - len(shares))]
    lengths = np.fromiter(map(len, words), np.int64, n)
    kinds = Counter(words)
    lines = text.split(b"\n")
    sentences = int(counts[46] + counts[63] + counts[33]) + 1
    marked = sum(c for w, c in kinds.items() if not (w[-1:].isalnum() or w[-1] > 127))
    return [
        np.log1p(len(text)), np.log1p(n), *shares, float(lengths.mean()), float((lengths <= 3).mean()), float((lengths >= 12).mean()), len(kinds) / n ** 0.8, max(kinds.values()) / n,
        sum(map(eq, words, words[1:])) / n, marked / n, np.log1p(n / sentences), 1 - len(set(lines)) / len(lines),
    ]


def table_of(texts: list[bytes]) -> np.ndarray:
    return np.array([features_of(t) for t in texts], np.float32).reshape(len(texts), len(FEATURES))


class AdditiveModel:
    """Bin edges and lookup tables of single features and of pairs."""

    def __init__(self, bins: int = 32, pair_bins: int = 12, rounds: int = 150, pair_rounds: int = 60, pairs: int = 6, rate: float = 0.1):
        self.bins, self.pair_bins, self.rounds, self.pair_rounds, self.pairs, self.rate = bins, pair_bins, rounds, pair_rounds, pairs, rate
        self.base = 0.0
        self.edges: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.pair_edges: list[np.ndarray] = []
        self.pair_tables: dict[tuple[int, int], np.ndarray] = {}

    @staticmethod
    def _edges(x: np.ndarray, bins: int) -> np.ndarray:
        return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))

    @staticmethod
    def _binned(x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, i], "right") for i, e in enumerate(edges)]

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        n, wide = len(y), x.shape[1]
        self.edges = [self._edges(x[:, i], self.bins) if n else np.zeros(0) for i in range(wide)]
        self.pair_edges = [self._edges(x[:, i], self.pair_bins) if n else np.zeros(0) for i in range(wide)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        share = (y.sum() + 0.5) / (n + 1)
        self.base = float(np.log(share / (1 - share)))
        if not n or y.min() == y.max():
            return self
        at = self._binned(x, self.edges)
        raw = np.full(n, self.base)
        for _ in range(self.rounds):
            for i in range(wide):
                if len(self.edges[i]):
                    step = self._tree(at[i], raw, y, len(self.tables[i]))
                    self.tables[i] += step
                    raw += step[at[i]]
        near = self._binned(x, self.pair_edges)
        for pair in self._choose(near, raw, y):
            self.pair_tables[pair] = np.zeros((len(self.pair_edges[pair[0]]) + 1, len(self.pair_edges[pair[1]]) + 1))
        for _ in range(self.pair_rounds):
            for (i, j), own in self.pair_tables.items():
                step = self._grid_tree(near[i], near[j], raw, y, own.shape)
                own += step
                raw += step[near[i], near[j]]
        return self

    @staticmethod
    def _slopes(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-raw))
        return y - p, p * (1 - p)

    def _tree(self, at: np.ndarray, raw: np.ndarray, y: np.ndarray, size: int, cuts: int = 3) -> np.ndarray:
        """A tree of up to `cuts` cuts on one feature's bins: the leaf values by bin, times the rate."""
        g, h = (np.bincount(at, w, size) for w in self._slopes(raw, y))
        sg, sh = np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(h)))
        leaves = [(0, size)]
        gain = lambda a, b: (sg[b] - sg[a]) ** 2 / (sh[b] - sh[a] + 1.0)
        for _ in range(cuts):
            best = (1e-6, None, None)
            for leaf in leaves:
                a, b = leaf
                if b - a > 1:
                    c = np.arange(a + 1, b)
                    won = gain(a, c) + gain(c, b) - gain(a, b)
                    k = int(won.argmax())
                    if won[k] > best[0]:
                        best = (won[k], leaf, int(c[k]))
            if best[1] is None:
                break
            leaves.remove(best[1])
            leaves += [(best[1][0], best[2]), (best[2], best[1][1])]
        out = np.zeros(size)
        for a, b in leaves:
            out[a:b] = self.rate * (sg[b] - sg[a]) / (sh[b] - sh[a] + 1.0)
        return out

    def _sums(self, a: np.ndarray, b: np.ndarray, raw: np.ndarray, y: np.ndarray, shape: tuple[int, int]) -> list[np.ndarray]:
        """Gradient and curvature over all rectangles from the corner."""
        out = []
        for w in self._slopes(raw, y):
            grid = np.bincount(a * shape[1] + b, w, shape[0] * shape[1]).reshape(shape)
            out.append(np.pad(grid.cumsum(0).cumsum(1), ((1, 0), (1, 0))))
        return out

    def _quarters(self, sg: np.ndarray, sh: np.ndarray) -> tuple[float, int, int]:
        """The best cut on each of two features: its gain and the two cuts."""
        def gain(s: np.ndarray, t: np.ndarray) -> np.ndarray:
            return s**2 / (t + 1.0)

        g, h = sg[1:-1, 1:-1], sh[1:-1, 1:-1]
        if not g.size:
            return 0.0, 0, 0
        right, below, all_ = (sg[1:-1, -1:], sh[1:-1, -1:]), (sg[-1:, 1:-1], sh[-1:, 1:-1]), (sg[-1, -1], sh[-1, -1])
        won = gain(g, h) + gain(right[0] - g, right[1] - h) + gain(below[0] - g, below[1] - h) + gain(all_[0] - right[0] - below[0] + g, all_[1] - right[1] - below[1] + h) - gain(*all_)
        k = int(won.argmax())
        return float(won.flat[k]), k // won.shape[1] + 1, k % won.shape[1] + 1

    def _grid_tree(self, a: np.ndarray, b: np.ndarray, raw: np.ndarray, y: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
        sg, sh = self._sums(a, b, raw, y, shape)
        out = np.zeros(shape)
        won, i, j = self._quarters(sg, sh)
        if won > 1e-6:
            for r0, r1 in ((0, i), (i, shape[0])):
                for c0, c1 in ((0, j), (j, shape[1])):
                    g, h = (s[r1, c1] - s[r0, c1] - s[r1, c0] + s[r0, c0] for s in (sg, sh))
                    out[r0:r1, c0:c1] = self.rate * g / (h + 1.0)
        return out

    def _choose(self, near: list[np.ndarray], raw: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
        found = []
        for i, j in combinations(range(len(near)), 2):
            shape = (len(self.pair_edges[i]) + 1, len(self.pair_edges[j]) + 1)
            found.append((self._quarters(*self._sums(near[i], near[j], raw, y, shape))[0], i, j))
        return [(i, j) for won, i, j in sorted(found, key=lambda f: (-f[0], f[1:]))[: self.pairs] if won > 0]

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.base)
        for table, at in zip(self.tables, self._binned(x, self.edges), strict=True):
            raw += table[at]
        near = self._binned(x, self.pair_edges)
        for (i, j), table in self.pair_tables.items():
            raw += table[near[i], near[j]]
        return 1 / (1 + np.exp(-raw))


def train(docs: DataFrame, labels: DataFrame, label_col: str, sample_rows: int) -> AdditiveModel:
    """docs: id, text. Features of the training rows alone are made and collected; their number is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = table_of(binary_column(batch, "text"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float32()))], ["id", "y", "x"])

    known = training_rows(labels, [label_col], sample_rows)
    marked = docs.join(F.broadcast(known), "id").select("id", F.col(label_col).alias("y"), "text")
    featured = marked.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, y int, x array<float>")
    got = one_of_each(featured, ["id", "y"]).toPandas().sort_values(["id", "y"])  # one order, so that sums are the same each time
    return AdditiveModel().fit(np.array(got["x"].tolist(), float).reshape(-1, len(FEATURES)), got["y"].to_numpy(float))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, threshold: float = 0.3, sample_rows: int = 30_000) -> DataFrame:
    """One row for each row of docs: id, held_out, score, predicted."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    model = train(narrow, labels, label_col, sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(table_of(binary_column(batch, "text")).astype(float)))], ["id", "score"])

    scored = narrow.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, score double")
    return scored.select(F.col("id").alias(id_col), (fold() == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, threshold: float = 0.3, sample_rows: int = 30_000) -> DataFrame:
    """The rows of docs that are not rejected, with all their columns; each row is judged by itself, where it stands.

    Texts alone go to Python and a score comes back, so that whole rows aren't held there and in Arrow's buffers both ways.
    """
    model = train(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), labels, label_col, sample_rows)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        found = []
        for at in range(0, len(texts), 512):
            batch = pa.RecordBatch.from_arrays([texts.slice(at, 512)], ["text"])
            found.append(model.score(table_of(binary_column(batch, "text")).astype(float)))
        return pa.array(np.concatenate(found) if found else np.zeros(0))

    return docs.filter(score(F.col(text_col)) >= threshold)
