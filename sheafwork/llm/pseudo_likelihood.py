"""Language-model scoring: masked pseudo-likelihood.

A window network predicts every word from the words on both sides: each place of the window has a table with a row for each
word, the rows are summed and go through tanh, and a softmax in levels (a class of words, a group in the class, then the word in
its group) gives the word's probability. A document's score is the sum of its words' conditional log-probabilities.

1. Words are counted over the whole corpus. All of them are numbered by rank, in classes and groups of equal size, as long as
   they are no more than `most_numbered`; of more, the most frequent ones. Others share the last numbers, by their
   last two bytes; such a word's probability is that of its shared number times the share of its own count in that number's
   count. Those counts are kept in cells, by a hash of the word. Classes, groups, members and cells grow with the number of
   different words, up to the limits of `Shape`.
2. Documents become lists of numbers, once. For training they are dealt to virtual shards by a hash of identifier and text. The
   shards' number follows from the corpus alone, and so does the order in a shard, and a shard is one row of the table that is
   written. So scores don't depend on how the tables are partitioned. Equal rows are in one shard.
3. Training starts from the words' frequencies. Places are dealt to `rounds` rounds by a hash; in each, every shard learns its
   places of the round (the word at the place is hidden, it isn't in its own window) from the same network, and the shards'
   networks are averaged, weighted by their places, for the next round. Each word of each document is learned once.
4. Each document is scored with the last average.

The driver holds the frequent words, the cells and one set of parameters, within the limits of `Shape`.

Defined results: null and empty texts, and texts without words, have no words and score 0; their mean is null. Repeated rows are
scored each. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafwork.llm.common import binary_column, written
from sheafwork.llm.decontamination import words_of


@dataclass(frozen=True)
class Shape:
    """classes, members and cells: 0 for as many as the corpus asks for. Where classes and members are both 0, so are the groups of a class."""

    classes: int = 0
    members: int = 0
    groups: int = 1
    hidden: int = 16
    side: int = 1
    shared: int = 4  # the last so many classes (or groups, where classes have any) are of words without a number of their own
    cells: int = 0
    rate: float = 0.3
    rounds: int = 3
    batch: int = 16384
    steps: int = 64  # of a shard's round at least, by smaller batches
    shard_words: int = 2_000_000
    most_classes: int = 256
    most_numbered: int = 1 << 16
    most_cells: int = 1 << 21

    def sized(self, kinds: int) -> Shape:
        """For a corpus of so many different words: classes grow with its fourth root, groups and members so that each word has a number, up to `most_numbered`."""
        side = int(min(self.most_classes, max(2 * self.shared, round(0.8 * kinds**0.25))))
        cells = int(min(self.most_cells, 1 << max(10, (2 * kinds).bit_length())))
        if self.classes or self.members:
            return replace(self, classes=self.classes or side, members=self.members or side, cells=self.cells or cells)
        each = max(self.shared, math.ceil(math.sqrt(min(kinds, self.most_numbered) / (side - 1))))
        return replace(self, classes=side, groups=each, members=each, cells=self.cells or cells)

    @property
    def class_size(self) -> int:
        return self.groups * self.members

    @property
    def numbered(self) -> int:
        return self.size - self.shared_numbers

    @property
    def size(self) -> int:
        return self.classes * self.class_size

    @property
    def shared_numbers(self) -> int:
        return self.shared * self.members


class Vocabulary:
    """Numbers of words. A word without one of its own gets a shared number and a cell of counts."""

    def __init__(self, words: list[bytes], counts: list[int], cells: np.ndarray, shape: Shape):
        self.shape, self.numbers = shape, {w: i for i, w in enumerate(words)}
        self.cells = cells
        total = np.zeros(shape.size)
        total[: len(words)] = counts
        at = np.flatnonzero(cells)
        np.add.at(total, self.shared_number(at), cells[at])
        self.total = total

    @classmethod
    def of(cls, shape: Shape, numbers: dict[bytes, int], cells: np.ndarray, total: np.ndarray) -> Vocabulary:
        made = cls.__new__(cls)
        made.shape, made.numbers, made.cells, made.total = shape, numbers, cells, total
        return made

    def cell(self, word: bytes) -> int:
        return int(self.cells_of([word])[0])

    def cells_of(self, words: list[bytes]) -> np.ndarray:
        """Cells of one shared number have one remainder."""
        many, n = self.shape.shared_numbers, len(words)
        whole = np.fromiter(map(zlib.crc32, words), np.int64, n)
        return whole % max(1, self.shape.cells // many) * many + np.fromiter((zlib.crc32(w[-2:]) for w in words), np.int64, n) % many

    def shared_number(self, cell):
        return self.shape.numbered + cell % self.shape.shared_numbers

    def read(self, text: bytes) -> tuple[np.ndarray, float]:
        """Numbers of a text's words, and the sum of the logarithms of the shares that words have in their numbers."""
        words = words_of(text)
        found = np.fromiter(map(self.numbers.get, words, repeat(-1)), np.int32, len(words))
        rare = np.flatnonzero(found < 0)
        if not len(rare):
            return found, 0.0
        cells = self.cells_of([words[i] for i in rare.tolist()])
        found[rare] = self.shared_number(cells)
        # A cell that wasn't counted can only be of another corpus.
        return found, float(np.log(np.maximum(self.cells[cells], 0.5) / np.maximum(self.total[found[rare]], 1.0)).sum())


def sorted_order(key: np.ndarray) -> np.ndarray:
    """A stable order; numbers are sorted several times faster than indices by them."""
    return np.sort(key.astype(np.int64) << 32 | np.arange(len(key))) & 0xFFFFFFFF


def first_of_runs(key: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1))


class Runs:
    """Runs of equal sorted keys. Long ones (first row, row after the last, key) are multiplied by themselves, short ones in stacks.

    A stack: its runs and their keys, as many rows for each of them (the last is repeated to fill up), and which places of these are real.
    """

    def __init__(self, key: np.ndarray, heights: tuple[int, ...] = (1, 2, 4, 8, 16)):
        self.first = first_of_runs(key)
        self.keys = key[self.first]
        last = np.append(self.first[1:], len(key))
        size = last - self.first
        self.stacks, low = [], 0
        for high in heights:
            some = np.flatnonzero((size > low) & (size <= high))
            if len(some):
                rows, ends = self.first[some, None] + np.arange(high), last[some, None]
                self.stacks.append((some, self.keys[some], np.minimum(rows, ends - 1), np.flatnonzero(rows < ends)))
            low = high
        self.long_at = np.flatnonzero(size > low).tolist()
        self.long = list(zip(self.first[self.long_at].tolist(), last[self.long_at].tolist(), self.keys[self.long_at].tolist(), strict=True))


class WindowNetwork:
    def __init__(self, shape: Shape, flat: np.ndarray | None = None):
        self.shape = s = shape
        self.dims = [(2 * s.side, s.size + 1, s.hidden), (s.hidden,), (s.hidden, s.classes), (s.classes,), (s.classes * s.groups, s.hidden, s.members), (s.classes * s.groups, s.members)]
        if s.groups > 1:
            self.dims += [(s.classes, s.hidden, s.groups), (s.classes, s.groups)]
        if flat is None:
            flat = (np.random.default_rng(11).standard_normal(sum(int(np.prod(d)) for d in self.dims)) * 0.05).astype(np.float32)
        self.flat, self.parts, at = flat, [], 0
        for d in self.dims:
            n = int(np.prod(d))
            self.parts.append(self.flat[at : at + n].reshape(d))
            at += n
        self.offsets = [k for k in range(-s.side, s.side + 1) if k]

    def start_from(self, total: np.ndarray) -> WindowNetwork:
        """Biases from the words' frequencies."""
        s = self.shape
        counts = total.reshape(s.classes, s.groups, s.members) + 0.1
        self.parts[3][:] = np.log(counts.sum(axis=(1, 2)) / counts.sum())
        self.parts[5][:] = np.log(counts / counts.sum(axis=2, keepdims=True)).reshape(-1, s.members)
        if s.groups > 1:
            self.parts[7][:] = np.log(counts.sum(axis=2) / counts.sum(axis=(1, 2))[:, None])
        return self

    def hidden(self, numbers: np.ndarray, at: np.ndarray) -> np.ndarray:
        tables, bias = self.parts[:2]
        total = np.broadcast_to(bias, (len(at), self.shape.hidden)).copy()
        for table, k in zip(tables, self.offsets, strict=True):
            total += table.take(numbers[at + k], axis=0)
        return np.tanh(total, out=total)

    @staticmethod
    def shifted(logits: np.ndarray) -> np.ndarray:
        """Rows less their largest, in place, where a logit is so large that it matters for the exponentials."""
        if max(logits.max(), -logits.min()) > 30:
            logits -= logits.max(axis=1, keepdims=True)
        return logits

    @staticmethod
    def exponentials(logits: np.ndarray) -> np.ndarray:
        """Exponentials in place, and their sums by row; a product with ones is several times faster than a sum along rows."""
        return np.exp(logits, out=logits) @ np.ones(logits.shape[1], logits.dtype)

    @classmethod
    def picked(cls, logits: np.ndarray, choice: np.ndarray) -> np.ndarray:
        """Each row's logarithm of the softmax at its choice; logits is used up."""
        found = cls.shifted(logits)[np.arange(len(choice)), choice]
        return found - np.log(cls.exponentials(logits))

    @classmethod
    def slopes(cls, logits: np.ndarray, choice: np.ndarray) -> np.ndarray:
        """Of the negative logarithm of the softmax at each row's choice, in place."""
        logits *= (1 / cls.exponentials(cls.shifted(logits)))[:, None]
        logits[np.arange(len(choice)), choice] -= 1
        return logits

    def levels(self, target: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Below the classes: the weights' part (biases follow), and each sorted target's set of weights and choice in it."""
        s = self.shape
        if s.groups > 1:
            yield 6, target // s.class_size, target // s.members % s.groups
        yield 4, target // s.members, target % s.members

    def logits(self, part: int, h: np.ndarray, key: np.ndarray, runs: Runs) -> np.ndarray:
        """Logits of all choices at a level, by sorted keys."""
        weights, out = self.parts[part], self.parts[part + 1].take(key, axis=0)
        for a, b, k in runs.long:
            out[a:b] += h[a:b] @ weights[k]
        for _, keys, rows, real in runs.stacks:
            out[rows.take(real)] += (h.take(rows, axis=0) @ weights.take(keys, axis=0)).reshape(-1, out.shape[1]).take(real, axis=0)
        return out

    def log_probability(self, numbers: np.ndarray, at: np.ndarray) -> np.ndarray:
        if not len(at):
            return np.zeros(0)
        order = sorted_order(numbers[at])
        h, target = self.hidden(numbers, at[order]), numbers[at[order]]
        found = self.picked(h @ self.parts[2] + self.parts[3], target // self.shape.class_size)
        for part, key, choice in self.levels(target):
            found += self.picked(self.logits(part, h, key, Runs(key)), choice)
        out = np.empty_like(found)
        out[order] = found
        return out

    def gradient(self, numbers: np.ndarray, at: np.ndarray) -> list[tuple[int, object, np.ndarray]]:
        """Of the mean negative log-probability: part, rows of the part (none: all), values."""
        at = at[sorted_order(numbers[at])]
        h, target, n = self.hidden(numbers, at), numbers[at], np.float32(len(at))
        d = self.slopes(h @ self.parts[2] + self.parts[3], target // self.shape.class_size)
        d /= n
        out: list[tuple[int, object, np.ndarray]] = [(2, None, h.T @ d), (3, None, d.sum(axis=0))]
        dh = d @ self.parts[2].T
        for part, key, choice in self.levels(target):
            runs, weights = Runs(key), self.parts[part]
            d = self.slopes(self.logits(part, h, key, runs), choice)
            d /= n
            own = np.empty((len(runs.keys), *weights.shape[1:]), weights.dtype)
            own_bias = np.empty((len(runs.keys), d.shape[1]), d.dtype)
            for i, (a, b, k) in zip(runs.long_at, runs.long, strict=True):
                np.matmul(h[a:b].T, d[a:b], out=own[i])
                np.sum(d[a:b], axis=0, out=own_bias[i])
                dh[a:b] += d[a:b] @ weights[k].T
            for some, keys, rows, real in runs.stacks:
                stack = np.zeros((rows.size, d.shape[1]), d.dtype)  # what only fills up counts for nothing
                stack[real] = d.take(rows.take(real), axis=0)
                stack = stack.reshape(*rows.shape, -1)
                across = h.take(rows, axis=0).transpose(0, 2, 1)
                own[some] = across * stack if rows.shape[1] == 1 else across @ stack
                own_bias[some] = np.ones(rows.shape[1], d.dtype) @ stack
                dh[rows.take(real)] += (stack @ weights.take(keys, axis=0).transpose(0, 2, 1)).reshape(-1, h.shape[1]).take(real, axis=0)
            out += [(part, runs.keys, own), (part + 1, runs.keys, own_bias)]
        dh *= 1 - h * h
        out.append((1, None, dh.sum(axis=0)))
        for k, offset in enumerate(self.offsets):
            word = numbers[at + offset]
            order = sorted_order(word)
            first = first_of_runs(word[order])
            out.append((0, (k, word[order][first]), np.add.reduceat(dh.take(order, axis=0), first, axis=0)))
        return out


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of about so many bytes of a column, whole documents each."""
    for batch in batches:
        texts, a, size = binary_column(batch, column), 0, 0
        for b, text in enumerate(texts):
            size += len(text)
            if size >= most:
                yield batch.slice(a, b + 1 - a), texts[a : b + 1]
                a, size = b + 1, 0
        if a < len(texts):
            yield batch.slice(a), texts[a:]


def joined(lists: list[bytes], shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words with edge numbers around each document, and each document's words."""
    edge = np.full(shape.side, shape.size, np.int32)
    pieces = [edge]
    for numbers in lists:
        pieces += [np.frombuffer(numbers, np.int32), edge]
    return np.concatenate(pieces), np.array([len(x) // 4 for x in lists], np.int64)


def round_of(n: int, rounds: int) -> np.ndarray:
    """Round of each of n places, by a hash."""
    h = np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)) % np.uint64(rounds)


PIECE = 4096
PIECES_DDL = "piece int, weight double, vals binary"


def piece_batch(piece: int, weight: float, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([float(weight)]), pa.array([values.astype(np.float32).tobytes()], pa.binary())], ["piece", "weight", "vals"])


def trained(shape: Shape, flat: np.ndarray, this: int):
    """Shards (words with edges) to pieces of the mean change of their networks, weighted by their places: piece, weight, values."""
    rate = shape.rate / (1 + this)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, whole = np.zeros(len(flat)), 0
        for batch in batches:
            for row in batch.column(0):
                words = np.frombuffer(row.as_buffer(), np.int32)
                places = np.flatnonzero((words < shape.size) & (round_of(len(words), shape.rounds) == this))
                net, squares = WindowNetwork(shape, flat.copy()), WindowNetwork(shape, np.full_like(flat, 1e-6))  # sums of squared gradients scale the steps
                batch = min(shape.batch, max(256, len(places) // shape.steps))
                for at in range(0, len(places), batch):
                    for part, rows, g in net.gradient(words, places[at : at + batch]):
                        values, sums = net.parts[part], squares.parts[part]
                        if isinstance(rows, tuple):
                            values, sums, rows = values[rows[0]], sums[rows[0]], rows[1]
                        g2 = g * g
                        g2 += sums if rows is None else sums.take(rows, axis=0)
                        sums[... if rows is None else rows] = g2
                        g *= rate
                        g /= np.sqrt(g2, out=g2)
                        if rows is None:
                            values -= g
                        else:
                            values[rows] = np.subtract(values.take(rows, axis=0), g, out=g)
                net.flat -= flat  # what wasn't learned is 0, which compresses
                total += net.flat * np.float64(len(places))
                whole += len(places)
        if whole:
            total /= whole
            for k, at in enumerate(range(0, len(flat), PIECE)):
                yield piece_batch(k, whole, total[at : at + PIECE])

    return run


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of a task, in order, to one weighted mean for each."""
    key, weight, total = None, 0.0, np.zeros(0)
    for batch in batches:
        for piece, w, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != piece:
                if key is not None:
                    yield piece_batch(key, weight, total / weight)
                key, weight, total = piece, 0.0, np.zeros(len(values) // 4)
            weight += w
            total += np.frombuffer(values, np.float32) * np.float64(w)
    if key is not None:
        yield piece_batch(key, weight, total / weight)


def counted_words(docs: DataFrame) -> DataFrame:
    """word, n of all words of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            items = list(found.items())
            found.clear()
            for at in range(0, len(items), 50_000):
                some = items[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in some], pa.binary()), pa.array([n for _, n in some], pa.int64())], ["word", "n"])

        for _, texts in small_batches(batches, "text"):
            for text in texts:
                found.update(words_of(text))
            if len(found) > 200_000:
                yield from out()
        yield from out()

    return written(docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-words")


def read_vocabulary(docs: DataFrame, shape: Shape) -> tuple[Vocabulary, int]:
    """The vocabulary of the corpus, and the number of its words."""
    words = counted_words(docs)
    kinds = sorted((r["n"], r["kinds"]) for r in words.groupBy("n").agg(F.count(F.lit(1)).alias("kinds")).collect())  # different counts alone: fewer than twice the root of the words
    shape = shape.sized(sum(k for _, k in kinds))
    least, left = 0, shape.numbered
    for least, k in reversed(kinds):
        left -= k
        if left <= 0:
            break
    top = written(words.filter(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(shape.numbered), "lm-top").collect()  # in tasks, since the driver would get so many from each of them
    known = {bytes(r["word"]): r["n"] for r in sorted(top, key=lambda r: (-r["n"], bytes(r["word"])))}
    frame = Vocabulary([], [], np.zeros(0, np.int64), shape)

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(w, n) for w, n in zip(binary_column(batch, "word"), batch.column(1).to_pylist(), strict=True) if w not in known]
            yield pa.RecordBatch.from_arrays([pa.array(frame.cells_of([w for w, _ in found])), pa.array([n for _, n in found], pa.int64())], ["cell", "n"])

    cells = np.zeros(shape.cells + shape.shared_numbers, np.float32)
    counts = words.mapInArrow(celled, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    for batch in counts.select(F.col("cell").cast("int"), F.col("n").cast("float")).toArrow().to_batches():  # a row for each cell at most
        cells[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return Vocabulary(list(known), list(known.values()), cells, shape), sum(n * k for n, k in kinds)


def numbered_documents(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """docs (id, text) to row (a hash), id, numbers, shares."""
    shape = vocabulary.shape
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary.numbers, vocabulary.cells, vocabulary.total))  # plain data: a broadcast object's class would have to be installed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Vocabulary.of(shape, *sent.value)
        for batch, texts in small_batches(batches, "text"):
            read = [own.read(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x, _ in read], pa.binary()), pa.array([s for _, s in read], pa.float64())], ["row", "id", "numbers", "shares"])

    keyed = docs.select(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))).alias("row"), "id", "text")
    made = written(keyed.mapInArrow(run, f"row long, id {docs.schema['id'].dataType.simpleString()}, numbers binary, shares double"), "lm-numbers")
    sent.destroy()
    return made


def training_shards(documents: DataFrame, shape: Shape, n_words: int) -> DataFrame:
    """words of each shard, in one row: the numbers of its documents, by the hash of the row, with edges around them."""
    shards = max(1, n_words // shape.shard_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []
        for batch in batches:
            for this, numbers in zip(batch.column(0).to_pylist(), binary_column(batch, "numbers"), strict=True):
                if this != shard:
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array([joined(held, shape)[0].tobytes()], pa.binary())], ["words"])
                    shard, held = this, []
                held.append(numbers)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([joined(held, shape)[0].tobytes()], pa.binary())], ["words"])

    dealt = documents.select(F.pmod("row", F.lit(shards)).alias("shard"), "row", "numbers").repartition(shards, "shard").sortWithinPartitions("shard", "row", "numbers")
    return written(dealt.select("shard", "numbers").mapInArrow(run, "words binary"), "lm-shards")


def train_network(shards: DataFrame, vocabulary: Vocabulary) -> WindowNetwork:
    shape = vocabulary.shape
    net = WindowNetwork(shape).start_from(vocabulary.total)
    for this in range(shape.rounds):
        pieces = shards.mapInArrow(trained(shape, net.flat, this), PIECES_DDL)
        whole = sorted(pieces.repartition("piece").sortWithinPartitions("piece").mapInArrow(summed, PIECES_DDL).collect())  # one set of parameters
        if whole:
            net = WindowNetwork(shape, net.flat + np.concatenate([np.frombuffer(r["vals"], np.float32) for r in whole]))
    return net


def fit(docs: DataFrame, shape: Shape) -> tuple[DataFrame, Vocabulary, WindowNetwork]:
    """docs: id, text. The numbered documents, the vocabulary and the trained network."""
    vocabulary, n_words = read_vocabulary(docs, shape)
    documents = numbered_documents(docs, vocabulary)
    return documents, vocabulary, train_network(training_shards(documents, vocabulary.shape, n_words), vocabulary)


def score_numbers(lists: list[bytes], net: WindowNetwork) -> tuple[np.ndarray, np.ndarray]:
    """Words of each document and the summed log-probability of its numbers."""
    words, counts = joined(lists, net.shape)
    places = np.flatnonzero(words < net.shape.size)
    logs = np.empty(len(places))
    for at in range(0, len(places), 1 << 14):
        logs[at : at + (1 << 14)] = net.log_probability(words, places[at : at + (1 << 14)])
    ends = np.cumsum(counts)
    total = np.concatenate(([0.0], np.cumsum(logs)))
    return counts, total[ends] - total[ends - counts]


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shape: Shape = Shape()) -> DataFrame:
    """One row for each row of docs: id, n_words, log_likelihood, mean_log_likelihood."""
    documents, _, made = fit(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), shape)
    shape, flat = made.shape, made.flat  # sent once, without its parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = WindowNetwork(shape, flat)
        for batch, lists in small_batches(batches, "numbers"):
            counts, logs = score_numbers(lists, net)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(logs + batch.column(2).to_numpy())], ["id", "n_words", "log_likelihood"])

    found = documents.select("id", "numbers", "shares").mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, n_words long, log_likelihood double")
    return found.select(F.col("id").alias(id_col), "n_words", "log_likelihood", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")).alias("mean_log_likelihood"))
