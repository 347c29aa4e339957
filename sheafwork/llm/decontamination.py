"""Benchmark decontamination: an FM-index for each training shard.

A training shard is a bounded piece of a task's documents. Words that no benchmark item has become separators, and so do
joints that are no pair of neighbouring words in any item; stretches shorter than the shortest test phrase cannot hold one
and are left out. What is left, equal stretches once, is indexed: suffix array, Burrows-Wheeler transform, wavelet matrix
for ranks, and every eighth suffix position. All test phrases are searched backwards at once; their occurrences are located
by walking to a sampled position; and the occurrences' spans are merged for each document. Nothing is shuffled.

Test phrases: all runs of `window` consecutive words of an item; an item of fewer words is one phrase. Words are runs of
digits, a-z (A-Z in lower case) and characters beyond ASCII.

A benchmark over `block_mb` of text is taken in blocks, one pass for each; each pass adds to the spans found before.

Defined results: null and empty texts have no words and no hits. Items without words have no phrases; repeated items count
once by identifier; items without an identifier mark spans and aren't counted. Identifiers that are no whole numbers are text. Repeated documents are rows of their own.
Empty tables give empty or hitless results. Other columns are passed on if asked for, and ignored else.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafwork.llm.common import arrow_id, binary_column, id_kind
from sheafwork.llm.suffixes import suffix_array

WORD = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
#: Bytes of words stay, A-Z get lower case, all others become spaces: as long as the text.
FOLD = bytes(x if x in WORD else x + 32 if 65 <= x <= 90 else 32 for x in range(256))
SAMPLE = 8
SHARD_BYTES = 24 << 20
SHARD_WORDS = 1 << 20
BLOCK_UNIT = 1 << 20


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        return 0


class Phrases:
    """The test phrases of a block of items: word numbers from 1, the different phrases by length, and their items."""

    def __init__(self, items: list[tuple[int | str | None, bytes]], window: int):
        self.vocabulary = Vocabulary()
        owners: dict[tuple[int, ...], set] = {}
        pairs: set[tuple[int, int]] = set()
        for item, text in items:
            numbers = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            pairs.update(zip(numbers, numbers[1:]))
            for at in range(max(1, len(numbers) - window + 1) if numbers else 0):
                owners.setdefault(tuple(numbers[at : at + window]), set()).add(item)
        self.phrases = list(owners)
        self.owners = [sorted(x for x in o if x is not None) for o in owners.values()]
        self.lengths = np.array([len(p) for p in self.phrases], np.int64)
        self.table = np.zeros((len(self.phrases), window), np.int64)
        for i, p in enumerate(self.phrases):
            self.table[i, : len(p)] = p
        self.shortest = int(self.lengths.min()) if len(self.phrases) else 0
        self.base = len(self.vocabulary) + 1
        self.pairs = np.array(sorted(a * self.base + b for a, b in pairs), np.int64)

    def joined(self, numbers: np.ndarray) -> np.ndarray:
        """Whether each word and the next are neighbours in some item."""
        if not len(self.pairs):
            return np.zeros(max(0, len(numbers) - 1), bool)
        code = numbers[:-1] * self.base + numbers[1:]
        at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        return (self.pairs[at] == code) & (numbers[:-1] > 0)

    def stretches(self, numbers: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches of a document that could hold a phrase."""
        if not len(numbers) or not self.shortest:
            return
        known = numbers > 0
        new = known.copy()
        new[1:] &= ~self.joined(numbers)
        starts = np.flatnonzero(new)
        ends_at = known.copy()
        ends_at[:-1] &= ~np.concatenate((self.joined(numbers), []))[: len(numbers) - 1].astype(bool)
        ends = np.flatnonzero(ends_at) + 1
        fit = ends - starts >= self.shortest
        yield from zip(starts[fit].tolist(), ends[fit].tolist(), strict=True)


class WaveletMatrix:
    """Ranks of symbols in a sequence, for many symbols and places at once."""

    def __init__(self, seq: np.ndarray):
        self.levels = max(1, int(seq.max(initial=0)).bit_length())
        self.before, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (seq >> level) & 1
            self.before.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))))
            self.zeros.append(len(seq) - int(self.before[-1][-1]))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often the symbol is among the first `at`."""
        low, high = np.zeros_like(at), at.copy()
        for depth, (ones, zeros) in enumerate(zip(self.before, self.zeros, strict=True)):
            bit = (symbol >> (self.levels - 1 - depth)) & 1
            low = np.where(bit, zeros + ones[low], low - ones[low])
            high = np.where(bit, zeros + ones[high], high - ones[high])
        return high - low


class FMIndex:
    """Index of a sequence of numbers from 1, with 0 as separator."""

    def __init__(self, seq: np.ndarray):
        seq = np.concatenate((seq + 1, [0]))  # an end that is smaller than all
        order = suffix_array(seq)
        self.bwt = seq[order - 1]
        self.ranks = WaveletMatrix(self.bwt)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(seq))))
        self.sampled = order % SAMPLE == 0
        self.samples = order[self.sampled]
        self.sample_rank = np.concatenate(([0], np.cumsum(self.sampled)))

    def search(self, table: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of rows that begin with each phrase."""
        low, high = np.zeros(len(table), np.int64), np.full(len(table), len(self.bwt), np.int64)
        for back in range(1, table.shape[1] + 1):
            live = np.flatnonzero((back <= lengths) & (low < high))
            symbol = table[live, lengths[live] - back] + 1
            known = symbol < len(self.first) - 1
            none, live, symbol = live[~known], live[known], symbol[known]
            low[none] = high[none] = 0
            low[live], high[live] = (self.first[symbol] + self.ranks.rank(symbol, x[live]) for x in (low, high))
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the sequence of the suffixes at these rows."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        while True:
            walk = np.flatnonzero(~self.sampled[rows])
            if not len(walk):
                return self.samples[self.sample_rank[rows]] + steps
            symbol = self.bwt[rows[walk]]
            rows[walk] = self.first[symbol] + self.ranks.rank(symbol, rows[walk])
            steps[walk] += 1


class Shard:
    """Stretches of a bounded piece of the documents, and the hits found in them."""

    def __init__(self, phrases: Phrases):
        self.phrases = phrases
        self.places: dict[bytes, list[tuple[int, int]]] = {}
        self.kept: list[np.ndarray] = []
        self.size = 0

    def add(self, doc: int, numbers: np.ndarray) -> None:
        for a, b in self.phrases.stretches(numbers):
            own = numbers[a:b]
            where = self.places.setdefault(own.tobytes(), [])
            if not where:
                self.kept.append(own)
                self.size += b - a + 1
            where.append((doc, a))

    def hits(self) -> Iterator[tuple[int, int, int, int]]:
        """(document, first word, word after the last, phrase) of each occurrence."""
        if not self.kept:
            return
        lengths = np.array([len(x) + 1 for x in self.kept])
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        index = FMIndex(np.concatenate([np.append(x, 0) for x in self.kept]))
        low, high = index.search(self.phrases.table, self.phrases.lengths)
        found = np.flatnonzero(high > low)
        if not len(found):
            return
        counts = (high - low)[found]
        phrase = np.repeat(found, counts)
        rows = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low[found], counts)
        at = index.locate(rows)
        stretch = np.searchsorted(starts, at, "right") - 1
        all_places = list(self.places.values())
        for s, offset, p in zip(stretch.tolist(), (at - starts[stretch]).tolist(), phrase.tolist(), strict=True):
            n = int(self.phrases.lengths[p])
            for doc, a in all_places[s]:
                yield doc, a + offset, a + offset + n, p


def merged(spans: np.ndarray) -> np.ndarray:
    """Spans (first, after last) in order, those that overlap or touch as one."""
    if len(spans) < 2:
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate(([True], spans[1:, 0] > reach[:-1]))
    return np.stack((spans[new, 0], reach[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(spans) - 1]))]), axis=1)


def byte_spans(text: bytes, spans: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges of spans of words."""
    ends = [(m.start(), m.end()) for m in re.finditer(rb"[^ ]+", text.translate(FOLD))]
    return [(ends[a][0], ends[b - 1][1]) for a, b in spans.tolist()]


def without(text: bytes, ranges: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in ranges:
        parts.append(text[at:a])
        at = b
    return b"".join([*parts, text[at:]])


def results_of(kind: str) -> tuple[pa.Schema, str]:
    """Columns of the results for items whose identifiers are of a kind: in Arrow, and as DDL."""
    schema = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(arrow_id(kind))), ("spans", pa.binary()), ("clean_text", pa.string())])
    return schema, f"n_words long, n_hit long, items array<{kind}>, spans binary, clean_text string"


def scan(phrases: Phrases, names: list[str], clean: bool, last: bool, results: pa.Schema):
    """Rows with text, spans and items so far, to rows with the spans and items of this block's phrases too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.RecordBatch, list[bytes], list[int]]] = []
        shard, size = Shard(phrases), 0

        def flush() -> Iterator[pa.RecordBatch]:
            found: dict[int, list[tuple[int, int]]] = {}
            owners: dict[int, set[int]] = {}
            for doc, a, b, p in shard.hits():
                found.setdefault(doc, []).append((a, b))
                owners.setdefault(doc, set()).update(phrases.owners[p])
            base = 0
            for batch, texts, counts in held:
                spans, items = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("spans", "items"))
                for i in range(len(texts)):
                    if base + i in found:
                        old = np.frombuffer(spans[i], np.int64).reshape(-1, 2)
                        spans[i] = merged(np.concatenate((old, np.array(found[base + i], np.int64)))).tobytes()
                        items[i] = sorted(set(items[i]) | owners[base + i])
                hits = [int(np.diff(np.frombuffer(s, np.int64).reshape(-1, 2)).sum()) for s in spans]
                kept: list = [None] * len(texts)
                if clean and last:
                    kept = batch.column(batch.schema.get_field_index("text")).to_pylist()
                    for i, s in enumerate(spans):
                        if s:
                            kept[i] = without(texts[i], byte_spans(texts[i], np.frombuffer(s, np.int64).reshape(-1, 2))).decode()
                made = [pa.array(x, f.type) for x, f in zip((counts, hits, items, spans, kept), results, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in names] + made, [*names, *results.names])
                base += len(texts)

        docs = 0
        for batch in batches:
            texts, counts = binary_column(batch, "text"), []
            for text in texts:
                words = words_of(text)
                counts.append(len(words))
                if len(words) >= phrases.shortest > 0:
                    shard.add(docs, np.fromiter(map(phrases.vocabulary.__getitem__, words), np.int64, len(words)))
                docs += 1
                size += len(text)
            held.append((batch, texts, counts))
            if size >= SHARD_BYTES or shard.size >= SHARD_WORDS:
                yield from flush()
                held, shard, size, docs = [], Shard(phrases), 0, 0
        yield from flush()

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", *, window: int = 10, keep: list[str] | None = None, clean: bool = False, block_mb: int = 4, prefix: str = "") -> DataFrame:
    """One row for each row of docs: the kept columns (by default the identifier), n_words, n_hit, items, word spans (pairs of
    longs, first word and word after the last) and, if `clean`, the text without the hit words. prefix: before the results' names."""
    keep = [id_col] if keep is None else keep
    kind = id_kind(benchmark, item_col)
    made, ddl = results_of(kind)
    items = benchmark.select(F.col(item_col).cast(kind).alias("item"), F.col("text").alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-size // (block_mb * BLOCK_UNIT)))
    names = [f"__keep{i}" for i in range(len(keep))]
    kinds = [docs.schema[c].dataType for c in keep]
    state = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col(text_col).alias("text"), F.lit(b"").alias("spans"), F.array().cast(f"array<{kind}>").alias("items"))
    for b in range(blocks):
        own = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        phrases = Phrases([(r["item"], (r["text"] or "").encode()) for r in own.collect()], window)  # a block's size is bounded
        last = b == blocks - 1
        carried = names if last else [*names, "text"]
        kept = [T.StructField(n, k) for n, k in zip(names, kinds, strict=True)] + ([] if last else [T.StructField("text", T.StringType())])
        schema = T.StructType(kept + T.StructType.fromDDL(ddl).fields)
        state = state.select(*names, "text", "spans", "items").mapInArrow(scan(phrases, carried, clean, last, made), schema)
    results = ["n_words", "n_hit", "items", "spans", *(["clean_text"] if clean else [])]
    return state.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], *[F.col(n).alias(prefix + n) for n in results])


def leak_report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_leaks(docs, benchmark, id_col, **how)
    joined = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
