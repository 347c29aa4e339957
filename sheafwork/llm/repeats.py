"""Substring deduplication over bytes: a run-length index.

A byte goes if it is covered by a string of `length` bytes that also starts anywhere else in the corpus, the same document
included. Strings are judged on the input.

1. Winnowing finds candidates without loss. Each string of `length` bytes is filed under the smallest hash of its 32-byte
   pieces, so equal strings are filed under one hash. Neighbouring strings of a document with one smallest hash form a
   context. Contexts leave a task once for each content, with their number; the others are known to repeat as a whole.
2. Contexts are dealt out by hash and content, so that no hash is gathered, and those of equal content repeat as a whole.
   Contents are counted by hash. A hash with a single content has no repeats, unless its smallest piece comes twice in it;
   of the others one context of each content goes on, with its bytes.
3. Those bytes are gathered by hash in blocks. Each block gets a run-length index: suffix array, run-compressed
   Burrows-Wheeler transform, and the suffix positions on both sides of each run's border with their common length.
   From one such sample the neighbour in suffix order and the common length of all later text positions follow, up to the
   next sample, so matching statistics of the block against the rest of itself are read off in text order. Positions with
   statistics of `length` or more are marked.
4. Marked strings are united for each document, and the rest of its bytes is put together.

A hash under which more than `block_bytes` of different contexts are filed does not go through an index: the strings of
its contexts are hashed (128 bits), once for each task, and dealt out by that hash. No number of contexts makes that too
large for a task.

Defined results: null and empty texts have no bytes. Every row is a document, so strings of rows that come twice repeat, also
if their identifiers are equal; rows of one identifier and different texts are told apart by the text. Null identifiers are
an identifier like others; identifiers that are no whole numbers are text. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafwork.llm.common import binary_column, id_kind, tasks, written
from sheafwork.llm.suffixes import suffix_array_of_bytes

PIECE = 32
PART = 1 << 22
GAP = b"\xff"  # no byte of UTF-8
END = b"\xfe" * 16


def piece_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each piece of 32 bytes: sums of doubling length, then mixed."""
    h = data.astype(np.uint64)
    factor, n = np.uint64(0x9E3779B97F4A7C15), 1
    with np.errstate(over="ignore"):
        while n < PIECE:
            h = h[:-n] * factor + h[n:]
            factor, n = factor * factor, n * 2
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each `width` neighbours, from running minima of blocks in both directions."""
    n = len(h)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max)
    padded[:n] = h
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def contexts(text: bytes, length: int) -> Iterator[tuple[int, int, int, bool]]:
    """Hash of each of a text's contexts, the first and last start of its strings, and whether its smallest piece comes twice, so that it may repeat within itself."""
    width = length - PIECE + 1
    for at in range(0, len(text) - length + 1, PART):  # parts of a very long text; a context that is cut in two is two contexts
        pieces = piece_hashes(np.frombuffer(text[at : at + PART + length - 1], np.uint8))
        least = sliding_min(pieces, width)
        first = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
        last = np.concatenate((first[1:], [len(least)])) - 1
        for h, signed, a, e in zip(least[first], least[first].view(np.int64).tolist(), first.tolist(), last.tolist(), strict=True):
            yield signed, at + a, at + e, bool(np.count_nonzero(pieces[a : e + width] == h) > 1)


FILED = pa.schema([("hash", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("id", pa.int64()), ("version", pa.int64()), ("a", pa.int32()), ("e", pa.int32()), ("inner", pa.bool_()), ("n", pa.int64())])
FILED_DDL = "hash long, c1 long, c2 long, id long, version long, a int, e int, inner boolean, n long"


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def filed_contexts(length: int, most: int = 150_000):
    """Documents (id, version, text) to contexts. n: rows of this content here; 0: a context known to repeat, filed anywhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, list] = {}
        for batch in batches:
            out: list[tuple] = []
            for text, i, version in zip(binary_column(batch, "text"), batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for h, a, e, inner in contexts(text, length):
                    c = xxhash.xxh3_128_digest(text[a : e + length])
                    own = seen.get((h, c))
                    if own is None:
                        seen[h, c] = [i, version, a, e, inner, 1]
                    else:
                        own[5] += 1
                        out.append((version ^ (a * 0x9E3779B1), 0, 0, i, version, a, e, False, 0))
                if len(out) >= 50_000:
                    yield table_of(out, FILED)
                    out = []
                if len(seen) >= most:
                    yield from drained(seen)
            yield table_of(out, FILED)
        yield from drained(seen)

    def drained(seen: dict[tuple, list]) -> Iterator[pa.RecordBatch]:
        rows = [(h, int.from_bytes(c[:8], "big", signed=True), int.from_bytes(c[8:], "big", signed=True), *x) for (h, c), x in seen.items()]
        for at in range(0, len(rows), 50_000):
            yield table_of(rows[at : at + 50_000], FILED)
        seen.clear()

    return run


FOUND = pa.schema([("hash", pa.int64()), ("id", pa.int64()), ("version", pa.int64()), ("a", pa.int32()), ("e", pa.int32()), ("inner", pa.bool_()), ("open", pa.bool_())])
FOUND_DDL = "hash long, id long, version long, a int, e int, inner boolean, open boolean"


def merged_contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by (hash, c1, c2) to those that repeat as a whole (hash null) and one of each content (open: whether it may hold repeats that aren't known)."""
    content: tuple | None = None
    held: tuple | None = None
    count = 0
    out: list[tuple] = []

    def end() -> None:
        if held is not None:
            h, i, version, a, e, inner = held
            if count > 1:
                out.append((None, i, version, a, e, False, False))
            out.append((h, i, version, a, e, inner, count == 1))

    for batch in batches:
        for h, c1, c2, i, version, a, e, inner, n in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if n == 0:
                out.append((None, i, version, a, e, False, False))
            elif (h, c1, c2) == content:
                out.append((None, i, version, a, e, False, False))
                count += n
            else:
                end()
                content, held, count = (h, c1, c2), (h, i, version, a, e, inner), n
        yield table_of(out, FOUND)
        out.clear()
    end()
    yield table_of(out, FOUND)


class RunLengthIndex:
    """Samples of a block's run-compressed transform: the suffix positions on both sides of each run's border, and their common length. The runs themselves aren't kept, as no step goes through them."""

    def __init__(self, data: bytes):
        text = np.frombuffer(data + END, np.uint8)
        n = len(data)
        order = suffix_array_of_bytes(text[: n + 1])  # with one end mark, which is as good as a symbol: without it a border can be missed
        bwt = text[: n + 1][order - 1]
        border = np.flatnonzero(bwt[1:] != bwt[:-1]) + 1  # between runs
        self.n = n
        self.last, self.first = order[border - 1], order[border]
        self.common = self._common(text, self.last, self.first)

    @staticmethod
    def _common(text: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Common lengths of suffixes, eight bytes at a step."""
        words = np.lib.stride_tricks.sliding_window_view(text, 8)[:, :].copy().view("<u8").ravel()
        length = np.zeros(len(p), np.int64)
        live = np.arange(len(p))
        top = len(words) - 1
        while len(live):
            at = length[live]
            differ = words[np.minimum(p[live] + at, top)] ^ words[np.minimum(q[live] + at, top)]
            same = differ == 0
            stop = live[~same]
            d = differ[~same]
            length[stop] += np.bitwise_count((d & (~d + np.uint64(1))) - np.uint64(1)).astype(np.int64) // 8
            live = live[same]
            length[live] += 8
            live = live[np.maximum(p[live], q[live]) + length[live] <= top]
        return length

    def statistics(self) -> np.ndarray:
        """For each text position the longest match that starts at another one: the larger of those with both neighbours in suffix order."""
        size = self.n + 1
        best, place = np.zeros(size, np.int64), np.arange(size)
        for samples in (self.first, self.last):
            at = np.full(size, -1, np.int64)
            common = np.zeros(size, np.int64)
            at[samples] = samples
            common[samples] = self.common
            at = np.maximum.accumulate(at)
            np.maximum(best, np.where(at >= 0, common[np.maximum(at, 0)] - (place - at), 0), out=best)
        return best[: self.n]


def runs_of(marked: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of true."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], marked.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


MARKS = pa.schema([("id", pa.int64()), ("version", pa.int64()), ("a", pa.int32()), ("e", pa.int32())])
MARKS_DDL = "id long, version long, a int, e int"


def index_blocks(length: int, block_bytes: int):
    """Contexts with bytes, sorted by hash, to the starts that repeat. A block holds whole hashes."""

    def marks(block: list[tuple]) -> list[tuple]:
        starts = np.cumsum([0] + [len(x[5]) + 1 for x in block])
        best = RunLengthIndex(GAP.join([x[5] for x in block]) + GAP).statistics()
        out = []
        for (_, i, version, a, is_open, data), at in zip(block, starts.tolist(), strict=False):
            if is_open:
                out += [(i, version, a + x, a + y) for x, y in runs_of(best[at : at + len(data) - length + 1] >= length)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []
        group: list[tuple] = []
        sizes = [0, 0]  # of the block and of the hash at hand
        key = None
        for batch in batches:
            out = []
            for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if row[0] != key:
                    if block and sizes[0] + sizes[1] > block_bytes:
                        out += marks(block)
                        block.clear()
                        sizes[0] = 0
                    block += group
                    sizes = [sizes[0] + sizes[1], 0]
                    group.clear()
                    key = row[0]
                group.append(row)
                sizes[1] += len(row[5]) + 1
            yield table_of(out, MARKS)
        if block + group:
            yield table_of(marks(block + group), MARKS)

    return run


STRINGS_DDL = "h1 long, h2 long, id long, version long, s int, a int, e int"


def string_hashes(length: int, most: int = 500_000):
    """Contexts with bytes to one row for each different string of the task (s set), and to the starts that repeat in the task (a, e set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for i, version, a, data in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                n = len(data) - length + 1
                digests = b"".join([xxhash.xxh3_128_digest(data[k : k + length]) for k in range(n)])
                held.append((i, version, a, np.frombuffer(digests, ">i8").astype(np.int64).reshape(n, 2)))
                size += n
                if size >= most:
                    yield from out(held)
                    held, size = [], 0
        if held:
            yield from out(held)

    def out(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        table = np.concatenate([h[3] for h in held])
        _, first, which, counts = np.unique(table, axis=0, return_index=True, return_inverse=True, return_counts=True)
        repeats = counts[which.ravel()] > 1
        ends = np.cumsum([0] + [len(h[3]) for h in held])
        rows = []
        owner = np.searchsorted(ends, first, "right") - 1
        for k, o, n in zip(first.tolist(), owner.tolist(), counts.tolist(), strict=True):
            i, version, a, own = held[o]
            # A string that repeats here is marked here; the row that stands for it is only there for other tasks.
            rows.append((int(table[k, 0]), int(table[k, 1]), i if n == 1 else None, version, a + k - int(ends[o]) if n == 1 else None, None, None))
        for (i, version, a, own), at in zip(held, ends.tolist(), strict=False):
            rows += [(version ^ (a + x), 0, i, version, None, a + x, a + y) for x, y in runs_of(repeats[at : at + len(own)])]
        kinds = [pa.int64()] * 4 + [pa.int32()] * 3
        names = ["h1", "h2", "id", "version", "s", "a", "e"]
        for at in range(0, len(rows), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + 100_000], strict=True), kinds, strict=True)], names)

    return run


def equal_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h1, h2) to the starts that repeat: those that are known, and those with a neighbour of the same hash."""
    last: tuple | None = None
    matched = False
    for batch in batches:
        out = []
        for h1, h2, i, version, s, a, e in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if a is not None:
                out.append((i, version, a, e))
                continue
            same = last is not None and (h1, h2) == last[:2]
            if last is not None and (same or matched) and last[4] is not None:
                out.append((last[2], last[3], last[4], last[4]))
            last, matched = (h1, h2, i, version, s), same
        yield table_of(out, MARKS)
    if last is not None and matched and last[4] is not None:
        yield table_of([(last[2], last[3], last[4], last[4])], MARKS)


def repeated_starts(docs: DataFrame, length: int, block_bytes: int) -> DataFrame:
    """docs: id, version, text. id, version, a, e: starts of strings that also start elsewhere."""
    n = tasks(docs.sparkSession)
    filed = docs.select("id", "version", "text").mapInArrow(filed_contexts(length), FILED_DDL)
    found = written(filed.repartition(n, "hash", "c1", "c2").sortWithinPartitions("hash", "c1", "c2").mapInArrow(merged_contents, FOUND_DDL), "repeat-found")
    starts = found.filter("hash is null").select("id", "version", "a", "e")
    contents = found.filter("hash is not null")
    by_hash = contents.groupBy("hash").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.col("e") - F.col("a") + length + 1).alias("bytes"), F.max("open").alias("any_open"), F.max(F.col("open") & F.col("inner")).alias("any_inner"))
    by_hash = written(by_hash.filter("any_open and kinds > 1 or any_inner").select("hash", (F.col("bytes") > block_bytes).alias("large")), "repeat-hashes")
    # Both sides are plain exchanges, so that a hash with very many contents is split over tasks.
    wanted = contents.join(by_hash, "hash").groupBy("id", "version").agg(F.collect_list(F.struct("hash", "a", "e", "open", "large")).alias("wanted"))  # of one document
    cut = docs.join(wanted, same_document(docs, wanted)).select(docs["id"], docs["version"], docs["text"].cast("binary").alias("text"), F.explode("wanted").alias("w"))
    cut = cut.select("w.hash", "id", "version", "w.a", "w.open", F.expr(f"substring(text, w.a + 1, w.e - w.a + {length})").alias("bytes"), "w.large")
    some_large = not by_hash.filter("large").isEmpty()
    if some_large:
        cut = written(cut, "repeat-cut")
        strings = cut.filter("large").select("id", "version", "a", "bytes").mapInArrow(string_hashes(length), STRINGS_DDL)
        starts = starts.unionByName(strings.repartition(n, "h1", "h2").sortWithinPartitions("h1", "h2").mapInArrow(equal_neighbours, MARKS_DDL))
        cut = cut.filter("not large")
    return starts.unionByName(cut.drop("large").repartition(n, "hash").sortWithinPartitions("hash").mapInArrow(index_blocks(length, block_bytes), MARKS_DDL))


def same_document(a: DataFrame, b: DataFrame):
    return a["id"].eqNullSafe(b["id"]) & (a["version"] == b["version"])


RESULT_DDL = "n_bytes long, n_removed long, spans array<struct<a:long,b:long>>, kept_sha256 string, kept binary"


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = 400, block_bytes: int = 900_000, texts: bool = True) -> DataFrame:
    """One row for each row of docs: id, n_bytes, n_removed, spans (byte ranges that are removed), kept_sha256 and, if `texts`, the kept bytes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = id_kind(docs, id_col)
    own = F.col(id_col).cast(kind)
    # Inside, a document goes by a whole number and the hash of its text. Where that is the identifier, no column is added: both joins then use one exchange.
    named = {"id": own} if kind == "long" else {"id": F.when(own.isNotNull(), F.xxhash64(own)), "own": own}
    narrow = docs.select(*[c.alias(n) for n, c in named.items()], F.xxhash64(text).alias("version"), text.alias("text"))
    starts = repeated_starts(narrow, length, block_bytes)
    marked = starts.groupBy("id", "version").agg(F.collect_list(F.struct("a", "e")).alias("starts"))  # of one document
    joined = narrow.join(marked, same_document(narrow, marked), "left").select(narrow[list(named)[-1]], narrow["text"], "starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, starts in zip(binary_column(batch, "text"), batch.column(2).to_pylist(), strict=True):
                spans: list[list[int]] = []
                for a, b in sorted((x["a"], x["e"] + length) for x in starts or ()):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
                parts, at = [], 0
                for a, b in spans:
                    parts.append(data[at:a])
                    at = b
                kept = b"".join([*parts, data[at:]])
                out.append((len(data), len(data) - len(kept), [{"a": a, "b": b} for a, b in spans], hashlib.sha256(kept).hexdigest(), kept if texts else None))
            yield pa.RecordBatch.from_arrays([batch.column(0), *table_of(out, RESULT).columns], ["id", *RESULT.names])

    return joined.mapInArrow(run, f"id {kind}, {RESULT_DDL}").withColumnRenamed("id", id_col)


RESULT = pa.schema([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def repeat_report(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256."""
    return without_repeats(docs, id_col, texts=False, **how).select(id_col, "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
