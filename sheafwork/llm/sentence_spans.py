"""Substring deduplication by sentences: sliding sentence spans.

Each sentence starts a span: as many consecutive sentences as are needed to have `sentences` of them and `words` words. With no
minimum of words, as the query has it, every longer repeated run is covered by its spans to its last sentence. Spans are hashed (128 bits, A-Z in lower case, white space as one space) and joined over the whole corpus; of spans with one hash
the first, by identifier and then by place, stays, and each sentence that a later one covers is removed.

A task takes its documents in slices, passes on the first span of each hash in a slice and knows at once that the slice's others are
later ones; so a span leaves a slice once, however often it is there. Spans are then dealt out by hash and sorted, which puts the first one in front: no
hash is gathered, and rows of one hash pass one at a time.

Sentences end after . ! or ? before white space, and at line ends. A sentence of over 40 words is cut in pieces, each of which
counts as a sentence; else text without marks could not repeat. With `pieces` the cuts are dense: after the word whose hash is the
least of seven consecutive words, for every seven. So equal passages have equal cuts from their seventh word on, none over seven
words apart, and `pieces` pieces weigh as much as `sentences` sentences. Spans are then the shortest runs that weigh enough,
from every start and to every end; every repeated run that weighs enough is covered by them whole. A removed sentence takes the white space after it along.

Defined results: null and empty texts have no sentences; texts that never reach a span's length have none and lose nothing.
Rows with the same identifier and the same text are one document, of which all rows lose the same sentences and none loses
them to the other; rows of one identifier and different texts are ordered by a hash of the text. Null identifiers come
first. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafwork.llm.common import binary_column, id_kind, tasks

BREAK = re.compile(rb"(?<=[.!?])\s+|\n\s*")


NOT_SPACE = re.compile(rb"\S+")
LONG = 40  # words


REACH = 7  # words


def sentences_of(text: bytes, dense: bool = False) -> list[tuple[int, int]]:
    """Start of each sentence and of the next one."""
    return [(a, b) for a, b, _ in parts_of(text, dense)]


def parts_of(text: bytes, dense: bool) -> list[tuple[int, int, bool]]:
    """Start of each sentence or piece and of the next one, and whether it is a piece."""
    edges = [0] + [m.end() for m in BREAK.finditer(text)]
    if edges[-1] != len(text):
        edges.append(len(text))
    out = []
    for a, b in zip(edges, edges[1:]):
        n = len(text[a:b].split()) if b - a > LONG else 1
        if n > LONG:
            out += [(x, y, True) for x, y in (dense_pieces if dense else pieces_of)(text, a, b)]
        elif n and text[a:b].strip():
            out.append((a, b, False))
    return out


def dense_pieces(text: bytes, a: int, b: int) -> list[tuple[int, int]]:
    words = [(m.start(), zlib.crc32(m[0].lower())) for m in NOT_SPACE.finditer(text, a, b)]
    hashes = np.array([h for _, h in words], np.int64)
    least = np.lib.stride_tricks.sliding_window_view(hashes, REACH)[:, ::-1].argmin(axis=1)  # the last of equal ones
    ends = np.unique(np.arange(len(least)) + REACH - 1 - least) + 1
    edges = [a, *[words[k][0] for k in ends.tolist() if k < len(words)], b]
    return list(zip(edges, edges[1:]))


def pieces_of(text: bytes, a: int, b: int) -> list[tuple[int, int]]:
    """A long sentence's pieces. They end after words with a certain hash, so that equal passages have equal ends, or else after LONG words."""
    out, start, n, ended = [], a, 0, False
    for m in NOT_SPACE.finditer(text, a, b):
        if ended:
            out.append((start, m.start()))
            start, n = m.start(), 0
        n += 1
        ended = n == LONG or zlib.crc32(m[0].lower()) % 16 == 0
    return [*out, (start, b)]


class Lists:
    """The parts of several texts, in one row of places: of each text its first and the one after its last, of each part its hash (two numbers), words and whether it is a piece."""

    def __init__(self, texts: list[bytes], dense: bool):
        digests, pieces, words, ends = [], [], [], [0]
        for text in texts:
            for a, b, piece in parts_of(text, dense):
                own = text[a:b].lower().split()
                digests.append(xxhash.xxh3_128_digest(b" ".join(own)))
                pieces.append(piece)
                words.append(len(own))
            ends.append(len(digests))
        self.digests = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
        self.pieces, self.words, self.ends = np.array(pieces, bool), np.array(words, np.int64), np.array(ends, np.int64)

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ends) - 1), np.diff(self.ends))

    def runs_by_words(self, least: int, words: int) -> tuple[np.ndarray, np.ndarray]:
        """First part and the one after the last of each text's shortest runs with so many parts and words, from every start."""
        total = np.concatenate(([0], np.cumsum(self.words)))
        starts = np.arange(len(self.words))
        ends = np.maximum(np.searchsorted(total, total[:-1] + words), starts + least)
        inside = ends <= self.ends[self.owners() + 1]
        return starts[inside], ends[inside]

    def runs_by_weight(self, sentences: int, pieces: int) -> tuple[np.ndarray, np.ndarray]:
        """The same by weight, of which `pieces` pieces have as much as `sentences` sentences, from every start and to every end."""
        total = np.concatenate(([0], np.cumsum(np.where(self.pieces, sentences, pieces))))
        starts, owners, enough = np.arange(len(self.words)), self.owners(), sentences * pieces
        ends = np.searchsorted(total, total[:-1] + enough)
        froms = np.searchsorted(total, total[1:] - enough, side="right") - 1
        ahead, back = ends <= self.ends[owners + 1], froms >= self.ends[owners]
        both = np.unique(np.concatenate((starts[ahead] << 32 | ends[ahead], froms[back] << 32 | starts[back] + 1)))
        return both >> 32, both & 0xFFFFFFFF

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of runs: sums of the parts' hashes times powers of an odd number by their place in the run, two of 64 bits, from sums over all parts."""
        out = np.empty((len(starts), 2), np.uint64)
        n = len(self.words)
        for k, (odd, inverse) in enumerate(BASES):
            up, down = (np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, x)))) for x in (odd, inverse))
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.digests[:, k] * up[:-1])))
            out[:, k] = (total[ends] - total[starts]) * down[starts]
        return out


#: Odd numbers and their inverses modulo 2^64.
BASES = [(np.uint64(x), np.uint64(pow(x, -1, 1 << 64))) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def rows_ddl(id_type: str) -> str:
    return f"h1 long, h2 long, id {id_type}, version long, at int, n int, later boolean"


def later_ddl(id_type: str) -> str:
    return f"id {id_type}, version long, at int, n int"


def rank_of(ids: pa.Array) -> np.ndarray:
    """Numbers that are in order as the identifiers are; null is first."""
    if ids.type == pa.string():
        return pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
    return np.where(np.asarray(ids.is_null()), np.iinfo(np.int64).min, np.asarray(ids.fill_null(0)))


SLICE = 8 << 20  # bytes of text whose spans are hashed at once


def text_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """About so many bytes of whole documents each."""
    for batch in batches:
        texts, a, size = binary_column(batch, "text"), 0, 0
        for b, text in enumerate(texts):
            size += len(text)
            if size >= SLICE or b + 1 == len(texts):
                yield batch.slice(a, b + 1 - a), texts[a : b + 1]
                a, size = b + 1, 0


def local_firsts(least: int, words: int, pieces: int = 0):
    """Documents (id, version, text) to the first span of each hash in the slice at hand, and to its later ones, which are dealt out anywhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            parts = Lists(texts, pieces > 0)
            starts, ends = parts.runs_by_weight(least, pieces) if pieces else parts.runs_by_words(least, words)
            h = parts.hashes(starts, ends).view(np.int64)
            owner = np.searchsorted(parts.ends, starts, "right") - 1
            at, n = starts - parts.ends[owner], ends - starts
            ids, versions = batch.column(0), np.asarray(batch.column(1))
            rank = rank_of(ids)
            order = np.lexsort((at, versions[owner], rank[owner], h[:, 1], h[:, 0]))
            h, owner, at, n = h[order], owner[order], at[order], n[order]
            new = np.ones(len(order), bool)
            new[1:] = (h[1:] != h[:-1]).any(axis=1)
            lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            place = (rank[owner], versions[owner], at)
            later = ~new & np.logical_or.reduce([x != x[lead] for x in place])
            h[later, 0], h[later, 1] = versions[owner[later]] ^ (at[later] * 0x9E3779B1), 0
            out = np.flatnonzero(new | later)
            for k in range(0, len(out), 50_000):
                some = out[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(h[some, 0]), pa.array(h[some, 1]), ids.take(pa.array(owner[some])), pa.array(versions[owner[some]]), pa.array(at[some].astype(np.int32)), pa.array(n[some].astype(np.int32)), pa.array(later[some])], NAMES)

    return run


NAMES = ["h1", "h2", "id", "version", "at", "n", "later"]


def later_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans sorted by hash, identifier, version and place to those that aren't their hash's first."""
    last: tuple | None = None  # the hash that the last batch ended with, and its first span
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2 = (batch.column(i).to_numpy() for i in range(2))
        known = batch.column(6).to_numpy(zero_copy_only=False)
        ids, version, at = batch.column(2), batch.column(3).to_numpy(), batch.column(4).to_numpy()
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        lead = np.maximum.accumulate(np.where(new, np.arange(len(h1)), 0))
        place = lambda k: (ids[k].as_py(), int(version[k]), int(at[k]))  # noqa: B023, E731
        rank = rank_of(ids)
        differs = np.logical_or.reduce([x != x[lead] for x in (rank, version, at)])
        goes_on = last is not None and last[0] == (h1[0], h2[0])
        if goes_on:  # the first group's lead is in an earlier batch
            k = int(np.searchsorted(lead, 1))
            i, v, p = last[1]
            same_id = np.asarray(ids.slice(0, k).is_null()) if i is None else np.asarray(pc.equal(ids.slice(0, k), i).fill_null(False))
            differs[:k] = ~(same_id & (version[:k] == v) & (at[:k] == p))
        if not (goes_on and lead[-1] == 0):
            last = ((h1[-1], h2[-1]), place(int(lead[-1])))
        out = pa.array(np.flatnonzero(known | differs))
        yield pa.RecordBatch.from_arrays([batch.column(i).take(out) for i in (2, 3, 4, 5)], ["id", "version", "at", "n"])


RESULT = pa.schema([("n_sentences", pa.int64()), ("n_removed", pa.int64()), ("bytes_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])
RESULT_DDL = "n_sentences long, n_removed long, bytes_removed long, kept_sha256 string, kept string"


def without_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, sentences: int = 2, words: int = 24, pieces: int = 0, texts: bool = True) -> DataFrame:
    """One row for each row of docs: id, n_sentences, n_removed, bytes_removed, kept_sha256 and, if `texts`, the kept text."""
    if words and pieces:
        raise ValueError("spans are by words or by pieces")
    n, dense, kind = tasks(docs.sparkSession), pieces > 0, id_kind(docs, id_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).cast(kind).alias("id"), F.xxhash64(text).alias("version"), text.alias("text"))
    spans = narrow.mapInArrow(local_firsts(sentences, words, pieces), rows_ddl(kind))
    later = spans.repartition(n, "h1", "h2").sortWithinPartitions("h1", "h2", "id", "version", "at").mapInArrow(later_spans, later_ddl(kind))
    gone = later.groupBy("id", "version").agg(F.collect_list(F.struct("at", "n")).alias("gone"))  # of one document's sentences
    joined = narrow.join(gone, narrow["id"].eqNullSafe(gone["id"]) & (narrow["version"] == gone["version"]), "left").select(narrow["id"], narrow["text"], "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data in text_slices(batches):
            out = []
            for text, own in zip(data, batch.column(2).to_pylist(), strict=True):
                parts = sentences_of(text, dense)
                marked = np.zeros(len(parts) + 1, np.int64)
                for x in own or ():
                    marked[x["at"]] += 1
                    marked[x["at"] + x["n"]] -= 1
                removed = np.flatnonzero(np.cumsum(marked[:-1]) > 0).tolist()
                kept, at = [], 0
                for k in removed:
                    a, b = parts[k]
                    kept.append(text[at:a])
                    at = b
                rest = b"".join([*kept, text[at:]]) if removed else text
                out.append((len(parts), len(removed), len(text) - len(rest), hashlib.sha256(rest).hexdigest(), rest.decode() if texts else None))
            made = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), RESULT, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["id", *RESULT.names])

    return joined.mapInArrow(run, f"id {kind}, {RESULT_DDL}").withColumnRenamed("id", id_col)


def span_report(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """id, n_sentences, n_removed, bytes_removed, kept_sha256."""
    return without_spans(docs, id_col, texts=False, **how).drop("kept")
