"""Exact deduplication: Patricia-trie owners.

Texts are dealt out by their length and a hash of their content. A compressed radix trie over whole byte strings decides
equality; each terminal node holds the smallest and the largest identifier and the number of rows that reached it.

1. Each task of the scan inserts its own texts into a trie and passes on one copy of each different text, with the number
   and the extreme identifiers of its rows. However many rows share a text, it leaves a task once for each time that the
   trie was spilled. A trie over its budget spills its largest subtree: the terminals are emitted and forgotten, and a
   later row with the same text starts a new one.
2. The copies are dealt out by (length, hash), sorted, and inserted in one trie for each key, which merges the terminals.
3. Each row finds its class by the copy that stood for it. No class is ever gathered in one task.

Defined results: a null text is an empty text, so null and empty texts are one class. Repeated rows and repeated
identifiers count as rows; if rows of one text share the owner's identifier, all of them have `kept` true. An empty table
gives an empty result. Other columns are ignored. Null identifiers: such a row is a row of its class, and never its owner
unless all its rows have none. Identifiers that are no whole numbers are text, in order of their code points.
"""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafwork.llm.common import arrow_id, binary_column, id_kind, tasks, written


class Terminal:
    """What a text's node holds: the row that stands for it here, the extreme identifiers and the number of rows."""

    __slots__ = ("copy", "hi", "lo", "rows")

    def __init__(self, copy: int, rows: int, lo: int | None, hi: int | None):
        self.copy, self.rows, self.lo, self.hi = copy, rows, lo, hi

    def merge(self, rows: int, lo: int | None, hi: int | None) -> None:
        self.rows += rows
        if lo is not None:
            self.lo = lo if self.lo is None or lo < self.lo else self.lo
            self.hi = hi if self.hi is None or hi > self.hi else self.hi


def shared_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving over slices, so that the bytes are compared in C."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class PatriciaTrie:
    """A compressed radix trie over byte strings. A node is [label, children by first byte, terminal]."""

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]
        self.size = 0

    def find(self, text: bytes, copy: int) -> tuple[Terminal, bool]:
        """The text's terminal, made if it wasn't there."""
        node, at = self.root, 0
        while True:
            if at == len(text):
                break
            child = node[1].get(text[at])
            if child is None:
                node[1][text[at]] = child = [text[at:], {}, None]
                self.size += len(text) - at + 400
                node = child
                break
            label = child[0]
            if text.startswith(label, at):
                node, at = child, at + len(label)
                continue
            n = shared_prefix(label, text[at : at + len(label)])
            middle = [label[:n], {label[n]: child}, None]
            child[0] = label[n:]
            node[1][text[at]] = middle
            self.size += 400
            node, at = middle, at + n
        new = node[2] is None
        if new:
            node[2] = Terminal(copy, 0, None, None)
        return node[2], new

    def spill(self) -> Iterator[tuple[bytes, Terminal]]:
        """Take out the largest subtree below the root, and the root's own terminal."""
        if self.root[2] is not None:
            yield b"", self.root[2]
            self.root[2] = None
        if self.root[1]:
            first = max(self.root[1], key=lambda k: self._bytes(self.root[1][k]))
            taken = self.root[1].pop(first)
            self.size -= self._bytes(taken)
            yield from self._walk(taken)

    def drain(self) -> Iterator[tuple[bytes, Terminal]]:
        yield from self._walk(self.root)
        self.root, self.size = [b"", {}, None], 0

    @staticmethod
    def _bytes(node: list) -> int:
        total, stack = 0, [node]
        while stack:
            x = stack.pop()
            total += len(x[0]) + 400
            stack.extend(x[1].values())
        return total

    @staticmethod
    def _walk(node: list) -> Iterator[tuple[bytes, Terminal]]:
        stack = [(node, b"")]
        while stack:
            x, before = stack.pop()
            text = before + x[0]
            if x[2] is not None:
                yield text, x[2]
            stack.extend((child, text) for child in x[1].values())


def local_schema(kind: str) -> tuple[pa.Schema, str]:
    """For identifiers of a kind: in Arrow, and as DDL."""
    own, whole = arrow_id(kind), pa.int64()
    schema = pa.schema([("row", whole), ("id", own), ("copy", whole), ("sha", pa.string()), ("length", whole), ("hash", whole), ("text", pa.binary()), ("rows", whole), ("lo", own), ("hi", own)])
    return schema, f"row long, id {kind}, copy long, sha string, length long, hash long, text binary, rows long, lo {kind}, hi {kind}"


def local_owners(budget: int, kind: str):
    """Rows of a task to (a) a narrow record for each row and (b) one record with text for each different text."""
    schema = local_schema(kind)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie()
        keys: dict[int, tuple[int, int]] = {}

        def copies(found) -> Iterator[pa.RecordBatch]:
            some, held = [], 0
            for text, t in found:
                length, hashed = keys.pop(t.copy)
                some.append((None, None, t.copy, None, length, hashed, text, t.rows, t.lo, t.hi))
                held += len(text)
                if held > 4 << 20 or len(some) >= 10_000:
                    yield batch_of(some, schema)
                    some, held = [], 0
            if some:
                yield batch_of(some, schema)

        for batch in batches:
            ids, rows, hashes = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("id", "row", "hash"))
            out = []
            for text, i, row, hashed in zip(binary_column(batch, "text"), ids, rows, hashes, strict=True):
                terminal, new = trie.find(text, row)
                if new:
                    keys[row] = (len(text), hashed)
                terminal.merge(1, i, i)
                out.append((row, i, terminal.copy, hashlib.sha256(text).hexdigest(), None, None, None, None, None, None))
            yield batch_of(out, schema)
            while trie.size > budget:
                yield from copies(trie.spill())
        yield from copies(trie.drain())

    return run


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class Spilled:
    """Strings of one key that don't fit: (copy, rows, lo, hi, text) by first byte of the text, in files that go with the object."""

    def __init__(self) -> None:
        self.folder = tempfile.TemporaryDirectory()
        self.files: dict[int, object] = {}

    def add(self, text: bytes, copy: int, rows: int, lo, hi) -> None:
        first = text[0] if text else 256
        if first not in self.files:
            self.files[first] = open(os.path.join(self.folder.name, str(first)), "w+b")  # noqa: SIM115
        self.files[first].write(json.dumps([copy, rows, lo, hi, len(text)]).encode() + b"\n" + text)

    def each(self) -> Iterator[Iterator[tuple]]:
        for f in self.files.values():
            f.seek(0)
            yield self._rows(f)
            f.close()
        self.folder.cleanup()

    @staticmethod
    def _rows(f) -> Iterator[tuple]:
        while head := f.readline():
            copy, rows, lo, hi, n = json.loads(head)
            yield f.read(n), copy, rows, lo, hi


def global_owners(budget: int, kind: str):
    """Copies of a task, sorted by (length, hash), to each copy's class. A trie holds one key's texts and goes with the key."""
    schema = pa.schema([("copy", pa.int64()), ("lo", arrow_id(kind)), ("hi", arrow_id(kind)), ("rows", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, reached, spilled, key = PatriciaTrie(), [], None, None

        def insert(text, copy, rows, lo, hi, t, to) -> None:
            terminal, _ = t.find(text, copy)
            terminal.copy = min(terminal.copy, copy)
            terminal.merge(rows, lo, hi)
            to.append((copy, terminal))

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal trie, reached, spilled
            if reached:
                yield batch_of([(c, t.lo, t.hi, t.rows) for c, t in reached], schema)
            if spilled is not None:
                for rows in spilled.each():
                    t, to = PatriciaTrie(), []
                    for x in rows:
                        insert(*x, t, to)
                    yield batch_of([(c, k.lo, k.hi, k.rows) for c, k in to], schema)
                spilled = None
            trie, reached = PatriciaTrie(), []

        for batch in batches:
            rest = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("length", "hash", "copy", "rows", "lo", "hi")]
            held = []
            for text, length, hashed, copy, rows, lo, hi in zip(binary_column(batch, "text"), *rest, strict=True):
                if key != (length, hashed):
                    if trie.size > 1 << 16 or len(reached) > 1000 or spilled is not None:
                        yield from done()
                    elif reached:
                        held += [(c, t) for c, t in reached]
                        trie, reached = PatriciaTrie(), []
                    key = (length, hashed)
                if spilled is None and trie.size > budget:
                    spilled = Spilled()  # the terminals that exist stay in memory; only texts that no terminal matches go to files
                if spilled is not None and not known(trie, text):
                    spilled.add(text, copy, rows, lo, hi)
                else:
                    insert(text, copy, rows, lo, hi, trie, reached)
            if held:
                yield batch_of([(c, t.lo, t.hi, t.rows) for c, t in held], schema)
        yield from done()

    return run


def known(trie: PatriciaTrie, text: bytes) -> bool:
    node, at = trie.root, 0
    while at < len(text):
        child = node[1].get(text[at])
        if child is None or not text.startswith(child[0], at):
            return False
        node, at = child, at + len(child[0])
    return node[2] is not None


def exact_owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, keep: str = "smallest", trie_mb: int = 64) -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, text_sha256.

    keep: whether the row with the smallest or the largest identifier of equal texts stays. trie_mb: what a task's trie may hold.
    """
    budget = trie_mb << 20
    kind = id_kind(docs, id_col)
    narrow = docs.select(F.col(id_col).cast(kind).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = narrow.select("id", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    local = written(keyed.mapInArrow(local_owners(budget, kind), local_schema(kind)[1]), "exact-local")
    n = tasks(docs.sparkSession)
    copies = local.filter("text is not null").select("length", "hash", "copy", "text", "rows", "lo", "hi").repartition(n, "length", "hash").sortWithinPartitions("length", "hash")
    classes = copies.mapInArrow(global_owners(budget, kind), f"copy long, lo {kind}, hi {kind}, rows long")
    owner = "lo" if keep == "smallest" else "hi"
    members = local.filter("row is not null").select("id", "copy", "sha")
    out = members.join(classes.select("copy", F.col(owner).alias("keep_id"), F.col("rows").alias("group_size")), "copy")
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that stay, with all their columns; one identifier stands for one row here."""
    stay = exact_owners(docs, id_col, text_col, **how).filter("kept").select(F.col(id_col).alias("__stay"))
    return docs.join(stay.distinct(), F.col(id_col).eqNullSafe(F.col("__stay")), "left_semi")
