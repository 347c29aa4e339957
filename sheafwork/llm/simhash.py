"""SimHash near-deduplication: covering locality-sensitive hashing.

Each text gets a fingerprint: bit b is 1 if it is set in over half of the hashes of the text's features. Fingerprints within
`radius` bits are linked; components of links are the groups.

Covering masks: each of the 64 bits gets a nonzero vector of radius + 1 bits, and each nonzero vector v of as many bits
gives one table, whose key is the fingerprint's bits with an odd product with v. The vectors of `radius` differing bits
span less than the whole space, so some v has an even product with all of them: in that table the two keys are equal.
So every pair within the radius meets in some of the 2^(radius + 1) - 1 tables; nothing rests on chance.

Only different fingerprints enter the tables, however many rows share one. A bucket's fingerprints are compared in blocks
and only a spanning forest of the links leaves the task, never all pairs. A bucket over `bucket_limit` fingerprints is dealt
out again, with nothing dropped: each of its fingerprints is sent to all points within `near` bits of it, half the radius rounded
down, and to those within `far` bits, the rest of the radius. Two fingerprints are within the radius just if one has a near
point that is a far point of the other, so all that meet in a point that is near for someone are linked to that one.

With a similarity (see Similar), pairs are decided by the Jaccard similarity of their texts' sets of shingles. Candidates
are what meets in the covering tables of the shingles' fingerprint or in one of the bands of min-wise hashes of the same shingles,
which depend on the similarity alone and not on the kind of edit. A bucket of few texts gives its pairs. In a larger one all
are compared with one of them. What still stands in different components of a bucket then is compared in blocks, by one byte of
each min-wise hash, blocks of the bucket's largest component only with blocks of the others; pairs that agree in about as many
bytes as alike ones do are decided there, and only links leave the task. So a group of many copies costs a comparison for each copy and bucket.

Components come from a distributed forest of smallest neighbours, of which each round is written to the shared folder.

Defined results: null and empty texts, and texts without words, have fingerprint 0, which is linked like any other. Texts of
fewer words than a shingle have one feature, all their words. Repeated rows share a fingerprint and so a component. Null
identifiers are kept and don't count for a component's smallest, unless all its identifiers are null. An empty table gives
an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafwork.llm.common import binary_column, tasks, written

HASH_SEED = 42


@dataclass(frozen=True)
class Similar:
    """Linked if the sets of shingles of `shingle` words, told apart by hashes of 64 bits, have a Jaccard similarity of `least` or more.

    A pair of similarity j agrees in a min-wise hash with probability j, so it misses all `bands` bands of `rows` hashes with
    (1 - j ** rows) ** bands: 6e-8 at 0.8, less above. Buckets of up to `few` texts give pairs. In larger ones, pairs that agree in
    a share of `hopeful` of all hashes are decided, in blocks of `block`; one of 0.8 agrees in less than 0.68 of 210 with a chance of 1e-5.
    """

    shingle: int = 5
    least: float = 0.8
    bands: int = 42
    rows: int = 5
    few: int = 16
    block: int = 256
    hopeful: float = 0.68


def word_list(text: bytes) -> list[bytes]:
    """Words of a text: A-Z in lower case, parted by space and \\x09-\\x0D."""
    return text.lower().split()


def majority(hashes: np.ndarray, bits: int) -> bytes:
    """Bits set in over half the rows; hashes: bytes, big end first."""
    n = len(hashes) // (bits // 8)
    if n == 0:
        return bytes(bits // 8)
    total = np.zeros(bits, np.int64)
    table = hashes.reshape(n, bits // 8)
    for at in range(0, n, 4096):  # a bounded piece of a very long text at a time
        total += np.unpackbits(table[at : at + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > n).tobytes()


def joined_shingles(words: list[bytes], k: int) -> list[bytes]:
    """All runs of k words, each joined by a space, cut from one joined string; fewer words: all of them."""
    if not words:
        return []
    whole = b" ".join(words)
    if len(words) <= k:
        return [whole]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1])).tolist()
    ends = (ends - 1).tolist()
    return [whole[a:b] for a, b in zip(starts, ends[k - 1 :])]


def features(text: bytes, shingle: int) -> list[bytes]:
    """shingle 0: the different words, once each; else the runs of so many words, repeats included."""
    words = word_list(text)
    return sorted(set(words)) if shingle == 0 else joined_shingles(words, shingle)


def fingerprint(text: bytes, shingle: int) -> int:
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(x, HASH_SEED) for x in features(text, shingle)], ">u8").view(np.uint8)
    return int.from_bytes(majority(hashes, 64), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def id_kind(docs: DataFrame, id_col: str) -> str:
    """Identifiers are whole numbers or else text."""
    return "long" if isinstance(docs.schema[id_col].dataType, T.IntegralType) else "string"


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """id, fp (as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([signed(fingerprint(t, shingle)) for t in binary_column(batch, "text")], pa.int64())], ["id", "fp"])

    kind = id_kind(docs, id_col)
    return docs.select(F.col(id_col).cast(kind).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def covering_masks(radius: int) -> list[int]:
    """One mask for each nonzero vector of radius + 1 bits. Bits' vectors go round all nonzero ones, so masks are even."""
    top = (1 << (radius + 1)) - 1
    vector = [i % top + 1 for i in range(64)]
    return [sum(1 << i for i in range(64) if (vector[i] & v).bit_count() & 1) for v in range(1, top + 1)]


def root(parent: dict[int, int], x: int) -> int:
    while parent.setdefault(x, x) != x:
        parent[x] = x = parent[parent[x]]
    return x


def unite(parent: dict[int, int], a: int, b: int) -> None:
    a, b = root(parent, a), root(parent, b)
    if a != b:
        parent[max(a, b)] = min(a, b)


def link_block(node: np.ndarray, fp: np.ndarray, radius: int, parent: dict[int, int]) -> None:
    """Unite the nodes of a bucket that are linked. Labels are kept as an array, so that a dense bucket costs no union for each pair."""
    label = np.arange(len(fp))
    for i in range(1, len(fp)):
        own = label[:i][np.bitwise_count(fp[:i] ^ fp[i]) <= radius]
        if len(own):
            first = own.min()
            if (own != first).any():
                label[:i][np.isin(label[:i], own)] = first
            label[i] = first
    for i in np.flatnonzero(label != np.arange(len(fp))).tolist():
        unite(parent, int(node[i]), int(node[label[i]]))


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("fp", pa.int64())])
LINKS_DDL = "a long, b long, fp long"


def forest_batch(parent: dict[int, int]) -> pa.RecordBatch:
    pairs = [(root(parent, x), x) for x in list(parent)]
    pairs = [(a, b) for a, b in pairs if a != b]
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64()), pa.nulls(len(pairs), pa.int64())], schema=LINKS)


def bucket_links(radius: int, limit: int):
    """Rows (bucket, node, fp) sorted by bucket to links; the rows of a bucket over the limit go through, without a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}
        held: list[tuple] = []  # arrays of the bucket that may go on in the next batch
        over = None  # a bucket that is passed through

        def passed(_, node, fp) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(node), pa.nulls(len(node), pa.int64()), pa.array(fp.view(np.int64))], schema=LINKS)

        def finish() -> None:
            if len(held) > 1 or held and len(held[0][1]) > 1:
                link_block(*(np.concatenate([h[i] for h in held]) for i in (1, 2)), radius, parent)
            held.clear()

        for batch in batches:
            bucket, node, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            fp = fp.view(np.uint64)
            if not len(bucket):
                continue
            edges = np.flatnonzero(np.diff(bucket)) + 1
            starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [len(bucket)]))
            # Buckets of one row in the middle of a batch have nothing to link.
            wide = (ends - starts > 1) | (starts == 0) | (ends == len(bucket))
            for s, e in zip(starts[wide].tolist(), ends[wide].tolist(), strict=True):
                b = int(bucket[s])
                if held and held[0][0] != b:
                    finish()
                part = (b, node[s:e], fp[s:e])
                if over == b:
                    yield passed(*part)
                    continue
                held.append(part)
                if sum(len(h[1]) for h in held) > limit:
                    for h in held:
                        yield passed(*h)
                    held.clear()
                    over = b
            if held and ends[-1] == len(bucket) and held[0][0] != int(bucket[-1]):
                finish()
            if len(parent) > 200_000:
                yield forest_batch(parent)
                parent = {}
        finish()
        if parent:
            yield forest_batch(parent)

    return run


def star_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (point, far, node) sorted to a link of each node with the point's smallest near one, if it has one."""
    last, first = None, None
    for batch in batches:
        out = []
        for point, far, node in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if point != last:
                last, first = point, None if far else node
            elif first is not None and node != first:
                out.append((first, node))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])


def flips(reach: int, least: int = 0) -> np.ndarray:
    """All numbers of `least` to `reach` bits."""
    return np.array([sum(1 << b for b in some) for k in range(least, reach + 1) for some in combinations(range(64), k)], np.uint64)


def large_buckets(rows: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) of the nodes (node, fp) of buckets that are too large, by shared points."""
    inner, outer = flips(radius // 2), flips(radius - radius // 2, radius // 2 + 1)  # none but near ones, for an even radius

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for some, far in ((inner, False), (outer, True)):
                step = max(1, (1 << 20) // max(1, len(some)))
                for at in range(0, len(fp) if len(some) else 0, step):
                    met = (fp[at : at + step, None] ^ some).ravel().view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(np.full(len(met), far)), pa.array(np.repeat(node[at : at + step], len(some)))], ["point", "far", "node"])

    met = rows.select("node", "fp").distinct().mapInArrow(points, "point long, far boolean, node long")
    return met.repartition(tasks(rows.sparkSession), "point").sortWithinPartitions("point", "far", "node").mapInArrow(star_links, "a long, b long")


def near_links(nodes: DataFrame, radius: int, bucket_limit: int) -> DataFrame:
    """Links (a, b) that join all nodes (node, fp) that are linked."""
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(signed(m)))) for i, m in enumerate(covering_masks(radius))])
    met = nodes.select(F.explode(keys).alias("bucket"), "node", "fp").repartition(tasks(nodes.sparkSession), "bucket").sortWithinPartitions("bucket")
    found = written(met.mapInArrow(bucket_links(radius, bucket_limit), LINKS_DDL), "sim-links")
    links = found.filter("b is not null").select("a", "b")
    if not found.filter("b is null").isEmpty():
        links = links.unionByName(large_buckets(found.filter("b is null").select(F.col("a").alias("node"), "fp"), radius))
    return links


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) for every node of a link.

    Each round hangs all of a node's neighbours on its smallest one, and then every node on its parent's parent. Written
    tables are joined with written tables, so that Spark can split the rows of a node with very many neighbours.
    """
    edges = written(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi != lo").distinct(), "cc-edges")
    for _ in range(max_rounds):
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-least")
        # Larger neighbours and the node itself go to the smallest.
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = large.unionByName(least.filter("u > m").select(F.col("u").alias("hi"), F.col("m").alias("lo"))).filter("hi != lo")
        up = written(large.distinct(), "cc-large")
        down = written(up.groupBy("hi").agg(F.min("lo").alias("m")), "cc-small")
        small = up.join(down, "hi").filter("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(down.select("hi", F.col("m").alias("lo")))
        new = written(small.distinct(), "cc-edges")
        # Stars: every node has one parent, and no parent has a parent.
        parents = new.groupBy("hi").agg(F.count(F.lit(1)).alias("n"))
        if parents.filter("n > 1").isEmpty() and new.join(new.select(F.col("hi").alias("lo"), F.lit(1).alias("below")), "lo", "left_semi").isEmpty():
            return new.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(new.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
        edges = new
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 3, radius: int = 2, bucket_limit: int = 4096) -> DataFrame:
    """One row for each row of docs: id, fingerprint (16 hex digits), component_id.

    shingle: words of a feature, 0 for single different words. radius: bits in which linked fingerprints may differ.
    """
    marked = written(fingerprints(docs, id_col, text_col, shingle), "sim-fp")
    nodes = written(marked.groupBy("fp").agg(F.min("id").alias("least")).withColumn("node", F.monotonically_increasing_id()), "sim-nodes")
    found = written(components(near_links(nodes.select("node", "fp"), radius, bucket_limit)), "sim-cc")
    placed = nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = written(placed.select("fp", "least", "component"), "sim-placed")
    smallest = written(placed.groupBy("component").agg(F.min("least").alias("component_id")), "sim-small")
    homes = written(placed.join(smallest, "component").select("fp", "component_id"), "sim-homes")
    out = marked.join(homes, "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(words: bytes, shingle: int) -> np.ndarray:
    """Different hashes of a text's shingles, in order."""
    digest = xxhash.xxh64_intdigest
    found = joined_shingles(words.split(), shingle)
    return np.unique(np.fromiter((digest(x, HASH_SEED) for x in found), np.uint64, len(found)))


def alike(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    if not len(a) or not len(b):
        return len(a) == len(b)
    if len(a) > len(b):
        a, b = b, a
    if len(a) < least * len(b):
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return both >= least * (len(a) + len(b) - both)


def search_keys(hashes: np.ndarray, how: Similar, radius: int) -> tuple[list[int], bytes]:
    """A key for each covering table of the shingles' fingerprint and one for each band, and a byte of each min-wise hash."""
    digest = xxhash.xxh64_intdigest
    fp = int.from_bytes(majority(hashes.astype(">u8").view(np.uint8), 64), "big")
    odd = np.random.default_rng(HASH_SEED).integers(0, 1 << 63, how.bands * how.rows, np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(len(odd), np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 1024):
        np.minimum(least, (odd[:, None] * hashes[None, at : at + 1024]).min(axis=1), out=least)
    bands = least.reshape(how.bands, how.rows)
    return [signed(fp & m) for m in covering_masks(radius)] + [signed(digest(b.tobytes())) for b in bands], (least >> np.uint64(56) ^ least >> np.uint64(20)).astype(np.uint8).tobytes()


def bucket_pairs(few: int):
    """Rows (bucket, node) sorted by both to pairs (a, b) of buckets of up to `few` nodes, and to rows (a, null, bucket) of larger ones."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("bucket", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # of the bucket that may go on
        last = None

        def finish(out: list) -> None:
            nodes = np.concatenate(held)
            if 1 < len(nodes) <= few:
                x, y = np.triu_indices(len(nodes), 1)
                out.append((nodes[x], nodes[y], None))
            elif len(nodes) > few:  # equal buckets of several tables have one name
                out.append((nodes, None, signed(xxhash.xxh64_intdigest(nodes.tobytes()))))

        def rows(out: list) -> Iterator[pa.RecordBatch]:
            for a, b, bucket in out:
                n = len(a)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(n, pa.int64()) if b is None else pa.array(b), pa.nulls(n, pa.int64()) if bucket is None else pa.array(np.full(n, bucket))], schema=schema)

        def merged(out: list) -> Iterator[pa.RecordBatch]:
            pairs = [x for x in out if x[1] is not None]
            if pairs:
                pairs = [(np.concatenate([x[0] for x in pairs]), np.concatenate([x[1] for x in pairs]), None)]
            yield from rows(pairs + [x for x in out if x[1] is None])

        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, node = (batch.column(i).to_numpy() for i in range(2))
            edges = np.flatnonzero(np.diff(bucket)) + 1
            starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [len(bucket)]))
            wide = (ends - starts > 1) | (starts == 0) | (ends == len(bucket))
            out: list = []
            for s, e in zip(starts[wide].tolist(), ends[wide].tolist(), strict=True):
                if held and last != bucket[s]:
                    finish(out)
                    held.clear()
                last = bucket[s]
                held.append(node[s:e])
            yield from merged(out)
        if held:
            out = []
            finish(out)
            yield from merged(out)

    return run


def decided(texts: DataFrame, pairs: DataFrame, how: Similar) -> DataFrame:
    """The pairs (a, b) of nodes that are alike. texts: node, words. Both joins are plain exchanges, so that a node of very many pairs is split over tasks."""
    first, second = (texts.select(F.col("node").alias(c), F.col("words").alias(f"words_{c}")) for c in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            out = []
            for a, b, x, y in zip(*batch.columns, strict=True):  # one text at a time
                if b != last:
                    last, own = b, shingle_set(y.as_py(), how.shingle)
                if alike(shingle_set(x.as_py(), how.shingle), own, how.least):
                    out.append((a.as_py(), b.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(2)], ["a", "b"])

    return pairs.join(first, "a").join(second, "b").select("a", "b", "words_a", "words_b").mapInArrow(run, "a long, b long")


def star_pairs(rows: DataFrame) -> DataFrame:
    """One node of each bucket with all others. rows: bucket, node."""
    chosen = rows.groupBy("bucket").agg(F.min_by("node", F.xxhash64("node", "bucket")).alias("one"))
    met = rows.join(written(chosen, "sim-chosen"), "bucket").filter("node != one")
    return met.select(F.least("node", "one").alias("a"), F.greatest("node", "one").alias("b")).distinct()


def block_links(rows: DataFrame, texts: DataFrame, how: Similar) -> DataFrame:
    """Links between the components of each bucket (bucket, node, label), in blocks: those of the largest component meet those of the others, and the others each other. texts: node, mark, words."""
    sizes = written(rows.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n")), "sim-labels")
    whole = written(sizes.groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n")), "sim-sizes")
    ceil = lambda c: F.ceil(c / how.block).cast("int")
    cut = rows.join(whole, "bucket").withColumn("p", ceil(F.col("n_main"))).withColumn("m", ceil(F.col("n") - F.col("n_main")))
    is_main = F.col("label") == F.col("main")
    cut = cut.withColumn("own", F.when(is_main, F.pmod(F.xxhash64("node"), F.col("p"))).otherwise(F.col("p") + F.pmod(F.xxhash64("node"), F.col("m"))).cast("int"))
    others = F.explode(F.sequence(F.when(is_main, F.col("p")).otherwise(F.lit(0)), F.col("p") + F.col("m") - 1))
    dealt = cut.select("bucket", "own", "node", "label", others.alias("other"))
    dealt = dealt.select("bucket", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "node", "label").join(texts.select("node", "mark", "words"), "node")
    order = ["bucket", "x", "y", "own", "node"]
    dealt = dealt.select(*order, "label", "mark", "words").repartition(tasks(rows.sparkSession), "bucket", "x", "y").sortWithinPartitions(*order)

    def links(held: list[tuple], x: int) -> list[tuple[int, int]]:
        """Rows (own, node, label, mark, words) of one pair of blocks."""
        own, node = (np.array([h[i] for h in held]) for i in (0, 1))
        label = np.unique([h[2] for h in held], return_inverse=True)[1]
        mark = np.frombuffer(b"".join([h[3] for h in held]), np.uint8).reshape(len(held), -1)
        sets: dict[int, np.ndarray] = {}

        def set_of(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = shingle_set(held[i][4], how.shingle)
            return sets[i]

        out = []
        across = int((own == x).sum()) if own[0] != own[-1] else 0
        for i in range(across or 1, len(held)) if across or own[0] == own[-1] else ():
            others = np.flatnonzero(label[: across or i] != label[i])
            for j in others[(mark[others] == mark[i]).sum(axis=1) >= how.hopeful * mark.shape[1]].tolist():
                if label[j] != label[i] and alike(set_of(i), set_of(j), how.least):
                    label[label == label[i]] = label[j]
                    out.append((min(int(node[i]), int(node[j])), max(int(node[i]), int(node[j]))))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            out = []
            for bucket, x, y, *row in zip(*batch.columns, strict=True):
                this = (bucket.as_py(), x.as_py(), y.as_py())
                if this != key:
                    out += links(held, key[1]) if held and (key[1] == key[2] or held[0][0] != held[-1][0]) else []
                    key, held = this, []
                held.append(tuple(v.as_py() for v in row))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in range(2)], ["a", "b"])
        out = links(held, key[1]) if held and (key[1] == key[2] or held[0][0] != held[-1][0]) else []
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in range(2)], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def similar_links(marked: DataFrame, radius: int, how: Similar) -> DataFrame:
    """node, component of all nodes that are alike to others; marked: node, keys, mark, words."""
    searched = marked.groupBy("node").agg(F.first("keys").alias("keys")).select("node", F.posexplode("keys").alias("table", "key"))
    met = searched.select(F.xxhash64("table", "key").alias("bucket"), "node").repartition(tasks(marked.sparkSession), "bucket").sortWithinPartitions("bucket", "node")
    found = written(met.mapInArrow(bucket_pairs(how.few), "a long, b long, bucket long"), "sim-pairs")
    large = written(found.filter("b is null").select("bucket", F.col("a").alias("node")).distinct(), "sim-large")
    pairs = written(found.filter("b is not null").select("a", "b").unionByName(star_pairs(large)).distinct(), "sim-different")
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "sim-wanted")  # a node of a large bucket is in a pair
    texts = written(marked.select("node", "mark", "words").join(wanted, "node", "left_semi").dropDuplicates(["node"]), "sim-texts")
    placed = written(components(decided(texts, pairs, how)), "sim-cc")
    rows = large.join(placed, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("label"))
    mixed = rows.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("bucket")
    rows = written(rows.join(written(mixed, "sim-mixed"), "bucket"), "sim-open")
    if rows.isEmpty():
        return placed
    return components(placed.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(block_links(rows, texts, how)))


def row_key(id_col: str, text_col: str):
    """The identifier (or none) and the text of a row, as a string."""
    return F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("none")), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, radius: int = 2, similar: Similar = Similar()) -> DataFrame:
    """One row for each row of docs: id, key (see row_key), component. Texts of equal words are one node, by a hash of 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                words = [b" ".join(word_list(t)) for t in binary_column(some, "text")]
                keys, marks = zip(*[search_keys(shingle_set(w, similar.shingle), similar, radius) for w in words], strict=True)
                node = [signed(xxhash.xxh3_64_intdigest(w)) for w in words]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(node, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.binary()), pa.array(words, pa.binary())], ["id", "key", "node", "keys", "mark", "words"])

    kind = id_kind(docs, id_col)
    narrow = docs.select(F.col(id_col).cast(kind).alias("id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    marked = written(narrow.mapInArrow(run, f"id {kind}, key string, node long, keys array<long>, mark binary, words binary"), "sim-marked")
    found = written(similar_links(marked, radius, similar), "sim-cc")
    return marked.select("id", "key", "node").join(found, "node", "left").select("id", "key", F.coalesce("component", "node").alias("component"))


def similar_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of each group, with all its columns: the one with the smallest identifier; one without only if none has one."""
    chosen = similar_groups(docs, id_col, text_col, **how).groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("least"))
    stay = chosen.select(F.col("least.key").alias("__key"))
    return docs.withColumn("__key", row_key(id_col, text_col)).join(stay, "__key", "left_semi").dropDuplicates(["__key"]).drop("__key")
