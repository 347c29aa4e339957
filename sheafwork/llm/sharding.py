"""Sharding: K-d tree partitioning.

Rows are first summed to groups (rows of equal text, told apart by byte length, CRC-32 and XXH64), which are never parted.
A group's coordinates are metadata: language, source, size and place in the corpus (smallest identifier). The tree splits
the groups at weighted medians (weighted quantiles, where the shard count is not a power of two) along the dimension that
is widest in that node, relative to its width in the corpus, until a leaf is one shard. Ties on a coordinate are
ordered by the group's hash, so a value that a third of the rows share can be split anywhere.

Each level of the tree takes two distributed aggregations for all its nodes at once: ends and quantile sketches of each node's
dimensions, then exact sums of bytes between the sketch's points. The driver gets at most `points` sums for each of at most
`shards` nodes, whatever the input's size.

Groups stay whole, so heavy ones make medians uneven. Leaves are evened out after that: what a leaf has above its share, of
groups up to a part of a share (half of it first, at last a 64th), is split off along a hash, and goes to leaves below theirs.

Law `bytes`: shards' bytes are near equal. A group that alone exceeds a share is left with a shard of its own, and the others
have even shares of the rest.

Defined results: a null text counts 16 bytes, has CRC-32 0 and is in the group of empty texts. Null metadata sorts first.
Repeated rows and identifiers are rows like others. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sheafwork.llm.common import written

GROUP = ["size", "crc", "xx"]
DIMS = ("lang", "source", "bytes", "place")
OVERHEAD = 16
HASH_BITS = 20
PLACE_BITS = 32  # with the hash, as many as the sketches keep exactly
POINTS = 1024
#: The heaviest groups that are moved in each round of evening out, as parts of a shard's share.
MOVED = (1 / 2, 1 / 8, 1 / 64)
#: Parts of a share that a shard may be off without another round.
EVEN = 0.005


def text_prefix(c: Column) -> Column:
    """The first seven bytes of a string as a number that sorts as the string does; null sorts first."""
    return F.coalesce(F.conv(F.rpad(F.hex(F.substring(F.encode(c.cast("string"), "utf-8"), 1, 7)), 14, "0"), 16, 10).cast("long") + 1, F.lit(0).cast("long"))


@dataclass
class Split:
    """A node (shards first to last - 1) that was split: groups whose key along the dimension is below `below` go left, to the shards before `cut`."""

    first: int
    cut: int
    last: int
    dim: str
    below: int


def grouped(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Narrow rows, and their groups with weights and a key for each dimension: the place in the dimension's range, then the group's hash."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    has = set(docs.columns)
    rows = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("xx"),
        *[(text_prefix(F.col(c)) if c in has else F.lit(0).cast("long")).alias(c) for c in ("lang", "source")],
    )
    rows = written(rows, "shard-rows")
    place = F.coalesce(F.col("id").cast("long"), F.lit(0).cast("long")) if isinstance(docs.schema[id_col].dataType, T.IntegralType) else text_prefix(F.col("id"))
    at = {"lang": F.col("lang"), "source": F.col("source"), "bytes": F.log2(F.col("size").cast("double")), "place": place}
    ends = rows.agg(*[f(c.cast("double")).alias(f"{d}_{n}") for d, c in at.items() for n, f in (("low", F.min), ("high", F.max))]).first()
    groups = rows.groupBy(*GROUP).agg(F.sum("size").alias("weight"), *[F.min(c).alias(d) for d, c in at.items()])
    tie = F.shiftrightunsigned(F.xxhash64("xx", "crc"), 64 - HASH_BITS)

    def key(d: str) -> Column:
        low, high = ends[f"{d}_low"] or 0.0, ends[f"{d}_high"] or 0.0
        scaled = F.floor((F.col(d) - F.lit(low)) * F.lit((1 << PLACE_BITS) / (high - low) if high > low else 0.0)).cast("long")
        return F.shiftleft(F.greatest(F.lit(0).cast("long"), F.least(F.lit(1 << PLACE_BITS).cast("long"), scaled)), HASH_BITS) + tie

    return rows, written(groups.select(*GROUP, "weight", *[key(d).alias(d) for d in DIMS]), "shard-groups")


def node_of(splits: list[Split], shards: int) -> Column:
    """First shard of the node that a group is in, given the splits so far: nested tests, in the order of the tree."""
    by_range = {(s.first, s.last): s for s in splits}

    def test(first: int, last: int) -> Column:
        s = by_range.get((first, last))
        if s is None:
            return F.lit(first)
        return F.when(F.col(s.dim) < s.below, test(first, s.cut)).otherwise(test(s.cut, last))

    return test(0, shards)


def bytes_between(marks: dict[int, np.ndarray]):
    """Rows (node, key, weight) to sums of weight for each node and bin: bin i is from mark i - 1 (with it) to mark i (without it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {n: np.zeros(len(m) + 1) for n, m in marks.items()}
        for batch in batches:
            node, key, weight = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for n in np.unique(node).tolist():
                own = node == n
                total[n] += np.bincount(np.searchsorted(marks[n], key[own], "right"), weights=weight[own].astype(float), minlength=len(total[n]))
        for n, w in total.items():
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), n, np.int32)), pa.array(at.astype(np.int32)), pa.array(w[at])], ["node", "bin", "w"])

    return run


def sums_between(keyed: DataFrame, marks: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """keyed: node, key, weight. Sums of weight below each mark of a node, and of all the node has."""
    got = {n: np.zeros(len(m) + 1) for n, m in marks.items()}
    if marks:
        for r in keyed.mapInArrow(bytes_between(marks), "node int, bin int, w double").groupBy("node", "bin").agg(F.sum("w").alias("w")).collect():  # at most `points` for each node
            got[r["node"]][r["bin"]] = r["w"]
    return {n: np.cumsum(w) for n, w in got.items()}


def quantiles(c: str, points: int) -> Column:
    return F.percentile_approx(c, [i / points for i in range(1, points)], 4 * points)


def kd_tree(groups: DataFrame, shards: int, points: int = POINTS) -> list[Split]:
    """Splits of the groups (weight and a key for each dimension), so that each leaf gets its share of their bytes as nearly as whole groups allow."""
    splits: list[Split] = []
    nodes = [(0, shards)]
    while nodes := [n for n in nodes if n[1] - n[0] > 1]:
        placed = groups.withColumn("node", node_of(splits, shards)).filter(F.col("node").isin([a for a, _ in nodes]))
        found = {r["node"]: r for r in placed.groupBy("node").agg(*[x for d in DIMS for x in (F.min(d).alias(f"{d}_low"), F.max(d).alias(f"{d}_high"), quantiles(d, points).alias(d))]).collect()}
        dims = {a: max(DIMS, key=lambda d: (r[f"{d}_high"] >> HASH_BITS) - (r[f"{d}_low"] >> HASH_BITS)) for a, r in found.items()}
        marks = {a: np.unique(np.array(found[a][d], np.int64)) for a, d in dims.items()}
        key = reduce(lambda c, a: F.when(F.col("node") == a, F.col(dims[a])).otherwise(c), dims, F.lit(0).cast("long"))
        below = sums_between(placed.select("node", key.alias("key"), "weight"), marks)
        new = []
        for a, b in nodes:
            cut = (a + b) // 2
            if a in marks:
                steps = below[a]
                at = int(np.argmin(np.abs(steps[:-1] - (cut - a) / (b - a) * steps[-1])))
                splits.append(Split(a, cut, b, dims[a], int(marks[a][at])))
            else:  # nothing is in this node
                splits.append(Split(a, cut, b, DIMS[0], 0))
            new += [(a, cut), (cut, b)]
        nodes = new
    return splits


def shares(fixed: np.ndarray, movable: np.ndarray) -> np.ndarray:
    """What each shard should have: all the same, but for those whose fixed part alone is more."""
    low, high = 0.0, float(fixed.sum() + movable.sum()) + 1
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if np.maximum(0, mid - fixed).sum() < movable.sum() else (low, mid)
    return np.maximum(fixed, high)


def transfers(surplus: np.ndarray) -> dict[int, list[tuple[int, float]]]:
    """From each shard above its share: the shards below theirs that get its surplus, and how much."""
    out: dict[int, list[tuple[int, float]]] = {}
    lacks = [(s, -x) for s, x in enumerate(surplus.tolist()) if x < 0]
    for s, x in enumerate(surplus.tolist()):
        while x > 0 and lacks:
            to, room = lacks.pop()
            out.setdefault(s, []).append((to, min(x, room)))
            if room > x:
                lacks.append((to, room - x))
            x -= room
    return out


def evened(homes: DataFrame, shards: int, part: float, salt: int, points: int = POINTS) -> DataFrame:
    """homes (GROUP, weight, shard) after one round of moves of groups of up to this part of a share."""
    total = homes.agg(F.sum("weight")).first()[0] or 0
    limit = total / shards * part
    heavy, light = np.zeros(shards), np.zeros(shards)
    is_light = F.col("weight") <= limit
    for r in homes.groupBy("shard").agg(F.sum(F.when(is_light, F.col("weight")).otherwise(0)).alias("light"), F.sum(F.when(is_light, 0).otherwise(F.col("weight"))).alias("heavy")).collect():
        heavy[r["shard"]], light[r["shard"]] = r["heavy"], r["light"]
    surplus = heavy + light - shares(heavy, light)
    if np.abs(surplus).max() <= EVEN * total / shards:
        return homes
    moves = transfers(surplus)
    key = F.shiftrightunsigned(F.xxhash64(*GROUP, F.lit(salt)), 12)
    keyed = homes.filter(is_light & F.col("shard").isin(list(moves))).select(F.col("shard").alias("node"), key.alias("key"), "weight")
    marks = {r["node"]: np.unique(np.array(r["q"], np.int64)) for r in keyed.groupBy("node").agg(quantiles("key", points).alias("q")).collect()}
    below = sums_between(keyed, marks)
    new = F.col("shard")
    for s, to in moves.items():
        if s not in marks:
            continue
        ends = np.concatenate(([0.0], below[s]))
        borders = np.concatenate(([np.iinfo(np.int64).min], marks[s], [np.iinfo(np.int64).max]))
        home = F.lit(s)
        wanted = np.cumsum([x for _, x in to])
        for (receiver, _), w in reversed(list(zip(to, wanted, strict=True))):
            home = F.when(key < int(borders[np.argmin(np.abs(ends - w))]), receiver).otherwise(home)
        new = F.when(is_light & (F.col("shard") == s), home).otherwise(new)
    return written(homes.withColumn("shard", new.cast("int")), "shard-homes")


def assign_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, size, text_crc32, law, shard, slot, grown_shard."""
    rows, groups = grouped(docs, id_col, text_col)
    splits = kd_tree(groups, shards)
    homes = written(groups.select(*GROUP, "weight", node_of(splits, shards).cast("int").alias("shard")), "shard-homes")
    for salt, part in enumerate(MOVED):
        homes = evened(homes, shards, part, salt)
    # Both sides are plain exchanges, so that a group of very many rows is split over tasks.
    return with_slots(rows.select("id", *GROUP).join(homes, GROUP).select("id", "size", "crc", "shard"), id_col)


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a column shard, and each row's place among the task's rows of its shard."""
    seen: dict[int, int] = {}
    for batch in batches:
        shard = batch.column("shard").to_numpy()
        order = np.argsort(shard, kind="stable")
        first = np.flatnonzero(np.diff(shard[order], prepend=-1))
        places = np.empty(len(shard), np.int64)
        places[order] = np.arange(len(shard)) - np.repeat(first, np.diff(np.append(first, len(shard))))
        for s, n in zip(*np.unique(shard, return_counts=True), strict=True):
            places[shard == s] += seen.get(int(s), 0)
            seen[int(s)] = seen.get(int(s), 0) + int(n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places)], [*batch.schema.names, "within"])


def with_slots(dealt: DataFrame, id_col: str) -> DataFrame:
    """Number the rows of each shard from 0: each task of the written table numbers its own, from where the tasks before it end. No shard and no identifier is brought to one task."""
    marked = dealt.withColumn("part", F.spark_partition_id())
    kind = marked.schema["id"].dataType.simpleString()
    placed = written(marked.mapInArrow(numbered, f"id {kind}, size long, crc long, shard int, part int, within long"), "shard-dealt")
    counts = written(placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n")), "shard-counts")
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("shard", "part", F.coalesce(before, F.lit(0)).alias("start"))
    return placed.join(starts, ["shard", "part"]).select(
        F.col("id").alias(id_col), F.col("size"), F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard"), (F.col("start") + F.col("within")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, shards: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write docs as one folder for each shard; identifiers stand for rows here."""
    homes = assign_shards(docs, shards, id_col, text_col).select(F.col(id_col).alias("__id"), "shard", "slot").dropDuplicates(["__id"])
    docs.join(homes, F.col(id_col).eqNullSafe(F.col("__id"))).drop("__id").write.partitionBy("shard").parquet(path)
