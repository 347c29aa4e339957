import zlib

from sheafwork.llm.sharding import DIMS, GROUP, HASH_BITS, assign_shards, grouped, kd_tree, node_of, write_shards
from tests.llm.helpers import corpus, documents, empty


def check(rows, out, shards):
    assert sorted(str(r.doc_id) for r in out) == sorted(str(i) for i, _ in rows)
    text = {}
    for i, t in rows:
        text.setdefault(i, set()).add(t or "")
    by_text = {}
    for r in out:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        assert (r.size, r.text_crc32) in {(len(t.encode()) + 16, zlib.crc32(t.encode())) for t in text[r.doc_id]}
        by_text.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())  # equal texts stay together
    for s in range(shards):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))


def test_laws_hold(spark):
    rows = corpus(1, 300)
    rows += rows[:5] + rows[-2:] + [(None, "x y"), (None, None)] + [(None, "many without a number")] * 50  # one text, twice, is more than a shard
    out = assign_shards(documents(spark, rows), 7).collect()
    check(rows, out, 7)
    loads = [sum(r.size for r in out if r.shard == s) for s in range(7)]
    heavy = max(range(7), key=loads.__getitem__)
    assert {r.size for r in out if r.shard == heavy} == {max(len(t or "") for _, t in rows) + 16}
    rest = [x for s, x in enumerate(loads) if s != heavy]
    assert max(rest) < 1.06 * sum(rest) / 6 and min(rest) > 0.94 * sum(rest) / 6


def test_heavy_groups_are_evened_out(spark):
    """Groups of a tenth to a half of a shard's share."""
    rows = [(i, t) for i, t in corpus(2, 400) if t is None or len(t) < 5000]
    rows += [(1000 + 100 * g + k, f"group {g} " * 60) for g in range(9) for k in range(4 + 2 * g)]
    out = assign_shards(documents(spark, rows), 6).collect()
    check(rows, out, 6)
    loads = [sum(r.size for r in out if r.shard == s) for s in range(6)]
    assert max(loads) < 1.06 * sum(loads) / 6 and min(loads) > 0.94 * sum(loads) / 6


def test_one_group_larger_than_a_shard(spark):
    rows = [(i, t) for i, t in corpus(2, 60) if t is None or len(t) < 5000] + [(1000 + k, "hot text " * 500) for k in range(50)]
    out = assign_shards(documents(spark, rows), 5).collect()
    check(rows, out, 5)
    loads = sorted(sum(r.size for r in out if r.shard == s) for s in range(5))
    assert loads[3] < 1.3 * loads[0]  # the others share the rest evenly


def plain_tree(groups, first, last):
    """Shards by a K-d tree in memory: at each node the border between two keys that is nearest to the left side's share."""
    if last - first == 1 or not groups:
        return dict.fromkeys((g["key"] for g in groups), first)
    dim = max(DIMS, key=lambda d: (max(g[d] for g in groups) >> HASH_BITS << HASH_BITS) - (min(g[d] for g in groups) >> HASH_BITS << HASH_BITS))
    total, cut = sum(g["weight"] for g in groups), (first + last) // 2
    best = min(sorted({g[dim] for g in groups}), key=lambda m: abs(sum(g["weight"] for g in groups if g[dim] < m) - (cut - first) / (last - first) * total))
    return plain_tree([g for g in groups if g[dim] < best], first, cut) | plain_tree([g for g in groups if g[dim] >= best], cut, last)


def test_tree_matches_a_plain_one(spark):
    rows = corpus(5, 250)
    rows += rows[:20]
    _, groups = grouped(documents(spark, rows), "doc_id", "text")
    got = {tuple(r[c] for c in GROUP): r["shard"] for r in groups.withColumn("shard", node_of(kd_tree(groups, 7), 7)).collect()}
    want = plain_tree([r.asDict() | {"key": tuple(r[c] for c in GROUP)} for r in groups.collect()], 0, 7)
    assert got == want and len(set(want.values())) == 7


def test_text_identifiers(spark):
    docs = spark.createDataFrame([("a", "x"), ("b", "y"), (None, "z")], "doc_id string, text string")
    assert {r.doc_id for r in assign_shards(docs, 2).collect()} == {"a", "b", None}


def test_few_rows_and_no_rows(spark):
    rows = [(1, "a"), (2, None)]
    check(rows, assign_shards(documents(spark, rows), 40).collect(), 40)
    assert assign_shards(empty(spark), 4).count() == 0


def test_written_shards(spark, tmp_path):
    rows = corpus(3, 20)
    docs = documents(spark, rows).select("doc_id", "text", "lang", "source")
    write_shards(docs, 3, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.text) for r in back.collect() if r.text is not None) == sorted((i, t) for i, t in rows if t is not None)
