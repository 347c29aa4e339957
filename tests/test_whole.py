"""Sizes of a table as one chunk: those of encoding it as one chunk, from tasks that see a part of it each."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafwork import queries
from sheafwork.options import EncodeOptions
from sheafwork.plans import whole
from sheafwork.plans.encoding import encode

SIZES = ["field", "path", "types", "encoding", "n_values", "byte_size"]
PLAIN = queries.PLAIN


def one_chunk(df, order_by, options):
    return encode(df, order_by, replace(options, chunk_rows=1 << 30), partitions=1).select(*SIZES)


def rows(df):
    return sorted(tuple(r) for r in df.select(*SIZES).collect())


def orders(spark, n=9000):
    k = F.col("id")
    return spark.range(n, numPartitions=5).select(
        k.alias("o_orderkey"), F.when(k % 5000 == 4999, k).otherwise(k % 2).alias("o_custkey"), F.concat(F.lit("s"), k % 3).alias("o_orderstatus"), (k / 7).alias("o_totalprice"),
        F.timestamp_micros(k * 10**9).cast("timestamp_ntz").alias("o_orderdate"), F.expr("repeat('é', CAST(id % 90 AS INT))").alias("o_orderpriority"),
    )


def test_as_one_chunk(spark):
    """Pieces whose customers are all 0 or 1 are truth values by themselves, and aren't as a part of the whole."""
    df = orders(spark)
    assert whole.additive(df, PLAIN)
    assert rows(whole.encoded_whole(df, ["o_orderkey"], PLAIN)) == rows(one_chunk(df, ["o_orderkey"], PLAIN))


@pytest.mark.parametrize("name", ["k", "none", "bits", "signed", "gone"])
def test_what_depends_on_the_whole_column(spark, name):
    """Nulls, signs, truth values and empty tables are encoded as one chunk."""
    made = {"k": F.col("id"), "none": F.when(F.col("id") % 7 > 0, F.col("id")), "bits": F.col("id") % 2, "signed": F.col("id") - 100, "gone": F.lit(None).cast("long")}[name]
    df = spark.range(0 if name == "k" else 3000).select("id", made.alias(name))
    assert not whole.additive(df.select(name), PLAIN)
    assert rows(whole.encoded_whole(df, ["id"], PLAIN)) == rows(one_chunk(df, ["id"], PLAIN))


@pytest.mark.parametrize("same", [True, False])
def test_lists(spark, same):
    df = spark.range(5000).select("id", F.array_repeat(F.col("id").cast("float"), 5 if same else (F.col("id") % 3 + 1).cast("int")).alias("v"))
    options = EncodeOptions(only=("Fixed F32",))
    assert whole.additive(df.select("v"), options) == same
    assert rows(whole.encoded_whole(df, ["id"], options, ["v"])) == [r for r in rows(one_chunk(df, ["id"], options)) if r[0] == "v"]


def no_chunk_of_the_whole(monkeypatch, spark, tmp_path, name):
    """Runs a query on orders without a task that makes one chunk of them all."""

    def refused(*args, **kwargs):
        raise AssertionError("the table was made one chunk")

    orders(spark).write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(whole, "encode", refused)
    monkeypatch.setattr(queries, "encode", refused)
    return queries.QUERIES[name](spark, str(tmp_path)).collect()


def test_size_by_path(monkeypatch, spark, tmp_path):
    found = no_chunk_of_the_whole(monkeypatch, spark, tmp_path, "size_by_path")
    assert sorted((r.path, r.bytes, r.n_values) for r in found) == sorted((p, b, n) for _, p, _, _, n, b in rows(one_chunk(orders(spark), ["o_orderkey"], PLAIN)))


def test_size_by_encoding(monkeypatch, spark, tmp_path):
    found = no_chunk_of_the_whole(monkeypatch, spark, tmp_path, "size_by_encoding")
    want = rows(one_chunk(orders(spark), ["o_orderkey"], PLAIN))
    assert {(r.encoding, r.branches, r.bytes) for r in found} == {(e, sum(w[3] == e for w in want), sum(w[5] for w in want if w[3] == e)) for e in PLAIN.only}


def test_encoded_size_totals(monkeypatch, spark, tmp_path):
    found = no_chunk_of_the_whole(monkeypatch, spark, tmp_path, "encoded_size_totals")
    want = rows(one_chunk(orders(spark), ["o_orderkey"], PLAIN))
    assert [tuple(r) for r in found] == [(total := sum(w[5] for w in want), 0, total)]


def test_size_order(monkeypatch, spark, tmp_path):
    found = no_chunk_of_the_whole(monkeypatch, spark, tmp_path, "size_order")
    want = rows(one_chunk(orders(spark), ["o_orderkey"], PLAIN))
    assert sorted((r.place, r.path) for r in found) == [(i, w[1]) for i, w in enumerate(sorted(want, key=lambda w: (-w[5], w[1])))]


def test_size_totals(monkeypatch, spark, tmp_path):
    found = no_chunk_of_the_whole(monkeypatch, spark, tmp_path, "size_totals")
    want = rows(one_chunk(orders(spark), ["o_orderkey"], PLAIN))
    assert [tuple(r) for r in found] == [(total := sum(w[5] for w in want), 10_000_000 - total, 10_000_000)]
