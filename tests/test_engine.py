import datetime
from decimal import Decimal

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafwork.errors import SchemaMismatch
from sheafwork.functions import columns as C
from sheafwork.names import canonical
from sheafwork.operators import branches as B
from sheafwork.options import DecodeOptions, EncodeOptions, options
from sheafwork.plans.encoding import decode, encode
from sheafwork.plans.report import size_breakdown, size_by_encoding, size_by_path, size_totals
from sheafwork.sources.store import open_store, read_store, write_store
from sheafwork.streaming.chunks import store_stream

NESTED = T.StructType([
    T.StructField("key", T.LongType(), False),
    T.StructField("flag", T.BooleanType()),
    T.StructField("small", T.ByteType()),
    T.StructField("signed", T.LongType()),
    T.StructField("day", T.DateType()),
    T.StructField("money", T.DecimalType(20, 2)),
    T.StructField("raw", T.BinaryType()),
    T.StructField("single", T.FloatType()),
    T.StructField("tags", T.MapType(T.StringType(), T.LongType())),
    T.StructField("inner", T.StructType([T.StructField("name", T.StringType()), T.StructField("list", T.ArrayType(T.ArrayType(T.DoubleType())))])),
    T.StructField("nothing", T.StringType()),
])


def nested_rows(n=230):
    return [
        (
            i, None if i % 5 == 0 else i % 3 == 0, i % 100, (-1) ** i * i * 10**12, datetime.date(1969, 12, 1) + datetime.timedelta(days=i), Decimal(i) / 4, bytes([i % 256, 255, 0]) * (i % 4), i / 7,
            None if i % 4 == 0 else {f"k{j}": j * i for j in range(i % 3)}, None if i % 7 == 0 else (f"n{i % 9}" if i % 2 else None, [[float(j)] * (j % 3) for j in range(i % 5)] if i % 6 else None), None,
        )
        for i in range(n)
    ]


def same(a, b):
    return sorted(str(r.asDict(True)) for r in a.collect()) == sorted(str(r.asDict(True)) for r in b.collect())


@pytest.mark.parametrize("chunk", [4096, 50, 1])
def test_nested_rows_come_back(spark, chunk):
    rows = nested_rows(230 if chunk > 1 else 25)
    df = spark.createDataFrame(rows, NESTED)
    assert same(decode(encode(df, ["key"], EncodeOptions(chunk_rows=chunk)), NESTED), df)


def test_empty_frame(spark):
    df = spark.createDataFrame([], NESTED)
    branches = encode(df, ["key"])
    assert branches.count() == 0 and decode(branches, NESTED).count() == 0 and size_totals(branches).first().accounted == 0


def test_order_is_kept_in_a_chunk(spark):
    df = spark.range(1000).withColumn("v", F.col("id") * 7 % 13)
    rows = decode(encode(df, ["id"], partitions=1), df.schema).collect()
    assert [r.id for r in rows] == list(range(1000))


def reader(*fields):
    return T.StructType([T.StructField(*f) for f in fields])


def test_schemas_of_the_reader(spark):
    df = spark.createDataFrame([(1, "a", [1, 2]), (2, "b", [3, 4])], "my_id long, name string, pair array<int>")
    branches = encode(df, ["my_id"]).cache()
    assert {r.myId for r in decode(branches, reader(("myId", T.LongType()))).collect()} == {1, 2}
    assert {r.extra for r in decode(branches, reader(("my_id", T.LongType()), ("extra", T.StringType()))).collect()} == {None}
    assert {r.my_id for r in decode(branches, reader(("my_id", T.ShortType()))).collect()} == {1, 2}
    assert decode(branches, reader(("my_id", T.LongType()), ("gone", T.LongType(), False)), DecodeOptions(void_ints_as_zero=True)).first().gone == 0
    assert same(decode(branches, df.schema, DecodeOptions(parallel=False)), df)
    for bad in (("my_id", T.StringType()), ("name", T.LongType()), ("pair", T.LongType()), ("name", T.ArrayType(T.StringType())), ("my_id", T.DoubleType()), ("gone", T.LongType(), False)):
        with pytest.raises(PythonException, match="SchemaMismatch"):
            decode(branches, reader(("my_id", T.LongType()), bad)).collect()
    branches.unpersist()


def test_numbers_that_do_not_fit(spark):
    branches = encode(spark.createDataFrame([(1, 70_000)], "k long, v long"), ["k"])
    with pytest.raises(PythonException, match="SchemaMismatch"):
        decode(branches, reader(("v", T.ShortType()))).collect()


def test_two_columns_of_one_name(spark):
    with pytest.raises(SchemaMismatch):
        encode(spark.createDataFrame([(1, 2)], "my_id long, myId long"), ["my_id"])


def test_names():
    assert [canonical(n) for n in ("my_name", "myName", "MyName", "my__name_", "x", "HTTPCode", "a1_b2", "名前")] == ["myName", "myName", "myName", "myName", "x", "httpCode", "a1B2", "名前"]


def test_options():
    base = EncodeOptions()
    assert options(base, {"chunk_rows": 5}, {"chunk_rows": 6}).chunk_rows == 6 and base.lossy_float_tolerance is None


def test_reports(spark):
    branches = encode(spark.createDataFrame(nested_rows(), NESTED), ["key"]).cache()
    paths, encodings = size_by_path(branches).collect(), size_by_encoding(branches).collect()
    whole = size_totals(branches, stored_bytes=10**6).first()
    assert sum(r.bytes for r in paths) == sum(r.bytes for r in encodings) == whole.accounted == 10**6 - whole.other
    assert [r.bytes for r in paths] == sorted((r.bytes for r in paths), reverse=True)
    text = size_breakdown(branches)
    assert all(f"{r.bytes:>14} {r.path} " in text for r in paths) and f"{whole.accounted:>14} accounted" in text
    assert {"key", "tags.opt", "inner.values.name.values", "nothing"} <= {r.path for r in paths}
    branches.unpersist()


def test_store_reads_its_fields_alone(spark, tmp_path):
    path = str(tmp_path / "store")
    df = spark.createDataFrame(nested_rows(), NESTED)
    write_store(df, path, ["key"], EncodeOptions(chunk_rows=64))
    found = read_store(spark, path, reader(("key", T.LongType()), ("small", T.IntegerType())))
    assert sorted((r.key, r.small) for r in found.collect()) == [(r[0], r[2]) for r in nested_rows()]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [field" in plan.replace("PartitionFilters: [isnotnull(field", "PartitionFilters: [field")
    assert set(open_store(spark, path).select("field").distinct().toPandas()["field"]) == {canonical(c) for c in df.columns}


def test_streams_append(spark, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    df = spark.range(500).withColumn("v", F.col("id") % 10)
    df.write.parquet(source)
    query = store_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source), store, ["id"]).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert same(read_store(spark, store, df.schema), df)


def test_zigzag_and_varints_agree_with_plain_arithmetic(spark):
    values = [0, 1, -1, 63, -64, 64, 2**31 - 1, -(2**31)]
    out = spark.createDataFrame([(v,) for v in values], "v long").select("v", C.zigzag32("v").alias("z"), C.unzigzag32(C.zigzag32("v")).alias("back"), C.varint_size(C.zigzag32("v")).alias("n")).collect()
    assert all(r.z == (2 * r.v if r.v >= 0 else -2 * r.v - 1) and r.back == r.v and r.n == max(1, -(-r.z.bit_length() // 7)) for r in out)


def test_width_classes(spark):
    values = [0, 1, 255, 256, 65535, 2**24, 2**32, 2**40 - 1, 2**48, 2**56 - 1, 2**56, 2**63 - 1, -1, -5]
    out = [r.c for r in spark.createDataFrame([(v,) for v in values], "v long").select(C.width_class("v").alias("c")).collect()]
    assert out == ["zero", "one", "1 byte", "2 bytes", "2 bytes", "4 bytes", "5 bytes", "5 bytes", "7 bytes", "7 bytes", "8 bytes", "8 bytes", "minus one", "negative"]


def test_float_classes(spark):
    out = [r.c for r in spark.createDataFrame([(v,) for v in (0.0, -0.0, 1.0, -1.0, float("nan"), 2.5)], "v double").select(C.float_class("v").alias("c")).collect()]
    assert out == ["zero", "fixed", "one", "minus one", "nan", "fixed"]


def test_maps_with_a_key_twice_fail(spark):
    entries = spark.createDataFrame([(0, 0, 0, "a", 1), (0, 0, 1, "a", 2)], "chunk_id long, pos long, index int, key string, value long")
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        B.undo_map(entries).collect()


def test_windows_stay_in_chunks(spark):
    b = B.branch(spark.range(10_000).withColumn("v", F.lit("same")), "id", "v", 4096)
    assert sorted((r.chunk_id, r.extra) for r in B.rle(b).collect()) == [(0, 4095), (1, 4095), (2, 10_000 - 8192 - 1)]


MIXED = T.StructType([T.StructField("tag", T.StringType()), T.StructField("one", T.LongType()), T.StructField("my_list", T.ArrayType(T.StringType()))])


def unions(spark):
    rows = [(0, ("Ex", None, None)), (1, ("One", 10, None)), (2, ("myList", None, ["a", None])), (3, ("One", None, None)), (4, None), (5, ("Ex", None, None)), (6, ("One", -3, None))]
    return spark.createDataFrame(rows, T.StructType([T.StructField("k", T.LongType()), T.StructField("u", MIXED, True, {"union": True})]))


def test_tagged_unions(spark):
    df = unions(spark)
    branches = encode(df, ["k"], partitions=1).cache()
    assert same(decode(branches, df.schema), df)
    paths = {r.path for r in branches.collect()}
    assert "u.values.one.values.zigzag" in paths and not any("ex" in p.split(".") for p in paths)
    less = T.StructType([T.StructField("tag", T.StringType()), T.StructField("one", T.LongType())])
    known = {"union": True, "variants": ["One", "myList"]}
    for kind, told in ((less, {"union": True}), (MIXED, known), (MIXED, {})):
        with pytest.raises(PythonException, match="SchemaMismatch"):
            decode(branches, T.StructType([T.StructField("u", kind, True, told)])).collect()
    assert decode(branches, T.StructType([T.StructField("u", MIXED, True, {"union": True, "variants": ["Ex", "One", "MyList"]})])).count() == 7
    branches.unpersist()


def test_codes_without_a_variant(spark):
    branches = encode(unions(spark), ["k"], partitions=1)
    broken = branches.withColumn("payload", F.when(F.col("encoding") == "Union", F.lit(b'["Ex"]')).otherwise(F.col("payload")))
    with pytest.raises(PythonException, match="InvalidFormat"):
        decode(broken, unions(spark).schema).collect()


def test_tuples_and_fixed_lists(spark):
    pair = T.StructType([T.StructField("_0", T.LongType()), T.StructField("_1", T.LongType())])
    triple = T.StructType([*pair.fields, T.StructField("_2", T.LongType())])
    df = spark.createDataFrame([(0, (1, 2), [1, 2]), (1, (3, 4), [5, 6])], T.StructType([T.StructField("k", T.LongType()), T.StructField("t", pair), T.StructField("l", T.ArrayType(T.LongType()))]))
    branches = encode(df, ["k"])
    assert decode(branches, T.StructType([T.StructField("t", pair, True, {"tuple": True}), T.StructField("l", T.ArrayType(T.LongType()), True, {"fixed_length": 2})])).count() == 2
    assert {r.t["_2"] for r in decode(branches, T.StructType([T.StructField("t", triple)])).collect()} == {None}
    for bad in (T.StructField("t", triple, True, {"tuple": True}), T.StructField("l", T.ArrayType(T.LongType()), True, {"fixed_length": 3})):
        with pytest.raises(PythonException, match="SchemaMismatch"):
            decode(branches, T.StructType([bad])).collect()


def test_serial_decoding_holds_one_batch(spark):
    """One task decodes, and neither encodes nor sorts: it reads whole chunks from an exchange."""
    df = spark.range(5000).withColumn("v", F.col("id") * 7 % 13)
    back = decode(encode(df, ["id"], EncodeOptions(chunk_rows=100)), df.schema, DecodeOptions(parallel=False))
    plan = back._jdf.queryExecution().executedPlan().toString()
    steps = plan[: plan.index("Exchange SinglePartition" if "Exchange SinglePartition" in plan else "Exchange RoundRobinPartitioning(1)")]
    assert steps.count("MapInArrow") == 1 and "Sort" not in steps and "Coalesce" not in steps
    assert back.rdd.getNumPartitions() == 1 and same(back, df)
