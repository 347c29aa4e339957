"""Single values: exact sizes alone and in lists of two, round trips, and readers of other types."""

from datetime import date, datetime
from decimal import Decimal

import pyarrow as pa
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafwork.errors import InvalidFormat, SchemaMismatch
from sheafwork.functions import codecs
from sheafwork.options import DecodeOptions, EncodeOptions, options
from sheafwork.plans.encoding import arrow_type
from sheafwork.plans.values import Single, decode_value, encode_value, scalar_variants, single, value_size

LONG, BYTE, BOOL, F64, F32, TEXT = T.LongType(), T.ByteType(), T.BooleanType(), T.DoubleType(), T.FloatType(), T.StringType()
PLAIN = EncodeOptions()
TUPLE, UNION, OPTIONAL = {"tuple": True}, {"union": True}, {"optional": True}


def of(kind):
    return T.ArrayType(kind)


def struct(**fields):
    """Fields by name: a type, or a type and its metadata."""
    return T.StructType([T.StructField(k, *([v, True, None] if isinstance(v, T.DataType) else [v[0], True, v[1]])) for k, v in fields.items()])


def leaves_of(kind, value, told=None, how=PLAIN):
    return list(single("value", kind, pa.array([value], arrow_type(kind)), how, told))


def size(kind, value, told=None, how=PLAIN):
    return sum(leaf[4] for leaf in leaves_of(kind, value, told, how))


def back(kind, leaves, told=None, nullable=True, how=DecodeOptions()):
    return Single(((p, t, e, n, b) for p, t, e, n, _, b in leaves), how).single("value", kind, nullable, told)[0].as_py()


PAIR = struct(_0=LONG, _1=LONG)
BOBS = struct(one=of(LONG), tup=(struct(_0=F64, _1=F64), TUPLE))
BITS = struct(f=F64, obj_array=of(BOBS), extra=(BOBS, OPTIONAL), s=TEXT)


def bobs(one, *tup):
    return {"one": one, "tup": {"_0": tup[0], "_1": tup[1]}}


ITEM = {"f": 5.0, "extra": bobs([99], 9999.99, 200.1), "s": "abc", "obj_array": [bobs([3, 2, 1, 0], 10.0, 200.2), bobs([], 2.2, 200.3), bobs([20] * 7, 0.0, 200.4)]}
RUNS = [x for i in range(560, 570) for x in [True] * i + [False]]
DELTAS = [1_000_000_000, 1_000_000_001, 1_000_000_002, 1_000_000_010, 1_000_000_100, 100_000_050, 1_000_000_125, 1_000_000_122, 999_000_000, 998_001_000, 999_000_000, 1, 3_000_000_100, 1_000]
BITLISTS = [[0, 0, 1, 1, 0], [1, 1, 1, 1, 1, 1, 0], [1, 0, 0, 0, 0, 0, 1]]
ONE = struct(tag=TEXT, one=LONG)
OPTS = struct(tag=TEXT, one=LONG, two=LONG)


def variant(tag, *others, **data):
    return {"tag": tag, **dict.fromkeys(others), **data}


MIXED = [variant("Ex", one=None), variant("One", one=2), variant("One", one=2), variant("One", one=3), variant("Ex", one=None)]

#: Type, metadata, value, its size, and the size of a list of it twice (None: not fixed, or of another text compression).
GOLDEN = {
    "int": (LONG, None, 75339, 4, 8),
    "true": (BOOL, None, True, 1, 5),
    "false": (BOOL, None, False, 1, 5),
    "some": (BOOL, OPTIONAL, True, 1, 9),
    "none": (BOOL, OPTIONAL, None, 1, 3),
    "0": (LONG, None, 0, 1, 5),
    "1": (LONG, None, 1, 1, 5),
    "2": (LONG, None, 2, 2, 6),
    "255": (LONG, None, 255, 2, 6),
    "256": (LONG, None, 256, 3, 8),
    "1023": (LONG, None, 1023, 3, 8),
    "0.0": (F64, None, 0.0, 1, 14),
    "empty text": (TEXT, None, "", 1, 6),
    "pair": (PAIR, TUPLE, {"_0": 0, "_1": 0}, 3, 9),
    "empty list": (of(LONG), None, [], 1, 5),
    "no list": (of(LONG), OPTIONAL, None, 1, 3),
    "empty list of optionals": (of(LONG), {"element": OPTIONAL}, [], 1, 5),
    "list of one": (of(LONG), None, [99], 3, 8),
    "list of a one": (of(LONG), None, [1], 2, 7),
    "list of ints": (of(LONG), None, [99, 100], 6, 10),
    "list of truth values": (of(BOOL), None, [bool(int(x)) for x in "011011100101"], 6, 9),
    "list of a double": (of(F64), None, [0.99], 10, 16),
    "list of doubles": (of(F64), None, [0.01, 0.02, 0.03, 0.04], 36, 65),
    "list of a float": (of(F32), None, [0.99], 6, 14),
    "list of floats": (of(F32), None, [0.01, 0.02, 0.03, 0.04], 20, 38),
    "lists of doubles": (of(of(F64)), None, [[10.0, 11.0], [], [99.0]], 25, 32),
    "lists of tuples": (of(of(PAIR)), {"element": {"element": TUPLE}}, [[{"_0": 1, "_1": 2}, {"_0": 3, "_1": 4}, {"_0": 5, "_1": 6}]], 16, 19),
    "list of optionals": (of(LONG), {"element": OPTIONAL}, [1, 2], 10, 14),
    "four numbers": (of(LONG), None, [0, 1, 2, 3], 8, 10),
    "sixteen numbers": (of(LONG), None, [0] * 16, 6, 8),
    "runs": (of(BOOL), None, RUNS, 36, 68),
    "bits in a tuple": (struct(_0=of(LONG), _1=of(LONG)), TUPLE, {"_0": [0, 0, 1, 1, 0], "_1": [0, 0, 0, 1, 1, 1, 1]}, 11, 15),
    "bits in lists": (of(of(LONG)), None, BITLISTS, 14, 18),
    "deltas": (of(LONG), None, DELTAS, 49, 96),
    "dictionary": (of(TEXT), None, ["abcd", "abcd", "def", "abcd", "abcd", "abcd", ""], 21, 23),
    "one word": (of(TEXT), None, ["abcd"] * 5, 13, 15),
    "two words": (of(TEXT), None, ["abcd"] * 5 + ["def"] * 2, 17, 20),
    "another word": (of(TEXT), None, ["abcd"] * 6 + ["def"], 17, 20),
    "runs of words": (struct(_0=of(TEXT), _1=of(TEXT), _2=LONG), TUPLE, {"_0": ["abc"] * 3, "_1": ["def"] * 3, "_2": 1}, 26, 30),
    "item": (BITS, None, ITEM, 145, 221),
    "items": (of(BITS), None, [ITEM] * 5, 379, 646),
    "struct": (struct(a=LONG), None, {"a": 0}, 4, 8),
    **{f"struct of {n}": (struct(**{chr(97 + i): F64 for i in range(n)}), None, {chr(97 + i): 0.0 for i in range(n)}, root, twice) for n, root, twice in ((14, 44, 200), (15, 47, 214), (16, 50, 228), (17, 53, 242))},
    "empty map": (T.MapType(LONG, LONG), None, [], 2, 8),
    "map of one": (T.MapType(TEXT, LONG), None, [("test", 5)], 10, 21),
    "empty maps": (of(T.MapType(TEXT, TEXT)), None, [[]] * 5, 10, 13),
    "void": (T.NullType(), None, None, 1, 3),
    "struct of void": (struct(i=T.NullType()), None, {"i": None}, 4, 6),
    "variant of text": (struct(tag=TEXT, st=TEXT), UNION, variant("St", st="s"), 6, 16),
    "variant one": (OPTS, UNION, variant("One", "two", one=1), 6, 14),
    "variant two": (OPTS, UNION, variant("Two", "one", two=2), 7, 15),
    "only variant": (ONE, UNION, variant("One", one=1), 6, 14),
    "unit variant": (struct(tag=TEXT), UNION, variant("One"), 6, 12),
    "variant without data": (ONE, UNION, variant("Ex", "one"), 5, 11),
    "variant with data": (ONE, UNION, variant("One", one=10), 7, 15),
    "variants": (of(ONE), {"element": UNION}, MIXED, 21, 24),
    "variant of a list": (struct(tag=TEXT, x=of(LONG)), UNION, variant("X", x=[25, 30, 0, 0, 0]), 11, 21),
}


@pytest.mark.parametrize("name", GOLDEN)
def test_sizes_and_round_trips(name):
    kind, told, value, alone, twice = GOLDEN[name]
    assert size(kind, value, told) == alone
    assert size(of(kind), [value, value], {"element": told or {}}) == twice
    assert back(kind, leaves_of(kind, value, told), told) == pa.array([value], arrow_type(kind))[0].as_py()
    pair = {"element": told or {}}
    assert back(of(kind), leaves_of(of(kind), [value, value], pair), pair) == pa.array([[value, value]], arrow_type(of(kind)))[0].as_py()


def test_lossy_list():
    values = [0.01 * i for i in range(50)]
    assert size(of(F64), values) == 376
    assert size(of(F64), values, None, options(PLAIN, {"lossy_float_tolerance": -10})) == 104


@pytest.mark.parametrize("value", [-1, -2, -255, -256, 2**56 - 1, 2**56, 2**63 - 1, -(2**63), 65_536, 16_777_216])
def test_integers(value):
    leaves = leaves_of(LONG, value)
    assert back(LONG, leaves) == value
    assert leaves[0][4] == 1 + (0 if value == -1 else (abs(value).bit_length() + 7) // 8)


@pytest.mark.parametrize(("kind", "value"), [(T.DecimalType(10, 2), Decimal("-12.50")), (T.DateType(), date(1969, 12, 30)), (T.TimestampNTZType(), datetime(2020, 1, 2, 3, 4, 5, 6)), (T.BinaryType(), b"\xff\x00"), (TEXT, "漢字 " * 50), (F64, -0.0), (F32, -1.0), (T.MapType(TEXT, LONG), [("a", 1), ("b", None), ("c", 3)]), (of(LONG), [None, 5, None])])
def test_other_values(kind, value):
    found = back(kind, leaves_of(kind, value))
    assert found == value and str(found) == str(value)


def test_integers_as_floats():
    assert back(F64, leaves_of(LONG, 7)) == 7.0 and back(F32, leaves_of(LONG, -1)) == -1.0
    assert back(F64, leaves_of(LONG, 2**54 - 1)) == float(2**54 - 1)
    assert back(F64, leaves_of(LONG, -(2**53) + 1)) == float(-(2**53) + 1)
    for kind, value in ((F64, 2**54), (F64, -(2**53)), (F32, 2**25), (F32, -(2**24))):
        with pytest.raises(SchemaMismatch):
            back(kind, leaves_of(LONG, value))
    assert back(F32, leaves_of(F64, 0.5)) == 0.5


def test_readers_that_do_not_fit():
    for kind, value, reader, told in [
        (LONG, 5, TEXT, None), (TEXT, "a", LONG, None), (F64, 1.0, LONG, None), (LONG, 300, BYTE, None), (LONG, 1, BOOL, None), (of(LONG), [1], LONG, None), (LONG, 1, of(LONG), None), (of(LONG), [1], T.MapType(LONG, LONG), None),
        (of(LONG), [1, 2], of(LONG), {"fixed_length": 3}), (PAIR, {"_0": 1, "_1": 2}, struct(_0=LONG, _1=LONG, _2=LONG), TUPLE), (LONG, 1, PAIR, None),
    ]:
        with pytest.raises(SchemaMismatch):
            back(reader, leaves_of(kind, value), told)
    with pytest.raises(SchemaMismatch):
        back(LONG, [], None, False)
    assert back(LONG, [], None, False, DecodeOptions(void_ints_as_zero=True)) == 0
    assert back(LONG, []) is None
    required = T.StructType([T.StructField("y", LONG, False)])
    with pytest.raises(SchemaMismatch):
        back(required, leaves_of(struct(x=LONG), {"x": 1}))
    assert back(struct(x=LONG, y=LONG), leaves_of(struct(x=LONG), {"x": 1})) == {"x": 1, "y": None}
    assert size(struct(myName=LONG), {"myName": 1}) == 9 and back(struct(my_name=LONG), leaves_of(struct(myName=LONG), {"myName": 1})) == {"my_name": 1}


def test_broken_payloads():
    path, types, encoding, n, k, payload = leaves_of(LONG, 75339)[0]
    with pytest.raises(InvalidFormat):
        back(LONG, [(path, types, encoding, n, k, payload[:1])])
    with pytest.raises(InvalidFormat):
        back(TEXT, [("value", "String", "Text", 1, 3, b"\xff\xfe")])
    leaves = leaves_of(T.MapType(LONG, LONG), [(5, 1), (6, 2)])
    twice = [(p, t, e, n, k, leaves_of(of(LONG), [5, 5])[1][5] if p.endswith("keys") else b) for p, t, e, n, k, b in leaves]
    with pytest.raises(InvalidFormat):
        back(T.MapType(LONG, LONG), twice)


def test_columns(spark):
    kind = T.MapType(TEXT, of(LONG))
    rows = [(1, {}), (2, {"a": [1]}), (3, {"a": [], "b": [2, 3]}), (4, None), (None, {"x": [None]}), (None, {"x": [None]})]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("value", LONG), T.StructField("leaves", kind)])).repartition(3)
    stored = df.withColumn("stored", encode_value(kind)(F.col("leaves")))
    read = stored.select("value", "leaves", decode_value(kind)(F.col("stored")).alias("back"), value_size(F.col("stored")).alias("n"))
    found = read.collect()
    assert len(found) == 6 and all(r.leaves == r.back for r in found)
    assert {r.n for r in found if r.value in (1, 4)} == {1, 2}
    assert read.filter("false").collect() == []
    plan = spark.range(9).select(decode_value(LONG)(encode_value(LONG)(F.col("id"))).alias("id"))
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString() and plan.count() == 9
    with pytest.raises(PythonException, match="SchemaMismatch"):
        stored.select(decode_value(LONG)(F.col("stored"))).collect()


def test_variants_are_read_as_one_array():
    """Variants whose data are scalars, as one array for a batch and each by itself."""
    told = {"union": True}
    kind = T.StructType([T.StructField("tag", T.StringType()), T.StructField("a_b", T.DoubleType()), T.StructField("n", T.LongType()), T.StructField("s", T.StringType())])
    rows = [None, {"tag": "aB", "a_b": 0.5}, {"tag": "n", "n": -7}, {"tag": "n"}, {"tag": "s", "s": ""}, {"tag": "other"}, {"tag": "a_b", "a_b": -0.0}]
    column = pa.array(rows, arrow_type(kind))
    stored = encode_value(kind, told).func(column)
    parts = [[(x["path"], x["types"], x["encoding"], x["n_values"], x["payload"]) for x in row] for row in stored.to_pylist()]
    one_by_one = pa.concat_arrays([Single(p, DecodeOptions()).single("value", kind, True, told) for p in parts])
    whole = scalar_variants("value", kind, (Single(p, DecodeOptions()) for p in parts), told)
    assert whole.to_pylist() == one_by_one.to_pylist() == decode_value(kind, told).func(stored).to_pylist() == column.to_pylist()


def test_lists_of_few_values_need_no_arrays_of_them(monkeypatch):
    """Single lists of few integers are written and read without numpy's variable-length integers, and come back."""

    def refused(*args, **kwargs):
        raise AssertionError("few values were coded as many")

    for name in ("varint_sizes", "varint_starts", "bit_lengths"):
        monkeypatch.setattr(codecs, name, refused)
    kind = T.ArrayType(T.LongType())
    column = pa.array([[], [5], [3, 9_000_000, 9_000_001], list(range(1, 1000, 20))], arrow_type(kind))
    assert decode_value(kind).func(encode_value(kind).func(column)).to_pylist() == column.to_pylist()
