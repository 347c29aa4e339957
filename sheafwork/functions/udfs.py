"""Bit-level functions that the JVM lacks, over Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafwork.functions import codecs
from sheafwork.options import EncodeOptions
from sheafwork.plans import choose, leaves


@F.arrow_udf(T.LongType())
def double_bits(c: pa.Array) -> pa.Array:
    """IEEE bits of a double as a long."""
    values = c.to_numpy(zero_copy_only=False).astype(np.float64)
    return pa.array(values.view(np.int64), mask=np.asarray(c.is_null()))


@F.arrow_udf(T.DoubleType())
def bits_double(c: pa.Array) -> pa.Array:
    return pa.array(c.to_numpy(zero_copy_only=False).astype(np.int64).view(np.float64), mask=np.asarray(c.is_null()))


def _lists(code):
    @F.pandas_udf(T.BinaryType())
    def run(c: pd.Series) -> pd.Series:
        return c.map(lambda v: code(np.asarray(v)))

    return run


prefix_varint_bytes = _lists(lambda v: codecs.prefix_varints(v.astype(np.uint64)))
suffix_varint_bytes = _lists(lambda v: codecs.suffix_varints(v.astype(np.uint64)))


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in fields.items()])


def leaf_roundtrip(kind: str, encoding: str):
    """Lists of numbers to the bytes of their leaf under one encoding, and the values read from its payload. kind: int, f64 or f32."""
    dtype = {"int": np.uint64, "f64": np.float64, "f32": np.float32}[kind]

    @F.pandas_udf(_struct(bytes=T.LongType(), back=T.ArrayType(T.DoubleType())))
    def run(c: pd.Series) -> pd.DataFrame:
        rows = []
        for v in c:
            values = np.asarray(v).astype(dtype)
            if encoding == "Suffix Varint":
                payload = codecs.suffix_varints(values)
                back = codecs.read_suffix_varints(payload)
            else:
                payload = leaves.payload_of(encoding, values)
                back = leaves.read_leaf("p", {"p": (kind.upper(), encoding, len(values), payload)}.get)
            rows.append((leaves.stored_bytes(encoding, payload), back.astype(float).tolist()))
        return pd.DataFrame(rows, columns=["bytes", "back"])

    return run


@F.pandas_udf(_struct(bytes=T.LongType(), back=T.ArrayType(T.StringType())))
def text_roundtrip(c: pd.Series) -> pd.DataFrame:
    """Lists of texts to the bytes of their compressed block, and the texts read from it."""
    rows = []
    for v in c:
        texts = [x.encode() for x in v]
        payload = codecs.text_block(texts)
        rows.append((len(payload), [x.decode() for x in codecs.read_text_block(payload, [len(x) for x in texts])]))
    return pd.DataFrame(rows, columns=["bytes", "back"])


@F.pandas_udf(_struct(utf8=T.LongType(), dictionary_values=T.LongType(), run_values=T.LongType(), text_block=T.LongType()))
def text_estimates(c: pd.Series) -> pd.DataFrame:
    """The engine's estimates over the head of each list of texts; of runs and dictionaries without lengths and codes."""
    plain = EncodeOptions()
    rows = []
    for v in c:
        head = [x.encode() for x in v[: plain.sample_values]]
        found = choose.text_candidates(head, plain)
        codes, lengths = choose.dictionary_of(head)[1], choose.runs_of(head)[1]
        rows.append((found["UTF-8"], found["Dictionary"] - 2 - choose.int_size(codes, plain, False), found["RLE"] - 2 - choose.int_size(lengths, plain, True), found["Text Block"]))
    return pd.DataFrame(rows, columns=["utf8", "dictionary_values", "run_values", "text_block"])


@F.pandas_udf(T.StringType())
def chosen_text(c: pd.Series) -> pd.Series:
    """The encoding that a list of texts gets."""
    return c.map(lambda v: next(iter(leaves.text_leaves("p", [x.encode() for x in v], EncodeOptions())))[2])
