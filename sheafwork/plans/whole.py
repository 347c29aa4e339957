"""Sizes of a table encoded as one chunk, without making the chunk.

Under plain encodings (a float's bytes, variable-length integers, texts with their lengths) the payload of a column is the payloads of its
pieces one after the other, so pieces are encoded where their rows stand, and a leaf's bytes are the sum of theirs, with one type id and
one length. What depends on the whole column is asked of it first, by one aggregation: nulls, signs, integers that are all below 2, and
lists of several lengths give leaves of other kinds, whose bytes depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafwork.functions import codecs
from sheafwork.functions import columns as C
from sheafwork.names import canonical
from sheafwork.options import EncodeOptions
from sheafwork.plans.encoding import as_integers, encode, unique_names
from sheafwork.plans.leaves import payload_of, stored_bytes

#: The encodings that a type of numbers or texts can get; they are plain if the first of them is the only one left.
CANDIDATES = {
    "Integer": ("Prefix Varint", "Simple16", "DeltaZig", "RLE"), "F64": ("Fixed F64", "XOR Float"), "F32": ("Fixed F32", "XOR Float"), "String": ("UTF-8", "RLE", "Dictionary", "Text Block"),
}
INTEGERS = (T.IntegralType, T.TimestampType, T.TimestampNTZType, T.DateType)


def label(kind: T.DataType) -> str | None:
    if isinstance(kind, INTEGERS):
        return "Integer"
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return "String"
    return {T.DoubleType: "F64", T.FloatType: "F32"}.get(type(kind))


def leaf_of(kind: T.DataType) -> T.DataType:
    return kind.elementType if isinstance(kind, T.ArrayType) else kind


def number(c: Column, kind: T.DataType) -> Column:
    """What as_integers makes of a value."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), c)
    return F.unix_date(c).cast("long") if isinstance(kind, T.DateType) else c.cast("long")


def additive(df: DataFrame, options: EncodeOptions) -> bool:
    """Whether the bytes of the columns' one chunk are the sum of the bytes of its pieces."""
    facts = [F.count(F.lit(1)) > 0]
    for f in df.schema.fields:
        kind, c = leaf_of(f.dataType), F.col(f"`{f.name}`")
        candidates = CANDIDATES.get(label(kind), ())
        if {"optional", "element"} & f.metadata.keys() or [e for e in candidates if e in options.only] != list(candidates[:1]) or not candidates:
            return False
        facts.append(F.count(c) == F.count(F.lit(1)))
        if isinstance(f.dataType, T.ArrayType):
            facts += [F.min(F.size(c)) == F.max(F.size(c)), F.min(F.size(c)) > 0, F.max(F.exists(c, lambda x: x.isNull()).cast("int")) == 0]
            low, high = (number(g(c), kind) if label(kind) == "Integer" else None for g in (F.array_min, F.array_max))
        else:
            low = high = number(c, kind) if label(kind) == "Integer" else None
        if low is not None:
            facts += [F.min(low) >= 0, F.max(high) >= 2]
    return all(df.agg(*[x.alias(f"f{i}") for i, x in enumerate(facts)]).first())


def piece(path: str, kind: T.DataType, column: pa.Array, encoding: str) -> Iterator[tuple[str, str, str, int, int, int]]:
    """path, types, encoding, number of values, bytes of the payload, and the bytes if they are the same for all pieces."""
    if isinstance(kind, T.ArrayType):
        length = int(column.value_lengths()[0].as_py())
        yield path, "List Fixed", "Fixed Length", len(column), 0, stored_bytes("Fixed Length", length.to_bytes(8, "little"))
        yield from piece(f"{path}.values", kind.elementType, column.flatten(), encoding)
    elif label(kind) == "String":
        yield path, "String", encoding, len(column), len(codecs.length_prefixed(column.cast(pa.binary()).to_pylist())), 0
    else:
        values = as_integers(kind, column).astype(np.uint64) if label(kind) == "Integer" else np.asarray(column)
        yield path, label(kind), encoding, len(values), len(payload_of(encoding, values)), 0


def encoded_whole(df: DataFrame, order_by: list[str], options: EncodeOptions, fields: list[str] | None = None) -> DataFrame:
    """field, path, types, encoding, n_values and byte_size of the leaves of some fields, or all, of a table that is one chunk.

    Columns whose bytes depend on the order of the whole column are encoded as one chunk, in one task.
    """
    unique_names(df)
    wanted = [c for c in df.columns if fields is None or c in fields]
    some = df.select(*[F.col(f"`{c}`") for c in wanted])
    if not additive(some, options):
        one = encode(df, order_by, replace(options, chunk_rows=1 << 30), partitions=1)
        return one.filter(F.col("field").isin([canonical(c) for c in wanted])).select("field", "path", "types", "encoding", "n_values", "byte_size")
    schema = some.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list[int]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                for f, column in zip(schema.fields, batch.slice(at, 4096).columns, strict=True):
                    name = canonical(f.name)
                    for path, types, encoding, n, size, same in piece(name, f.dataType, column, CANDIDATES[label(leaf_of(f.dataType))][0]):
                        sums = found.setdefault((name, path, types, encoding, same), [0, 0])
                        sums[0], sums[1] = sums[0] + n, sums[1] + size
        rows = [(*key, *sums) for key, sums in found.items()]
        if rows:
            kinds = [pa.string()] * 4 + [pa.int64()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["field", "path", "types", "encoding", "same", "n_values", "size"])

    pieces = some.mapInArrow(run, "field string, path string, types string, encoding string, same long, n_values long, size long")
    sums = pieces.groupBy("field", "path", "types", "encoding", "same").agg(F.sum("n_values").alias("n_values"), F.sum("size").alias("size"))
    size = F.when(F.col("same") > 0, F.col("same")).otherwise(F.lit(1) + F.col("size") + C.varint_size("size"))
    return sums.select("field", "path", "types", "encoding", "n_values", size.cast("long").alias("byte_size"))
