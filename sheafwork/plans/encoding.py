"""encode: a DataFrame to a table of encoded branches; decode: the table to a DataFrame under a schema of the reader's.

A chunk is a run of rows in order; each chunk of each schema path is encoded by itself, so chunks are coded in parallel, in
bounded memory. Shredding works on Arrow columns, which already hold one flat array for each path.

Metadata of a field tells what Spark's types can't: {"union": True} makes a struct a tagged union, whose field `tag` names the
one other field that is set, or none for a variant without data; {"tuple": True} lets a struct be read only with as many
fields as were written; {"fixed_length": n} lets a list be read only if all its lists have n elements; {"element": {...}} is
what such metadata say of a list's elements; {"optional": True} has flags stored though no value is null. A reader's {"variants": [...]} names all variants that it knows, for unions with
variants without data.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from sheafwork.errors import InvalidFormat, SchemaMismatch
from sheafwork.functions import codecs
from sheafwork.names import canonical
from sheafwork.options import DecodeOptions, EncodeOptions
from sheafwork.plans import choose
from sheafwork.plans.leaves import Leaf, Lookup, bool_leaves, float_leaves, int_leaves, read_ints, read_leaf, stored_bytes, text_leaves

#: Bits of chunk_id: the chunk's place in its task, and the task. What is above is left to batches of streams.
CHUNK_BITS, TASK_BITS = 20, 22
PARTS = ("path", "types", "encoding", "n_values", "payload")
BRANCHES = "field string, path string, types string, encoding string, chunk_id long, n_values long, byte_size long, payload binary"


def shred(path: str, kind: T.DataType, column: pa.Array, options: EncodeOptions, told: dict | None = None) -> Iterator[Leaf]:
    """Leaves of a column; a nullable part is a flag for each value and the values that are there."""
    if (column.null_count or len(column) and told and told.get("optional")) and not isinstance(kind, T.NullType):
        if column.null_count == len(column):
            yield path, "Void", "Void", len(column), b""
            return
        yield path, "Nullable", "Nullable", len(column), b""
        yield from bool_leaves(f"{path}.opt", np.asarray(column.is_valid()), options)
        yield from shred(f"{path}.values", kind, column.drop_null(), options, {k: v for k, v in (told or {}).items() if k != "optional"})
        return
    n = len(column)
    if isinstance(kind, T.StructType) and told and told.get("union"):
        yield from union_leaves(path, kind, column, options)
    elif isinstance(kind, T.StructType):
        yield path, "Object", "Object", n, bytes(codecs.prefix_varints(np.array([len(kind.fields)], np.uint64)))
        for i, f in enumerate(kind.fields):
            yield from shred(f"{path}.{canonical(f.name)}", f.dataType, column.flatten()[i], options, f.metadata)
    elif isinstance(kind, T.ArrayType):
        lengths, values = np.asarray(column.value_lengths()).astype(np.uint64), column.flatten()
        yield from listed(path, lengths, "List", options)
        yield from shred(f"{path}.values", kind.elementType, values, options, (told or {}).get("element"))
    elif isinstance(kind, T.MapType):
        lengths = np.diff(np.asarray(column.offsets)).astype(np.uint64)
        low, high = column.offsets[0].as_py(), column.offsets[-1].as_py()
        keys, items = column.keys[low:high], column.items[low:high]
        # Entries in order of their keys, so that equal maps are stored alike.
        order = pa.compute.sort_indices(pa.table({"row": np.repeat(np.arange(n), lengths.astype(np.int64)), "key": keys}), sort_keys=[("row", "ascending"), ("key", "ascending")])
        yield from listed(path, lengths, "Map", options)
        yield from shred(f"{path}.keys", kind.keyType, keys.take(order), options)
        yield from shred(f"{path}.values", kind.valueType, items.take(order), options)
    elif isinstance(kind, T.BooleanType):
        yield from bool_leaves(path, np.asarray(column), options)
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        yield from float_leaves(path, np.asarray(column), options)
    elif isinstance(kind, (T.StringType, T.BinaryType)):
        yield from text_leaves(path, [bytes(x) for x in column.cast(pa.binary()).to_pylist()], options)
    elif isinstance(kind, T.DecimalType):
        yield from text_leaves(path, [str(x).encode() for x in column.to_pylist()], options)
    elif isinstance(kind, T.NullType):
        yield path, "Void", "Void", n, b""
    else:
        yield from signed_leaves(path, as_integers(kind, column), options)


def union_leaves(path: str, kind: T.StructType, column: pa.Array, options: EncodeOptions) -> Iterator[Leaf]:
    """Codes of variants by first appearance, and a branch of values for each variant that appears and has some."""
    parts = dict(zip((f.name for f in kind.fields), column.flatten(), strict=True))
    names, codes = choose.dictionary_of(parts["tag"].to_pylist())
    if None in names:
        raise SchemaMismatch(f"a value of {path} has no tag")
    yield path, "Union", "Union", len(column), json.dumps(names).encode()
    yield from int_leaves(f"{path}.discriminants", codes, options)
    for code, name in enumerate(names):
        for f in kind.fields:
            if f.name != "tag" and canonical(f.name) == canonical(name):
                yield from shred(f"{path}.{canonical(name)}", f.dataType, parts[f.name].filter(pa.array(codes == code)), options, f.metadata)


def name_bytes(named: T.StructType | list[str], told: dict | None = None) -> int:
    """Bytes of the names of a struct's fields, or of variants, each with its length, and of a number of fields over 8; a tuple's have none."""
    if isinstance(named, list):
        sizes = [len(canonical(v).encode()) for v in named]
        return sum(n + choose.varint_size(n) for n in sizes)
    if (told or {}).get("tuple"):
        return 0
    n = len(named.fields)
    return name_bytes(named.names) + (choose.varint_size(n - 9) if n > 8 else 0)


def as_integers(kind: T.DataType, column: pa.Array) -> np.ndarray:
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return np.asarray(column.cast(pa.timestamp("us", getattr(column.type, "tz", None))).cast(pa.int64()))
    if isinstance(kind, T.DateType):
        return np.asarray(column.cast(pa.int32())).astype(np.int64)
    return np.asarray(column).astype(np.int64)


def signed_leaves(path: str, values: np.ndarray, options: EncodeOptions) -> Iterator[Leaf]:
    """Negative numbers make a column zigzag."""
    if len(values) and values.min() < 0:
        yield path, "Zigzag", "Zigzag", len(values), b""
        yield from int_leaves(f"{path}.zigzag", (values << 1 ^ values >> 63).view(np.uint64), options)
    else:
        yield from int_leaves(path, values.astype(np.uint64), options)


def listed(path: str, lengths: np.ndarray, kind: str, options: EncodeOptions) -> Iterator[Leaf]:
    if kind == "List" and len(lengths) and (lengths == lengths[0]).all():
        yield path, "List Fixed", "Fixed Length", len(lengths), int(lengths[0]).to_bytes(8, "little")
    else:
        yield path, kind, "Variable Length", len(lengths), b""
        yield from int_leaves(f"{path}.len", lengths, options)


def encode_chunk(schema: T.StructType, chunk_id: int, batch: pa.Table, options: EncodeOptions) -> pa.RecordBatch:
    rows = []
    for f in schema.fields:
        column = batch.column(f.name).combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        name = canonical(f.name)
        for path, types, encoding, n, payload in shred(name, f.dataType, column, options, f.metadata):
            rows.append((name, path, types, encoding, chunk_id, n, stored_bytes(encoding, payload), payload))
    kinds = [pa.string()] * 4 + [pa.int64()] * 3 + [pa.binary()]
    names = ["field", "path", "types", "encoding", "chunk_id", "n_values", "byte_size", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def unique_names(df: DataFrame) -> None:
    names = [canonical(c) for c in df.columns]
    if len(set(names)) != len(names):
        raise SchemaMismatch("two columns have one canonical name")


def encode(df: DataFrame, order_by: list[str], options: EncodeOptions = EncodeOptions(), partitions: int | None = None) -> DataFrame:
    """Encoded branches of a DataFrame in the given order. Rows are range-partitioned by it once, equal keys by a hash of the row
    after that, so that a key with very many rows is split; no task sees more than its range.

    chunk_id grows with the order: the task's number times 2^CHUNK_BITS and the chunk's place in the task.
    """
    unique_names(df)
    schema = df.schema
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64(*[F.to_json(F.struct(F.col(f.name))) if any(k in f.dataType.simpleString() for k in ("map", "void")) else F.col(f.name) for f in schema.fields])
    keyed = df.withColumn("__tie", tie)
    ordered = keyed.repartitionByRange(n, *order_by, "__tie").sortWithinPartitions(*order_by, "__tie").drop("__tie").withColumn("__part", F.spark_partition_id().cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = chunk = 0
        part = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.column(batch.num_columns - 1)[0].as_py()
                some = batch.slice(at, options.chunk_rows - rows)
                held.append(some)
                rows, at = rows + some.num_rows, at + some.num_rows
                if rows == options.chunk_rows:
                    yield encode_chunk(schema, (part << CHUNK_BITS) + chunk, pa.Table.from_batches(held), options)
                    held, rows, chunk = [], 0, chunk + 1
        if held:
            yield encode_chunk(schema, (part << CHUNK_BITS) + chunk, pa.Table.from_batches(held), options)

    return ordered.mapInArrow(run, BRANCHES)


class Chunk:
    """A chunk's leaves by path."""

    def __init__(self, rows: Iterator[tuple[str, str, str, int, bytes]], options: DecodeOptions):
        self.leaves = {path: (types, encoding, n, payload) for path, types, encoding, n, payload in rows}
        self.options = options
        self.look: Lookup = self.leaves.get

    def column(self, path: str, kind: T.DataType, nullable: bool, n: int, told: dict | None = None) -> pa.Array:
        """Values of a path as an Arrow array of the reader's type."""
        arrow = arrow_type(kind)
        found = self.leaves.get(path)
        if found is None or found[1] == "Void" and n:
            if isinstance(kind, T.NullType) or nullable:
                return pa.nulls(n, arrow)
            if self.options.void_ints_as_zero and isinstance(kind, T.IntegralType):
                return pa.array(np.zeros(n, np.int64)).cast(arrow)
            raise SchemaMismatch(f"{path} is required and not stored")
        types, encoding = found[:2]
        if isinstance(kind, T.NullType):
            return pa.nulls(n)
        if encoding == "Nullable":
            if not nullable:
                raise SchemaMismatch(f"{path} has nulls")
            valid = np.asarray(read_leaf(f"{path}.opt", self.look)).astype(bool)[:n]
            values = self.column(f"{path}.values", kind, False, int(valid.sum()), told)
            index = np.where(valid, np.cumsum(valid) - 1, 0)
            return values.take(pa.array(index, mask=~valid))
        told = told or {}
        if isinstance(kind, T.StructType):
            if types != ("Union" if told.get("union") else "Object"):
                raise SchemaMismatch(f"{path} is a {types}")
            if types == "Union":
                return self._union(path, kind, n, told)
            if told.get("tuple") and int(codecs.read_prefix_varints(found[3])[0]) != len(kind.fields):
                raise SchemaMismatch(f"{path} has another number of parts")
            parts = [self.column(f"{path}.{canonical(f.name)}", f.dataType, f.nullable, n, f.metadata) for f in kind.fields]
            return pa.StructArray.from_arrays(parts, fields=list(arrow))
        if isinstance(kind, (T.ArrayType, T.MapType)):
            return self._list(path, kind, types, encoding, n, told)
        if encoding in ("Object", "Union", "Fixed Length", "Variable Length"):
            raise SchemaMismatch(f"{path} is a {types}")
        values = self._leaf(path, kind, types, n)
        return values if values.type == arrow else values.cast(arrow)

    def _union(self, path: str, kind: T.StructType, n: int, told: dict) -> pa.Array:
        names, codes = json.loads(self.leaves[path][3]), read_ints(f"{path}.discriminants", self.look).astype(np.int64)
        if len(codes) and codes.max() >= len(names):
            raise InvalidFormat(f"a code of {path} has no variant")
        fields = {canonical(f.name): f for f in kind.fields if f.name != "tag"}
        known = {canonical(v) for v in told["variants"]} if "variants" in told else None
        for name in map(canonical, names):
            if name not in fields and (f"{path}.{name}" in self.leaves or known is not None and name not in known):
                raise SchemaMismatch(f"{path} has a variant {name} that the reader doesn't know")
        parts = []
        for f in kind.fields:
            if f.name == "tag":
                parts.append(pa.array([names[c] for c in codes.tolist()], pa.string()))
                continue
            here = np.isin(codes, [k for k, name in enumerate(names) if canonical(name) == canonical(f.name)])
            if not here.any():
                parts.append(pa.nulls(n, arrow_type(f.dataType)))
                continue
            values = self.column(f"{path}.{canonical(f.name)}", f.dataType, True, int(here.sum()), f.metadata)
            parts.append(values.take(pa.array(np.where(here, np.cumsum(here) - 1, 0), mask=~here)))
        return pa.StructArray.from_arrays(parts, fields=list(arrow_type(kind)))

    def _list(self, path: str, kind: T.ArrayType | T.MapType, types: str, encoding: str, n: int, told: dict) -> pa.Array:
        if not types.startswith("Map" if isinstance(kind, T.MapType) else "List"):
            raise SchemaMismatch(f"{path} is a {types}")
        if encoding == "Fixed Length":
            lengths = np.full(n, int.from_bytes(self.leaves[path][3], "little"), np.int64)
        else:
            lengths = read_ints(f"{path}.len", self.look).astype(np.int64)
        if "fixed_length" in told and (lengths != told["fixed_length"]).any():
            raise SchemaMismatch(f"{path} has lists that don't have {told['fixed_length']} elements")
        offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32))
        total = int(lengths.sum())
        if isinstance(kind, T.ArrayType):
            values = self.column(f"{path}.values", kind.elementType, kind.containsNull, total, told.get("element")) if total else pa.array([], arrow_type(kind.elementType))
            return pa.ListArray.from_arrays(offsets, values)
        keys = self.column(f"{path}.keys", kind.keyType, False, total) if total else pa.array([], arrow_type(kind.keyType))
        values = self.column(f"{path}.values", kind.valueType, kind.valueContainsNull, total) if total else pa.array([], arrow_type(kind.valueType))
        rows = np.repeat(np.arange(n), lengths)
        if len(pa.table({"row": rows, "key": keys}).group_by(["row", "key"]).aggregate([])) != total:
            raise InvalidFormat(f"a map of {path} has a key twice")
        return pa.MapArray.from_arrays(offsets, keys, values)

    def _leaf(self, path: str, kind: T.DataType, types: str, n: int) -> pa.Array:
        if types == "Zigzag":
            if not isinstance(kind, (T.IntegralType, T.TimestampType, T.TimestampNTZType, T.DateType)):
                raise SchemaMismatch(f"{path} holds integers")
            z = read_ints(f"{path}.zigzag", self.look)
            return integers(path, kind, ((z >> np.uint64(1)).view(np.int64) ^ -(z & np.uint64(1)).astype(np.int64)))
        values = read_leaf(path, self.look)
        text = isinstance(values, list)
        if isinstance(kind, (T.StringType, T.BinaryType, T.DecimalType)):
            if not text:
                raise SchemaMismatch(f"{path} holds no text")
            if isinstance(kind, T.BinaryType):
                return pa.array(values, pa.binary())
            try:
                return pa.array([v.decode() for v in values])
            except UnicodeDecodeError as e:
                raise InvalidFormat(f"{path} is no UTF-8") from e
        if text:
            raise SchemaMismatch(f"{path} holds text")
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            if types not in ("F32", "F64"):
                raise SchemaMismatch(f"{path} holds no floats")
            return pa.array(values[:n])
        if types in ("F32", "F64"):
            raise SchemaMismatch(f"{path} holds floats")
        if isinstance(kind, T.BooleanType):
            if values.dtype != bool:
                raise SchemaMismatch(f"{path} holds no truth values")
            return pa.array(values[:n])
        return integers(path, kind, values[:n].astype(np.int64))


LIMITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32}


def integers(path: str, kind: T.DataType, values: np.ndarray) -> pa.Array:
    bits = LIMITS.get(type(kind))
    if bits and len(values) and (values.max() >= 1 << (bits - 1) or values.min() < -(1 << (bits - 1))):
        raise SchemaMismatch(f"a value of {path} doesn't fit")
    if isinstance(kind, T.DateType):
        return pa.array(values.astype(np.int32)).cast(pa.date32())
    return pa.array(values)


def relaxed(kind: T.DataType) -> T.DataType:
    """The type with all that it holds nullable, as Arrow arrays are."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, relaxed(f.dataType), True) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(relaxed(kind.elementType), True)
    if isinstance(kind, T.MapType):
        return T.MapType(relaxed(kind.keyType), relaxed(kind.valueType), True)
    return kind


#: Arrow types by the identity of the type that is kept with them: types are slow to hash.
ARROW_TYPES: dict[int, tuple[T.DataType, pa.DataType]] = {}


def arrow_type(kind: T.DataType) -> pa.DataType:
    found = ARROW_TYPES.get(id(kind))
    if found is None or found[0] is not kind:  # a pickled copy has other identities
        if len(ARROW_TYPES) > 1000:
            ARROW_TYPES.clear()
        found = ARROW_TYPES[id(kind)] = kind, to_arrow_type(relaxed(kind), timestamp_utc=True)
    return found[1]


def decode(branches: DataFrame, schema: T.StructType, options: DecodeOptions = DecodeOptions()) -> DataFrame:
    """Rows of the branches under the reader's schema. Branches of other fields are not read; fields are matched by canonical
    name; a missing field is null if it may be, and else an error. Rows come in order within a chunk. Rows are those of the reader's
    stored fields: of a schema none of whose fields is stored, nothing is read and no rows come.

    Not in parallel, the leaves of each chunk are put together in many tasks, and one task decodes the chunks as they come."""
    wanted = [canonical(f.name) for f in schema.fields]
    needed = branches.filter(F.col("field").isin(wanted)).select("chunk_id", *PARTS)

    def chunk_rows(leaves: Iterator[tuple]) -> pa.Table:
        chunk = Chunk(leaves, options)
        n = max((chunk.leaves[w][2] for w in wanted if w in chunk.leaves), default=0)
        arrays = [chunk.column(w, f.dataType, f.nullable, n, f.metadata) for w, f in zip(wanted, schema.fields, strict=True)]
        return pa.table(arrays, names=[f.name for f in schema.fields])

    def run(key, leaves):
        return chunk_rows(zip(*[leaves.column(c).to_pylist() for c in PARTS], strict=True))

    def run_serial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for leaves in batch.column(0):
                yield from chunk_rows(tuple(x[c] for c in PARTS) for x in leaves.as_py()).to_batches()

    if options.parallel:
        return needed.groupBy("chunk_id").applyInArrow(run, relaxed(schema))
    chunks = needed.groupBy("chunk_id").agg(F.collect_list(F.struct(*PARTS)).alias("leaves")).select("leaves")
    return chunks.repartition(1).mapInArrow(run_serial, relaxed(schema))
