"""Single values: each row's value of a column is encoded by itself, as its own document.

What a value alone can do without is left out: 0, 1, -1, NaN, truth values, short texts and empty lists have no payload, integers
take the bytes that they need, a list or map of one entry holds that entry as a single value again, and only lists and maps of
several entries become branches, encoded as a chunk's are. All is one Column expression in each direction: rows stay where
they are, and nothing is shuffled.

The leaves' byte_size includes the names of fields and variants, so their sum is the size of the value.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafwork.errors import InvalidFormat, SchemaMismatch
from sheafwork.functions import codecs
from sheafwork.names import canonical
from sheafwork.options import DecodeOptions, EncodeOptions
from sheafwork.plans.choose import varint_size
from sheafwork.plans.encoding import LIMITS, Chunk, arrow_type, as_integers, integers, name_bytes, shred
from sheafwork.plans.leaves import stored_bytes

LEAF = T.StructType([T.StructField(c, k) for c, k in (("path", T.StringType()), ("types", T.StringType()), ("encoding", T.StringType()), ("n_values", T.LongType()), ("byte_size", T.LongType()), ("payload", T.BinaryType()))])
LEAVES = T.ArrayType(LEAF)

#: path, type, encoding, number of values, bytes, payload
Sized = tuple[str, str, str, int, int, bytes]

#: Powers of two below which integers are read as floats, and from minus which on.
FLOAT_BITS = {T.FloatType: (25, 24), T.DoubleType: (54, 53)}


def single(path: str, kind: T.DataType, one: pa.Array, options: EncodeOptions, told: dict | None) -> Iterator[Sized]:
    """Leaves of an array of one value."""
    told = told or {}
    if one.null_count or isinstance(kind, T.NullType):
        yield path, "Void", "Void", 1, 1, b""
    elif isinstance(kind, T.StructType) and told.get("union"):
        parts = dict(zip((f.name for f in kind.fields), one.flatten(), strict=True))
        yield from single_variant(path, kind, parts["tag"][0].as_py(), parts, 0, options)
    elif isinstance(kind, T.StructType):
        header = codecs.prefix_varints(np.array([len(kind.fields)], np.uint64))
        yield path, "Object", "Single Object", 1, 1 + name_bytes(kind, told), bytes(header)
        for f, part in zip(kind.fields, one.flatten(), strict=True):
            yield from single(f"{path}.{canonical(f.name)}", f.dataType, part, options, f.metadata)
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        yield from single_list(path, kind, one, options, told)
    elif isinstance(kind, T.BooleanType):
        yield path, "Boolean", "True" if one[0].as_py() else "False", 1, 1, b""
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        encoding, payload = single_float(np.asarray(one))
        yield path, f"F{8 * np.asarray(one).itemsize}", encoding, 1, 1 + len(payload), payload
    elif isinstance(kind, (T.StringType, T.BinaryType, T.DecimalType)):
        text = one[0].as_py()
        data = str(text).encode() if isinstance(kind, T.DecimalType) else text.encode() if isinstance(text, str) else bytes(text)
        yield path, "String", "Text", 1, 1 + len(data) + (varint_size(len(data)) if len(data) > 3 else 0), data
    else:
        encoding, payload = single_integer(int(as_integers(kind, one)[0]))
        yield path, "Integer", encoding, 1, 1 + len(payload), payload


def single_variant(path: str, kind: T.StructType, tag: str | None, parts: dict[str, pa.Array], i: int, options: EncodeOptions) -> Iterator[Sized]:
    """Leaves of a place of a union's parts."""
    if tag is None:
        raise SchemaMismatch(f"a value of {path} has no tag")
    name = canonical(tag)
    yield path, "Union", "Single Variant", 1, 1 + name_bytes([tag]), tag.encode()
    for f in kind.fields:
        if f.name != "tag" and canonical(f.name) == name:
            yield from single(f"{path}.{name}", f.dataType, parts[f.name].slice(i, 1), options, f.metadata)
            return
    yield f"{path}.{name}", "Void", "Void", 1, 1, b""


def singles(path: str, kind: T.DataType, values: pa.Array, options: EncodeOptions, told: dict | None) -> Iterator[Iterator[Sized]]:
    """Leaves of each value; a union's parts are taken apart once for all."""
    if not (isinstance(kind, T.StructType) and (told or {}).get("union")):
        for i in range(len(values)):
            yield single(path, kind, values.slice(i, 1), options, told)
        return
    parts = dict(zip((f.name for f in kind.fields), values.flatten(), strict=True))
    for i, (there, tag) in enumerate(zip(values.is_valid().to_pylist(), parts["tag"].to_pylist(), strict=True)):
        yield single_variant(path, kind, tag, parts, i, options) if there else iter([(path, "Void", "Void", 1, 1, b"")])


def single_list(path: str, kind: T.ArrayType | T.MapType, one: pa.Array, options: EncodeOptions, told: dict) -> Iterator[Sized]:
    """A list or map: of none, of a single value, or of branches."""
    mapped = isinstance(kind, T.MapType)
    label = "Map" if mapped else "List"
    if mapped:
        low, high = one.offsets[0].as_py(), one.offsets[-1].as_py()
        keys, items = one.keys[low:high], one.items[low:high]
        order = pa.compute.sort_indices(keys)
        parts = [("keys", kind.keyType, keys.take(order), None), ("values", kind.valueType, items.take(order), None)]
    else:
        parts = [("values", kind.elementType, one.flatten(), told.get("element"))]
    n = len(parts[0][2])
    count = bytes(codecs.prefix_varints(np.array([n], np.uint64)))
    # The id tells lists of none and of one; a map's number is always written.
    yield path, label, f"{label} {n if n < 2 else 'N'}", n, 1 + (len(count) if mapped or n > 1 else 0), count
    for name, inner, values, own in parts:
        if n == 1:
            yield from single(f"{path}.{name}", inner, values, options, own)
        elif n > 1:
            leaves = list(shred(f"{path}.{name}", inner, values, options, own))
            names = names_in(f"{path}.{name}", inner, own, {leaf[0]: leaf for leaf in leaves})
            for at, types, encoding, k, payload in leaves:
                yield at, types, encoding, k, stored_bytes(encoding, payload) + names.get(at, 0), payload


def names_in(path: str, kind: T.DataType, told: dict | None, leaves: dict) -> dict[str, int]:
    """Bytes of the names that structs and unions of branches have, by path."""
    told, found = told or {}, leaves.get(path)
    if found is None:
        return {}
    if found[2] == "Nullable":
        return names_in(f"{path}.values", kind, told, leaves)
    out: dict[str, int] = {}
    if found[2] in ("Object", "Union"):
        variants = json.loads(found[4]) if found[2] == "Union" else None
        out[path] = name_bytes(kind if variants is None else variants, told)
        if variants is not None:  # their number, and an id for each variant without data
            out[path] += varint_size(len(variants)) + sum(f"{path}.{canonical(v)}" not in leaves for v in variants)
        parts = [(f"{path}.{canonical(f.name)}", f.dataType, f.metadata) for f in kind.fields if variants is None or f.name != "tag"]
    elif isinstance(kind, T.ArrayType):
        parts = [(f"{path}.values", kind.elementType, told.get("element"))]
    elif isinstance(kind, T.MapType):
        parts = [(f"{path}.keys", kind.keyType, None), (f"{path}.values", kind.valueType, None)]
    else:
        parts = []
    for at, inner, own in parts:
        out |= names_in(at, inner, own, leaves)
    return out


def single_integer(value: int) -> tuple[str, bytes]:
    """0, 1 and -1 have no payload; others the bytes of their amount, and the sign in the id."""
    if value in (0, 1, -1):
        return {0: "Zero", 1: "One", -1: "Minus One"}[value], b""
    width = (abs(value).bit_length() + 7) // 8
    return f"Int {'S' if value < 0 else 'U'}{8 * width}", abs(value).to_bytes(width, "little")


def single_float(one: np.ndarray) -> tuple[str, bytes]:
    """0.0, 1.0, -1.0 and NaN have no payload; -0.0 has, so that its sign is kept."""
    value = one[0]
    if np.isnan(value):
        return "NaN", b""
    if value in (1, -1) or value == 0 and not np.signbit(value):
        return {0: "Zero", 1: "One", -1: "Minus One"}[int(value)], b""
    return f"Fixed F{8 * one.itemsize}", one.astype(one.dtype.newbyteorder("<")).tobytes()


class Single(Chunk):
    """The leaves of one value."""

    def single(self, path: str, kind: T.DataType, nullable: bool, told: dict | None = None) -> pa.Array:
        """The value at a path as an array of the reader's type."""
        told, arrow, found = told or {}, arrow_type(kind), self.leaves.get(path)
        if isinstance(kind, T.NullType):
            return pa.nulls(1)
        if found is None or found[1] == "Void":
            if nullable:
                return pa.nulls(1, arrow)
            if self.options.void_ints_as_zero and isinstance(kind, T.IntegralType):
                return pa.array([0], arrow)
            raise SchemaMismatch(f"{path} is required and not stored")
        types, encoding, n, payload = found
        if isinstance(kind, T.StructType):
            return self._variant(path, kind, payload, told) if told.get("union") and types == "Union" else self._object(path, kind, types, payload, told)
        if isinstance(kind, (T.ArrayType, T.MapType)):
            return self._entries(path, kind, types, n, told)
        value = self._scalar(path, kind, found)
        if isinstance(kind, T.DecimalType):
            return pa.array([value]).cast(arrow)
        if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return integers(path, kind, np.array([value], np.int64)).cast(arrow)
        return pa.array([value], arrow)

    def _scalar(self, path: str, kind: T.DataType, found: tuple[str, str, int, bytes]) -> bool | str | bytes | float | int:
        """A number or text as Python has it; the number of a date or time."""
        types, encoding, _, payload = found
        if types in ("Object", "Union", "List", "Map"):
            raise SchemaMismatch(f"{path} is a {types}")
        if isinstance(kind, T.BooleanType):
            if types != "Boolean":
                raise SchemaMismatch(f"{path} holds no truth value")
            return encoding == "True"
        if isinstance(kind, (T.StringType, T.BinaryType, T.DecimalType)):
            if types != "String":
                raise SchemaMismatch(f"{path} holds no text")
            try:
                return payload if isinstance(kind, T.BinaryType) else payload.decode()
            except UnicodeDecodeError as e:
                raise InvalidFormat(f"{path} is no UTF-8") from e
        if types not in ("Integer", "F32", "F64"):
            raise SchemaMismatch(f"{path} holds no number")
        value = self._number(path, types, encoding, payload)
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            above, below = FLOAT_BITS[type(kind)]
            if types == "Integer" and not -(1 << below) < value < 1 << above:
                raise SchemaMismatch(f"the integer at {path} is too large for a float")
            return float(np.float32(value) if isinstance(kind, T.FloatType) else value)
        if types != "Integer":
            raise SchemaMismatch(f"{path} holds a float")
        if not -(1 << 63) <= value < 1 << 63:
            raise SchemaMismatch(f"the value of {path} doesn't fit")
        bits = LIMITS.get(type(kind), 64)
        if not -(1 << (bits - 1)) <= value < 1 << (bits - 1):
            raise SchemaMismatch(f"a value of {path} doesn't fit")
        return value

    def _number(self, path: str, types: str, encoding: str, payload: bytes) -> int | float:
        known = {"Zero": 0, "One": 1, "Minus One": -1, "NaN": float("nan")}
        if encoding in known:
            return known[encoding]
        size = int(encoding[5:]) // 8 if encoding.startswith("Int ") else int(encoding[7:]) // 8
        if len(payload) != size:
            raise InvalidFormat(f"the payload at {path} is cut")
        if types == "Integer":
            return int.from_bytes(payload, "little") * (-1 if encoding[4] == "S" else 1)
        return np.frombuffer(payload, f"<f{size}")[0]

    def _object(self, path: str, kind: T.StructType, types: str, payload: bytes, told: dict) -> pa.Array:
        if types != "Object" or told.get("union"):
            raise SchemaMismatch(f"{path} is a {types}")
        if told.get("tuple") and int(codecs.read_prefix_varints(payload)[0]) != len(kind.fields):
            raise SchemaMismatch(f"{path} has another number of parts")
        parts = [self.single(f"{path}.{canonical(f.name)}", f.dataType, f.nullable, f.metadata) for f in kind.fields]
        return pa.StructArray.from_arrays(parts, fields=list(arrow_type(kind)))

    def _tag(self, path: str, kind: T.StructType, payload: bytes, told: dict) -> tuple[str, str]:
        """A variant's name, and its canonical one, which the reader knows."""
        tag = payload.decode()
        name = canonical(tag)
        fields = {canonical(f.name): f for f in kind.fields if f.name != "tag"}
        known = {canonical(v) for v in told["variants"]} if "variants" in told else None
        stored = self.leaves.get(f"{path}.{name}")
        if name not in fields and (stored is not None and stored[1] != "Void" or known is not None and name not in known):
            raise SchemaMismatch(f"{path} has a variant {name} that the reader doesn't know")
        return tag, name

    def _variant(self, path: str, kind: T.StructType, payload: bytes, told: dict) -> pa.Array:
        tag, name = self._tag(path, kind, payload, told)
        parts = []
        for f in kind.fields:
            if f.name == "tag":
                parts.append(pa.array([tag]))
            elif canonical(f.name) == name:
                parts.append(self.single(f"{path}.{name}", f.dataType, True, f.metadata))
            else:
                parts.append(pa.nulls(1, arrow_type(f.dataType)))
        return pa.StructArray.from_arrays(parts, fields=list(arrow_type(kind)))

    def _entries(self, path: str, kind: T.ArrayType | T.MapType, types: str, n: int, told: dict) -> pa.Array:
        mapped = isinstance(kind, T.MapType)
        if types != ("Map" if mapped else "List"):
            raise SchemaMismatch(f"{path} is a {types}")
        if told.get("fixed_length", n) != n:
            raise SchemaMismatch(f"{path} has a list that doesn't have {told['fixed_length']} elements")

        def part(name: str, inner: T.DataType, nullable: bool, own: dict | None) -> pa.Array:
            if not n:
                return pa.array([], arrow_type(inner))
            return self.single(f"{path}.{name}", inner, nullable, own) if n == 1 else self.column(f"{path}.{name}", inner, nullable, n, own)

        offsets = pa.array([0, n], pa.int32())
        if not mapped:
            return pa.ListArray.from_arrays(offsets, part("values", kind.elementType, kind.containsNull, told.get("element")))
        keys = part("keys", kind.keyType, False, None)
        if len(pa.compute.unique(keys)) != n:
            raise InvalidFormat(f"a map of {path} has a key twice")
        return pa.MapArray.from_arrays(offsets, keys, part("values", kind.valueType, kind.valueContainsNull, None))


#: Types whose values one Python object holds.
SCALARS = (T.IntegralType, T.FloatType, T.DoubleType, T.StringType, T.BinaryType, T.BooleanType)


def scalar_variants(path: str, kind: T.StructType, rows: Iterator[Single], told: dict) -> pa.Array:
    """Variants whose data are scalars, which may be missing, as one array."""
    parts: dict[str, list] = {f.name: [] for f in kind.fields}
    gone = []
    for row in rows:
        found = row.leaves.get(path)
        there = found is not None and found[1] != "Void"
        if there and found[0] != "Union":
            raise SchemaMismatch(f"{path} is a {found[0]}")
        tag, name = row._tag(path, kind, found[3], told) if there else (None, None)
        gone.append(not there)
        for f in kind.fields:
            data = None
            if f.name == "tag":
                data = tag
            elif there and canonical(f.name) == name:
                leaf = row.leaves.get(f"{path}.{name}")
                data = None if leaf is None or leaf[1] == "Void" else row._scalar(f"{path}.{name}", f.dataType, leaf)
            parts[f.name].append(data)
    arrow = arrow_type(kind)
    return pa.StructArray.from_arrays([pa.array(parts[f.name], f.type) for f in arrow], fields=list(arrow), mask=pa.array(gone, pa.bool_()))


def encode_value(kind: T.DataType, told: dict | None = None, options: EncodeOptions = EncodeOptions(), path: str = "value") -> Callable[[Column], Column]:
    """A function of a Column of the type: each value's leaves. told: the metadata that the column's field would have."""

    @F.arrow_udf(LEAVES)
    def run(values: pa.Array) -> pa.Array:
        found, offsets = [], [0]
        for leaves in singles(path, kind, values, options, told):
            found.extend(leaves)
            offsets.append(len(found))
        arrow = arrow_type(LEAF)
        columns = [pa.array([leaf[k] for leaf in found], f.type) for k, f in enumerate(arrow)]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(arrow))).cast(arrow_type(LEAVES))

    return run


def decode_value(kind: T.DataType, told: dict | None = None, options: DecodeOptions = DecodeOptions(), nullable: bool = True, path: str = "value") -> Callable[[Column], Column]:
    """A function of a Column of leaves: the values under the reader's type."""

    @F.arrow_udf(kind)
    def run(leaves: pa.Array) -> pa.Array:
        flat = leaves.flatten().flatten()
        parts = list(zip(*[flat[k].to_pylist() for k in (0, 1, 2, 3, 5)], strict=True))
        ends = np.cumsum([0, *(n or 0 for n in leaves.value_lengths().to_pylist())]).tolist()
        rows = (Single(parts[a:b], options) for a, b in pairwise(ends))
        if nullable and isinstance(kind, T.StructType) and (told or {}).get("union") and all(isinstance(f.dataType, SCALARS) for f in kind.fields):
            return scalar_variants(path, kind, rows, told)
        arrow, found = arrow_type(kind), []
        for row in rows:
            one = row.single(path, kind, nullable, told)
            found.append(one if one.type == arrow and not pa.types.is_nested(arrow) else one.cast(arrow))
        return pa.concat_arrays(found) if found else pa.array([], arrow)

    return run


def value_size(leaves: Column) -> Column:
    """Bytes of a value from its leaves."""
    return F.aggregate(leaves, F.lit(0).cast("long"), lambda total, leaf: total + leaf["byte_size"])
