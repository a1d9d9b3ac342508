"""Annotated matrices in HDF5: .h5ad files read and written, 10x .h5 files read.

Frames are ranges of rows: the driver reads headers, every task opens the file and reads its own rows of the
asked columns, or the entries of its own rows of a sparse matrix. Nothing but names of categories is read whole.
Writing streams partitions through the driver into one file, as the format has one writer.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Mapping, Sequence
from itertools import islice
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.hdf5 import NOWHERE, SIGNATURE, File

#: Rows of metadata, and entries of a matrix, that one task reads at once.
ROWS, ENTRIES = 1 << 16, 1 << 21
TYPES = {"b": "boolean", "i": "long", "u": "long", "f": "double", "O": "string"}


def local(path: str) -> str:
    return path.removeprefix("file://")


# --- reading

def _column_kind(f: File, path: str) -> str:
    """How a column is stored: levels, masked, or plain."""
    if f.is_dataset(path):
        return "plain"
    return "levels" if "codes" in f.keys(path) else "masked"


def _old_levels(f: File, group: str, name: str) -> str | None:
    """Where older files keep a column's categories."""
    at = f"{group}/__categories/{name}"
    return at if f.is_dataset(at) else None


def _values(f: File, group: str, name: str, start: int, stop: int, levels: dict[str, np.ndarray]) -> pa.Array:
    path, old = f"{group}/{name}", _old_levels(f, group, name)
    kind = _column_kind(f, path)
    if kind == "levels" or old:
        at = old or f"{path}/categories"
        if at not in levels:
            levels[at] = f.read(at)
        codes, names = f.read(path if old else f"{path}/codes", start, stop).astype(np.int64), pa.array(levels[at])
        return names.take(pa.array(codes, mask=codes < 0))
    if kind == "masked":
        v = f.read(f"{path}/values", start, stop)
        return pa.array(v, mask=f.read(f"{path}/mask", start, stop).astype(bool))
    v = f.read(path, start, stop)
    return pa.array([None if x is None else str(x) for x in v.tolist()], pa.string()) if v.dtype == object else pa.array(v)


def _spark_type(f: File, group: str, name: str) -> str:
    path, old = f"{group}/{name}", _old_levels(f, group, name)
    kind = _column_kind(f, path)
    one = f.read(old or f"{path}/categories", 0, 1) if kind == "levels" or old else f.read(f"{path}/values" if kind == "masked" else path, 0, 1)
    return TYPES[one.dtype.kind]


def columns(path: str, group: str) -> list[str]:
    """Names of a frame's columns, the index first."""
    with File(local(path)) as f:
        attrs = f.attrs(group)
        index = attrs.get("_index", "_index")
        order = attrs.get("column-order")
        order = [order] if isinstance(order, str) else order
        rest = order if order is not None else [c for c in f.keys(group) if c not in (index, "__categories")]
        return [index, *rest]


def frame(spark: SparkSession, path: str, group: str, key: str, asked: Sequence[str] | None = None, wide: bool = True) -> DataFrame:
    """(key, index, asked columns) of obs or var; key is the row's place."""
    index, *rest = columns(path, group)
    rest = rest if asked is None else [c for c in rest if c in set(asked)]
    with File(local(path)) as f:
        n = f.shape(f"{group}/{index}")[0]
        kinds = [_spark_type(f, group, c) for c in (index, *rest)]
    place = "long" if wide else "int"
    schema = f"`{key}` {place}, " + ", ".join(f"`{c}` {k}" for c, k in zip((index, *rest), kinds, strict=True))
    to = {"boolean": pa.bool_(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with File(local(path)) as f:
            levels: dict[str, np.ndarray] = {}
            for b in batches:
                for at in b.column("id").to_pylist():
                    a, e = at * ROWS, min(n, (at + 1) * ROWS)
                    cols = [pa.array(np.arange(a, e), pa.int64() if wide else pa.int32())]
                    cols += [_values(f, group, c, a, e, levels).cast(to[k]) for c, k in zip((index, *rest), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(cols, [key, index, *rest])

    return _ranges(spark, -(-n // ROWS)).mapInArrow(run, schema)


def _ranges(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(0, n, 1, max(1, min(n, 100_000)))


def entries(spark: SparkSession, path: str, group: str, names: Sequence[str] = ("cell_idx", "gene_idx", "value"), rows_first: bool | None = None) -> DataFrame:
    """(row, column, value) of a sparse matrix, or of the non-zero places of a dense one. rows_first: whether
    the index pointer runs over rows; by default what the matrix says of itself."""
    row, col, value = names
    with File(local(path)) as f:
        dense = f.is_dataset(group)
        if dense:
            n, width = f.shape(group)
            step = max(1, ENTRIES // max(1, width))
            kind = TYPES[f.read(group, 0, 0).dtype.kind]
        else:
            kind = TYPES[f.read(f"{group}/data", 0, 0).dtype.kind]
            n, stored = f.shape(f"{group}/indptr")[0] - 1, f.shape(f"{group}/data")[0]
            step = max(1, min(ROWS, n * ENTRIES // max(1, stored)))
            if rows_first is None:
                rows_first = f.attrs(group).get("encoding-type", f.attrs(group).get("h5sparse_format", "csr")) in ("csr_matrix", "csr")
    small = pa.int64() if kind == "long" else pa.bool_() if kind == "boolean" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(major: np.ndarray, minor: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            r, c = (major, minor) if dense or rows_first else (minor, major)
            return pa.RecordBatch.from_arrays([pa.array(r.astype(np.int64)), pa.array(c.astype(np.int32)), pa.array(v).cast(small)], list(names))

        with File(local(path)) as f:
            for b in batches:
                for at in b.column("id").to_pylist():
                    a, e = at * step, min(n, (at + 1) * step)
                    if dense:
                        block = f.read(group, a, e)
                        r, c = np.nonzero(block)
                        yield out(r + a, c, block[r, c])
                        continue
                    to = f.read(f"{group}/indptr", a, e + 1).astype(np.int64)
                    for p in range(int(to[0]), int(to[-1]), ENTRIES):
                        q = min(int(to[-1]), p + ENTRIES)
                        major = np.searchsorted(to, np.arange(p, q), side="right") - 1 + a
                        yield out(major, f.read(f"{group}/indices", p, q), f.read(f"{group}/data", p, q))

    return _ranges(spark, -(-n // step)).mapInArrow(run, f"`{row}` long, `{col}` int, `{value}` {kind}")


def vectors(spark: SparkSession, path: str, group: str, key: str) -> DataFrame:
    """(key, v) of the rows of a dense matrix."""
    with File(local(path)) as f:
        n, width = f.shape(group)
    step = max(1, ENTRIES // max(1, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with File(local(path)) as f:
            for b in batches:
                for at in b.column("id").to_pylist():
                    block = f.read(group, at * step, (at + 1) * step).astype(float)
                    ends = pa.array(np.arange(len(block) + 1) * width, pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(block), dtype=np.int64) + at * step), pa.ListArray.from_arrays(ends, pa.array(block.ravel()))], [key, "v"])

    return _ranges(spark, -(-n // step)).mapInArrow(run, f"`{key}` long, v array<double>")


def plain(path: str, group: str = "uns") -> Any:
    """Nested values of a group as dicts, lists and numbers."""
    with File(local(path)) as f:
        def take(at: str) -> Any:
            if f.is_dataset(at):
                v = f.read(at)
                return v.tolist() if f.shape(at) else v.tolist()[0]
            return {k: take(f"{at}/{k}") for k in f.keys(at)}

        return take(group) if f.find(group) is not None else {}


def slots(path: str) -> dict[str, list[str]]:
    """What a file holds: names of each group at its top."""
    with File(local(path)) as f:
        return {k: [] if f.is_dataset(k) else f.keys(k) for k in f.keys()}


def listing(path: str) -> list[tuple[str, str, int]]:
    """(slot, columns, rows) of a file, from headers alone."""
    out = []
    for slot, held in slots(path).items():
        with File(local(path)) as f:
            if slot in ("obs", "var"):
                cols = columns(path, slot)
                out.append((slot, ", ".join(f"{c}: {_spark_type(f, slot, c)}" for c in cols), f.shape(f"{slot}/{cols[0]}")[0]))
            elif slot == "X":
                out.append((slot, "dense" if f.is_dataset("X") else str(f.attrs("X").get("encoding-type", "sparse")), f.shape("X" if f.is_dataset("X") else "X/indptr")[0] - (not f.is_dataset("X"))))
            elif slot in ("obsm", "varm", "obsp", "varp"):
                out += [(f"{slot}/{k}", "matrix", f.shape(f"{slot}/{k}" if f.is_dataset(f"{slot}/{k}") else f"{slot}/{k}/indptr")[0] - (not f.is_dataset(f"{slot}/{k}"))) for k in held]
            else:
                out.append((slot, ", ".join(held), len(held)))
    return out


# --- writing

LEAF, INNER = 64, 64  # half the most entries of a symbol node, and of a tree node


class Writer:
    """Writes an HDF5 file of groups, contiguous datasets and attributes in the oldest form, which all
    readers know."""

    def __init__(self, path: str):
        self.raw = open(path, "wb+")  # noqa: SIM115  closed by close()
        self.end = 96
        self.tree: dict[str, Any] = {}

    def put(self, data: bytes, place: int | None = None) -> int:
        """Writes bytes at a place, or behind all others at a multiple of eight; tells where."""
        if place is None:
            place = self.end
            self.end += -(-len(data) // 8) * 8
        self.raw.seek(place)
        self.raw.write(data)
        return place

    def room(self, n: int) -> int:
        """Space for n bytes that are written later."""
        place, self.end = self.end, self.end + -(-n // 8) * 8
        return place

    @staticmethod
    def kind(dtype: np.dtype | str) -> bytes:
        if dtype == "text":
            return struct.pack("<BBBBI", 0x19, 1, 1, 0, 16) + struct.pack("<BBBBI", 0x13, 0x10, 0, 0, 1)
        d = np.dtype(dtype)
        if d == bool:
            base = Writer.kind(np.dtype("i1"))
            return struct.pack("<BBBBI", 0x18, 2, 0, 0, 1) + base + b"FALSE\0\0\0TRUE\0\0\0\0" + b"\0\1"
        bits = d.itemsize * 8
        if d.kind in "iu":
            return struct.pack("<BBBBIHH", 0x10, 8 if d.kind == "i" else 0, 0, 0, d.itemsize, 0, bits)
        exp, mant, bias = {4: (8, 23, 127), 8: (11, 52, 1023)}[d.itemsize]
        return struct.pack("<BBBBIHHBBBBI", 0x11, 0x20, bits - 1, 0, d.itemsize, 0, bits, mant, exp, 0, mant, bias)

    @staticmethod
    def space(shape: tuple[int, ...]) -> bytes:
        return struct.pack("<BBBB4x", 1, len(shape), 0, 0) + struct.pack(f"<{len(shape)}Q", *shape)

    def texts(self, values: Sequence[str]) -> bytes:
        """References to strings, which go into heaps of the file."""
        out, at = [], 0
        while at < len(values):
            some = [v.encode() for v in values[at : at + 4096]]
            body = b"".join(struct.pack("<HH4xQ", i + 1, 0, len(s)) + s + bytes(-len(s) % 8) for i, s in enumerate(some) if s)
            size = max(4096, 16 + len(body) + 16)
            free = struct.pack("<HH4xQ", 0, 0, size - 16 - len(body))
            place = self.put((b"GCOL" + struct.pack("<B3xQ", 1, size) + body + free).ljust(size, b"\0"))
            out += [struct.pack("<IQI", len(s), place, i + 1) if s else bytes(16) for i, s in enumerate(some)]
            at += 4096
        return b"".join(out)

    def _header(self, messages: list[tuple[int, bytes]]) -> int:
        body = b"".join(struct.pack("<HHB3x", k, -(-len(m) // 8) * 8, 0) + m + bytes(-len(m) % 8) for k, m in messages)
        return self.put(struct.pack("<BBHII4x", 1, 0, len(messages), 1, len(body)) + body)

    def attribute(self, name: str, value: Any) -> tuple[int, bytes]:
        many = isinstance(value, (list, tuple, np.ndarray))
        items = list(value) if many else [value]
        shape = (len(items),) if many else ()
        if all(isinstance(v, str) for v in items):
            kind, raw = self.kind("text"), self.texts(items)
        else:
            a = np.array(items)
            kind, raw = self.kind(a.dtype), a.tobytes()
        title, space = name.encode() + b"\0", self.space(shape)
        wide = lambda b: b + bytes(-len(b) % 8)
        return 0x0C, struct.pack("<BBHHH", 1, 0, len(title), len(kind), len(space)) + wide(title) + wide(kind) + wide(space) + raw

    def dataset(self, path: str, shape: tuple[int, ...], kind: np.dtype | str, place: int, attrs: Mapping[str, Any]) -> None:
        """Notes a dataset whose bytes stand, or will stand, at a place."""
        size = (16 if kind == "text" else np.dtype(kind).itemsize) * int(np.prod(shape))
        messages = [(0x01, self.space(shape)), (0x03, self.kind(kind)), (0x05, bytes((2, 2, 1, 0))), (0x08, struct.pack("<BBQQ", 3, 1, place if size else NOWHERE, size))]
        self._into(path, self._header(messages + [self.attribute(k, v) for k, v in attrs.items()]))

    def array(self, path: str, values: Any, **attrs: Any) -> None:
        """A dataset of values that are at hand."""
        a = np.asarray(values)
        text = a.dtype.kind in "OUS"
        flat = a.ravel().tolist()
        place = self.put(self.texts([str(v) for v in flat]) if text else a.tobytes())
        encoding = {"encoding-type": ("string" if text else "numeric-scalar") if not a.shape else "string-array" if text else "array", "encoding-version": "0.2.0"}
        self.dataset(path, a.shape, "text" if text else a.dtype, place, encoding | attrs)

    def group(self, path: str, **attrs: Any) -> None:
        at = self.tree
        for p in path.strip("/").split("/"):
            at = at.setdefault(p, {"": {}}) if p else at
        at[""] = dict(attrs)

    def _into(self, path: str, place: int) -> None:
        *above, name = path.strip("/").split("/")
        at = self.tree
        for p in above:
            at = at.setdefault(p, {"": {}})
        at[name] = place

    def _group(self, held: dict[str, Any]) -> tuple[int, int, int]:
        """Header, tree and heap of a group."""
        names, places = sorted((k for k in held if k), key=str.encode), {}
        for k in names:
            places[k] = held[k] if isinstance(held[k], int) else self._group(held[k])[0]
        text, at = bytearray(8), {}
        for k in names:
            at[k] = len(text)
            raw = k.encode() + b"\0"
            text += raw + bytes(-len(raw) % 8)
        text += struct.pack("<QQ", 1, 16)  # a free block ends the heap
        names_at = self.put(bytes(text))
        heap = self.put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(text), len(text) - 16, names_at))
        nodes = []
        for i in range(0, max(1, len(names)), 2 * LEAF):
            some = names[i : i + 2 * LEAF]
            body = b"".join(struct.pack("<QQI4x16x", at[k], places[k], 0) for k in some)
            nodes.append((self.put((b"SNOD" + struct.pack("<BBH", 1, 0, len(some)) + body).ljust(8 + 2 * LEAF * 40, b"\0")), at[some[-1]] if some else 0))
        if len(nodes) > 2 * INNER:
            raise ValueError("too many names in one group")
        body = struct.pack("<Q", 0) + b"".join(struct.pack("<QQ", place, last) for place, last in nodes)
        tree = self.put((b"TREE" + struct.pack("<BBHQQ", 0, 0, len(nodes) if names else 0, NOWHERE, NOWHERE) + body).ljust(24 + 8 * (4 * INNER + 1), b"\0"))
        header = self._header([(0x11, struct.pack("<QQ", tree, heap)), *(self.attribute(k, v) for k, v in held.get("", {}).items())])
        return header, tree, heap

    def close(self) -> None:
        header, tree, heap = self._group(self.tree)
        entry = struct.pack("<QQI4xQQ", 0, header, 1, tree, heap)
        self.put(SIGNATURE + struct.pack("<8B", 0, 0, 0, 0, 0, 8, 8, 0) + struct.pack("<HHI", LEAF, INNER, 0) + struct.pack("<QQQQ", 0, NOWHERE, self.end, NOWHERE) + entry, 0)
        self.raw.truncate(self.end)
        self.raw.close()


def write_frame(w: Writer, group: str, df: DataFrame, key: str) -> int:
    """Writes a frame by its rows' order of key, without the key; tells its length. Columns go to the file
    partition by partition."""
    names = [c for c in df.columns if c != key]
    n = df.count()
    kinds, masks = {}, {}
    for c in names:
        t = df.schema[c].dataType.simpleString()
        kinds[c] = "text" if t == "string" else np.dtype(bool) if t == "boolean" else np.dtype("f8") if t in ("double", "float") or t.startswith("decimal") else np.dtype("i8")
        if df.schema[c].nullable and kinds[c] != "text" and kinds[c].kind != "f":
            masks[c] = w.room(n)
    size = lambda c: 16 if kinds[c] == "text" else kinds[c].itemsize
    place = {c: w.room(n * size(c)) for c in names}
    at, some_null = 0, set()
    cast = lambda c: "string" if kinds[c] == "text" else {"f": "double", "b": "boolean"}.get(kinds[c].kind, "long")
    rows = df.orderBy(key).select(*(F.col(f"`{c}`").cast(cast(c)).alias(c) for c in names)).toLocalIterator()
    while some := list(islice(rows, 4096)):
        for i, c in enumerate(names):
            v = [r[i] for r in some]
            if kinds[c] == "text":
                w.put(w.texts(["" if x is None else x for x in v]), place[c] + 16 * at)
                continue
            empty = 0 if c in masks else np.nan
            w.put(np.array([empty if x is None else x for x in v], kinds[c]).tobytes(), place[c] + size(c) * at)
            if c in masks:
                w.put(bytes(x is None for x in v), masks[c] + at)
                if None in v:
                    some_null.add(c)
        at += len(some)
    for c in names:
        if c in some_null:
            w.group(f"{group}/{c}", **{"encoding-type": "nullable-boolean" if kinds[c].kind == "b" else "nullable-integer", "encoding-version": "0.1.0"})
            w.dataset(f"{group}/{c}/values", (n,), kinds[c], place[c], {"encoding-type": "array", "encoding-version": "0.2.0"})
            w.dataset(f"{group}/{c}/mask", (n,), bool, masks[c], {"encoding-type": "array", "encoding-version": "0.2.0"})
        else:
            w.dataset(f"{group}/{c}", (n,), kinds[c], place[c], {"encoding-type": "string-array" if kinds[c] == "text" else "array", "encoding-version": "0.2.0"})
    w.group(group, **{"encoding-type": "dataframe", "encoding-version": "0.2.0", "_index": names[0], "column-order": names[1:]})
    return n


def write_sparse(w: Writer, group: str, x: DataFrame, shape: tuple[int, int], whole: bool) -> None:
    """Writes (row, column, value) as a CSR matrix, row after row. whole: values are integers."""
    row, col, value = x.columns
    stored, kind = x.count(), np.dtype("i8" if whole else "f8")
    data, indices, indptr = w.room(8 * stored), w.room(4 * stored), w.room(8 * (shape[0] + 1))
    rows, at, last = x.orderBy(row, col).toLocalIterator(prefetchPartitions=True), 0, -1
    while some := list(islice(rows, 1 << 16)):
        r, c, v = (np.array(z) for z in zip(*some, strict=True))
        w.put(v.astype(kind).tobytes(), data + 8 * at)
        w.put(c.astype("<i4").tobytes(), indices + 4 * at)
        # Pointers of the rows that begin here, empty ones before them included.
        new = np.arange(last + 1, int(r[-1]) + 1)
        w.put((np.searchsorted(r, new) + at).astype("<i8").tobytes(), indptr + 8 * (last + 1))
        at, last = at + len(some), int(r[-1])
    w.put(np.full(shape[0] - last, stored, "<i8").tobytes(), indptr + 8 * (last + 1))
    plain_array = {"encoding-type": "array", "encoding-version": "0.2.0"}
    w.group(group, **{"encoding-type": "csr_matrix", "encoding-version": "0.1.0", "shape": list(shape)})
    w.dataset(f"{group}/data", (stored,), kind, data, plain_array)
    w.dataset(f"{group}/indices", (stored,), "<i4", indices, plain_array)
    w.dataset(f"{group}/indptr", (shape[0] + 1,), "<i8", indptr, plain_array)


def write_vectors(w: Writer, path: str, df: DataFrame, key: str, n: int) -> None:
    """Writes (key, v) as a dense matrix of n rows; rows that are not there are NaN."""
    first = df.select("v").first()
    width = len(first[0]) if first else 0
    place, at = w.room(8 * n * width), 0
    empty = np.full(width, np.nan)
    rows = df.select(key, "v").orderBy(key).toLocalIterator()
    while some := list(islice(rows, 4096)):
        for k, v in some:
            while at < k:
                w.put(empty.tobytes(), place + 8 * width * at)
                at += 1
            w.put(np.array(v, float).tobytes(), place + 8 * width * k)
            at = k + 1
    while at < n:
        w.put(empty.tobytes(), place + 8 * width * at)
        at += 1
    w.dataset(path, (n, width), "<f8", place, {"encoding-type": "array", "encoding-version": "0.2.0"})


def write_plain(w: Writer, path: str, value: Any) -> None:
    """Writes nested dicts of lists and plain values; nulls and empty lists have no form and are left out."""
    if isinstance(value, dict):
        w.group(path, **{"encoding-type": "dict", "encoding-version": "0.1.0"})
        for k, v in value.items():
            write_plain(w, f"{path}/{k.replace('/', '-')}", v)
    elif value is not None and value != []:
        w.array(path, value)
