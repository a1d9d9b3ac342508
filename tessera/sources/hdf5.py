"""HDF5 files by plain reads, without the HDF5 library: enough of the format for .h5ad and 10x .h5 files.

A file is opened where it is read: the driver looks at headers only, tasks read their own range of rows with
the columns and chunks that it needs. The path has to be one that all tasks can open.

Read: superblocks 0 to 3; groups as symbol tables or as link messages in their header; contiguous, compact and
chunked datasets (version 1 B-trees, single chunks); deflate, shuffle and checksum filters; numbers,
enumerations, and strings of fixed or variable length; attributes in headers. Groups with very many links
in the newest format (fractal heaps), other chunk indexes and other filters are refused by name.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np

SIGNATURE = b"\x89HDF\r\n\x1a\n"
NOWHERE = (1 << 64) - 1


class Unsupported(ValueError):
    """A part of the format that this reader does not know."""


@dataclass
class Kind:
    """A datatype: numpy's, and whether its bytes are references to strings of variable length."""

    dtype: np.dtype
    text: bool = False
    variable: bool = False
    levels: list[str] | None = None


@dataclass
class Header:
    """What an object's messages say."""

    shape: tuple[int, ...] | None = None
    kind: Kind | None = None
    layout: tuple[Any, ...] | None = None
    filters: list[tuple[int, tuple[int, ...]]] = field(default_factory=list)
    table: tuple[int, int] | None = None
    links: dict[str, int] = field(default_factory=dict)
    attrs: dict[str, Any] = field(default_factory=dict)


class File:
    """An HDF5 file open for reading."""

    def __init__(self, path: str):
        self.raw = open(path, "rb")  # noqa: SIM115  closed by close()
        self.headers: dict[int, Header] = {}
        self.heaps: dict[int, dict[int, bytes]] = {}
        self.root = self._superblock()

    def __enter__(self) -> File:
        return self

    def __exit__(self, *_: object) -> None:
        self.raw.close()

    def at(self, place: int, n: int) -> bytes:
        self.raw.seek(place)
        out = self.raw.read(n)
        if len(out) < n:
            raise ValueError("the file ends too early")
        return out

    def _superblock(self) -> int:
        place, end = 0, self.raw.seek(0, 2)
        while True:  # a user block of 512 bytes or a multiple by two may stand in front
            if place + 8 > end:
                raise ValueError("not an HDF5 file")
            if self.at(place, 8) == SIGNATURE:
                break
            place = 512 if not place else 2 * place
        version = self.at(place + 8, 1)[0]
        sizes = self.at(place + (13 if version < 2 else 9), 2)
        if sizes != b"\x08\x08":
            raise Unsupported("offsets of other than eight bytes")
        if version < 2:
            base = place + (24 if version == 0 else 28)
            return struct.unpack("<Q", self.at(base + 40, 8))[0]
        return struct.unpack("<Q", self.at(place + 36, 8))[0]

    # --- headers

    def header(self, place: int) -> Header:
        if place not in self.headers:
            out = self.headers[place] = Header()
            for kind, body in self._messages(place):
                self._take(out, kind, body)
        return self.headers[place]

    def _messages(self, place: int) -> Iterator[tuple[int, bytes]]:
        start = self.at(place, 16)
        if start[:4] == b"OHDR":
            flags = start[5]
            at = place + 6 + (16 if flags & 32 else 0) + (4 if flags & 16 else 0)
            width = 1 << (flags & 3)
            size = int.from_bytes(self.at(at, width), "little")
            todo, lead = [(at + width, size)], 6 if flags & 4 else 4
            while todo:
                at, size = todo.pop(0)
                block, i = self.at(at, size), 0
                while i + lead <= len(block):
                    kind, n = block[i], struct.unpack("<H", block[i + 1 : i + 3])[0]
                    body = block[i + lead : i + lead + n]
                    i += lead + n
                    if kind == 0x10:
                        to, length = struct.unpack("<QQ", body[:16])
                        todo.append((to + 4, length - 8))  # between its signature and checksum
                    else:
                        yield kind, body
            return
        if start[0] != 1:
            raise Unsupported(f"object headers of version {start[0]}")
        todo = [(place + 16, struct.unpack("<I", start[8:12])[0])]
        while todo:
            at, size = todo.pop(0)
            block, i = self.at(at, size), 0
            while i + 8 <= len(block):
                kind, n = struct.unpack("<HH", block[i : i + 4])
                body = block[i + 8 : i + 8 + n]
                i += 8 + n
                if kind == 0x10:
                    todo.append(struct.unpack("<QQ", body[:16]))
                else:
                    yield kind, body

    def _take(self, out: Header, kind: int, body: bytes) -> None:
        if kind == 0x01:
            out.shape = self._shape(body)
        elif kind == 0x03:
            out.kind = self._kind(body)[0]
        elif kind == 0x06:
            name, to = self._link(body)
            if to is not None:
                out.links[name] = to
        elif kind == 0x02 and struct.unpack("<Q", body[2 + (8 if body[1] & 1 else 0) :][:8])[0] != NOWHERE:
            raise Unsupported("groups with their links in a fractal heap")
        elif kind == 0x08:
            out.layout = self._layout(body)
        elif kind == 0x0B:
            out.filters = self._filters(body)
        elif kind == 0x0C:
            name, value = self._attribute(body)
            out.attrs[name] = value
        elif kind == 0x11:
            out.table = struct.unpack("<QQ", body[:16])

    @staticmethod
    def _shape(body: bytes) -> tuple[int, ...]:
        version, rank = body[0], body[1]
        at = 8 if version == 1 else 4
        return struct.unpack(f"<{rank}Q", body[at : at + 8 * rank])

    def _kind(self, body: bytes) -> tuple[Kind, int]:
        """A datatype, and the bytes its message takes."""
        version, what = body[0] >> 4, body[0] & 15
        bits, size = int.from_bytes(body[1:4], "little"), struct.unpack("<I", body[4:8])[0]
        order = ">" if bits & 1 else "<"
        if what == 0:
            return Kind(np.dtype(f"{order}{'i' if bits & 8 else 'u'}{size}")), 12
        if what == 1:
            return Kind(np.dtype(f"{order}f{size}")), 20
        if what == 3:
            return Kind(np.dtype(f"S{size}"), text=True), 8
        if what == 8:
            base, used = self._kind(body[8:])
            n, at, names = bits & 0xFFFF, 8 + used, []
            for _ in range(n):
                end = body.index(b"\0", at)
                names.append(body[at:end].decode())
                at = end + 1 if version >= 3 else at + (end - at) // 8 * 8 + 8
            values = np.frombuffer(body[at : at + n * base.dtype.itemsize], base.dtype)
            levels = None
            if n and values.min() >= 0 and values.max() < 1 << 16:
                levels = [""] * (int(values.max()) + 1)
                for v, name in zip(values.tolist(), names, strict=True):
                    levels[v] = name
            return Kind(base.dtype, levels=levels), at + n * base.dtype.itemsize
        if what == 9:
            base, used = self._kind(body[8:])
            if bits & 15 != 1 and base.dtype != np.dtype("S1"):
                raise Unsupported("sequences of variable length")
            return Kind(np.dtype("V16"), text=True, variable=True), 8 + used
        raise Unsupported(f"datatypes of class {what}")

    @staticmethod
    def _link(body: bytes) -> tuple[str, int | None]:
        flags, at, soft = body[1], 2, 0
        if flags & 8:
            soft, at = body[at], at + 1
        at += (8 if flags & 4 else 0) + (1 if flags & 16 else 0)
        width = 1 << (flags & 3)
        n = int.from_bytes(body[at : at + width], "little")
        at += width
        return body[at : at + n].decode(), None if soft else struct.unpack("<Q", body[at + n : at + n + 8])[0]

    @staticmethod
    def _layout(body: bytes) -> tuple[Any, ...]:
        version, what = body[0], body[1]
        if version < 3:
            rank, what, at = body[1], body[2], 8
            to = NOWHERE
            if what:
                to, at = struct.unpack("<Q", body[at : at + 8])[0], at + 8
            dims = struct.unpack(f"<{rank}I", body[at : at + 4 * rank])
            at += 4 * rank
            if what == 2:
                return "chunks", to, dims  # the last of dims is the element's size
            if what == 1:
                return "plain", to
            n = struct.unpack("<I", body[at : at + 4])[0]
            return "inside", body[at + 4 : at + 4 + n]
        if what == 0:
            n = struct.unpack("<H", body[2:4])[0]
            return "inside", body[4 : 4 + n]
        if what == 1:
            return "plain", struct.unpack("<Q", body[2:10])[0]
        if what == 2 and version == 3:
            rank = body[2]
            return "chunks", struct.unpack("<Q", body[3:11])[0], struct.unpack(f"<{rank}I", body[11 : 11 + 4 * rank])
        if what == 2 and version == 4:
            flags, rank, width = body[2], body[3], body[4]
            at = 5 + rank * width
            dims = tuple(int.from_bytes(body[5 + i * width : 5 + (i + 1) * width], "little") for i in range(rank))
            index = body[at]
            if index == 1:
                at += 1
                size = None
                if flags & 2:
                    size, at = struct.unpack("<Q", body[at : at + 8])[0], at + 12
                return "one chunk", struct.unpack("<Q", body[at : at + 8])[0], dims, size
            raise Unsupported("chunk indexes of the newest format")
        raise Unsupported("this storage layout")

    @staticmethod
    def _filters(body: bytes) -> list[tuple[int, tuple[int, ...]]]:
        version, n = body[0], body[1]
        at, out = 8 if version == 1 else 2, []
        for _ in range(n):
            what = struct.unpack("<H", body[at : at + 2])[0]
            name = 0
            if version == 1 or what >= 256:
                name, at = struct.unpack("<H", body[at + 2 : at + 4])[0], at + 2
            values = struct.unpack("<H", body[at + 4 : at + 6])[0]
            at += 6 + (name if version == 2 else -(-name // 8) * 8)
            out.append((what, struct.unpack(f"<{values}I", body[at : at + 4 * values])))
            at += 4 * values + (4 if version == 1 and values % 2 else 0)
        return out

    def _attribute(self, body: bytes) -> tuple[str, Any]:
        version = body[0]
        n_name, n_kind, n_shape = struct.unpack("<HHH", body[2:8])
        at = 9 if version == 3 else 8
        wide = (lambda n: -(-n // 8) * 8) if version == 1 else (lambda n: n)
        name = body[at : at + n_name].split(b"\0")[0].decode()
        at += wide(n_name)
        try:
            kind = self._kind(body[at : at + n_kind])[0]
        except Unsupported:
            return name, None
        at += wide(n_kind)
        shape = self._shape(body[at : at + n_shape])
        raw = body[at + wide(n_shape) :]
        n = int(np.prod(shape)) if shape else 1
        if kind.dtype.itemsize * n > len(raw):
            return name, None
        values = self._values(kind, np.frombuffer(raw[: kind.dtype.itemsize * n], kind.dtype))
        return name, values.reshape(shape).tolist() if shape else values.tolist()[0]

    # --- values

    def _values(self, kind: Kind, raw: np.ndarray) -> np.ndarray:
        if kind.variable:
            out = np.empty(len(raw), object)
            for i, r in enumerate(raw.tolist()):
                n, heap, index = struct.unpack("<IQI", bytes(r))
                out[i] = self._heap(heap)[index][:n].split(b"\0")[0].decode() if n and heap not in (0, NOWHERE) else ""
            return out
        if kind.text:
            return np.array([x.split(b"\0")[0].decode() for x in raw.tolist()] + [None], object)[:-1]
        if kind.levels is not None and set(kind.levels) <= {"FALSE", "TRUE"}:
            return raw.astype(bool)
        return raw.astype(raw.dtype.newbyteorder("="))

    def _heap(self, place: int) -> dict[int, bytes]:
        if place not in self.heaps:
            if len(self.heaps) > 256:
                self.heaps.clear()
            start = self.at(place, 16)
            if start[:4] != b"GCOL":
                raise ValueError("a string's heap is not where it should be")
            block, at, out = self.at(place, struct.unpack("<Q", start[8:16])[0]), 16, {}
            while at + 16 <= len(block):
                index, _, n = struct.unpack("<HHxxxxQ", block[at : at + 16])
                if not index:
                    break
                out[index] = block[at + 16 : at + 16 + n]
                at += 16 + -(-n // 8) * 8
            self.heaps[place] = out
        return self.heaps[place]

    # --- groups and datasets

    def children(self, place: int) -> dict[str, int]:
        """Names and places of what a group holds."""
        h = self.header(place)
        if h.table is None:
            return h.links
        tree, heap = h.table
        start = self.at(heap, 32)
        size, _, names_at = struct.unpack("<QQQ", start[8:32])
        names, out = self.at(names_at, size), {}
        todo = [tree]
        while todo:
            at = todo.pop()
            sign = self.at(at, 8)
            if sign[:4] == b"TREE":
                n = struct.unpack("<H", sign[6:8])[0]
                body = self.at(at + 24, 16 * n + 8)
                todo += [struct.unpack("<Q", body[16 * i + 8 : 16 * i + 16])[0] for i in range(n)]
            else:
                n = struct.unpack("<H", sign[6:8])[0]
                body = self.at(at + 8, 40 * n)
                for i in range(n):
                    name, to = struct.unpack("<QQ", body[40 * i : 40 * i + 16])
                    out[names[name : names.index(b"\0", name)].decode()] = to
        return out

    def find(self, path: str) -> int | None:
        """The place of an object, None where there is none."""
        place = self.root
        for part in path.strip("/").split("/"):
            if part:
                place = self.children(place).get(part)  # type: ignore[assignment]
                if place is None:
                    return None
        return place

    def keys(self, path: str = "/") -> list[str]:
        place = self.find(path)
        return [] if place is None else sorted(self.children(place))

    def attrs(self, path: str) -> dict[str, Any]:
        place = self.find(path)
        return {} if place is None else self.header(place).attrs

    def is_dataset(self, path: str) -> bool:
        place = self.find(path)
        return place is not None and self.header(place).layout is not None

    def shape(self, path: str) -> tuple[int, ...]:
        return self._dataset(path).shape or ()

    def _dataset(self, path: str) -> Header:
        place = self.find(path)
        if place is None or self.header(place).layout is None:
            raise KeyError(f"no dataset {path!r}")
        return self.header(place)

    def read(self, path: str, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Rows start to stop of a dataset; only the chunks that hold them are read."""
        h = self._dataset(path)
        assert h.kind and h.layout
        shape = h.shape or ()
        if not shape:
            return self._values(h.kind, self._flat(h, 0, 1))
        stop = shape[0] if stop is None else min(stop, shape[0])
        rest = shape[1:]
        each = int(np.prod(rest)) if rest else 1
        if stop <= start or not each:
            return self._values(h.kind, np.empty(0, h.kind.dtype)).reshape((max(0, stop - start), *rest))
        if h.layout[0] in ("plain", "inside"):
            return self._values(h.kind, self._flat(h, start * each, (stop - start) * each)).reshape((stop - start, *rest))
        out = np.zeros((stop - start, *rest), h.kind.dtype)
        for at, chunk in self._chunks(h, start, stop):
            own = tuple(slice(max(a, lo), min(a + n, hi)) for a, n, lo, hi in zip(at, chunk.shape, (start, *(0,) * len(rest)), (stop, *rest), strict=True))
            to = (slice(own[0].start - start, own[0].stop - start), *own[1:])
            out[to] = chunk[tuple(slice(s.start - a, s.stop - a) for s, a in zip(own, at, strict=True))]
        return self._values(h.kind, out.ravel()).reshape(out.shape)

    def _flat(self, h: Header, first: int, n: int) -> np.ndarray:
        size = h.kind.dtype.itemsize  # type: ignore[union-attr]
        if h.layout[0] == "inside":  # type: ignore[index]
            raw = h.layout[1][first * size : (first + n) * size]  # type: ignore[index]
        elif h.layout[1] == NOWHERE:  # type: ignore[index]
            raw = bytes(n * size)  # never written
        else:
            raw = self.at(h.layout[1] + first * size, n * size)  # type: ignore[index]
        return np.frombuffer(raw, h.kind.dtype)  # type: ignore[union-attr]

    def _chunks(self, h: Header, start: int, stop: int) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
        """(first place, values) of the chunks that hold some of the rows."""
        how, place, dims = h.layout[:3]  # type: ignore[index]
        shape, kind = dims[:-1], h.kind
        whole = int(np.prod(dims))
        if place == NOWHERE:
            return
        if how == "one chunk":
            yield (0,) * len(shape), np.frombuffer(self._unpacked(self.at(place, h.layout[3] or whole), h.filters, 0, dims[-1]), kind.dtype).reshape(shape)  # type: ignore[index, union-attr]
            return
        rank = len(shape)
        width = 8 + 8 * (rank + 1)  # of a key: size, filters left out, first place with the element's byte
        todo = [place]
        while todo:
            at = todo.pop()
            sign = self.at(at, 24)
            if sign[:4] != b"TREE" or sign[4] != 1:
                raise ValueError("a chunk index is not where it should be")
            level, n = sign[5], struct.unpack("<H", sign[6:8])[0]
            body = self.at(at + 24, n * (width + 8) + width)
            firsts = [struct.unpack(f"<{rank}Q", body[i * (width + 8) + 8 :][: 8 * rank]) for i in range(n + 1)]
            for i in range(n):
                to = struct.unpack("<Q", body[i * (width + 8) + width :][:8])[0]
                if level:
                    # Keys ascend by the first place; the next key's row bounds what is below this one.
                    if firsts[i][0] < stop and firsts[i + 1][0] + shape[0] > start:
                        todo.append(to)
                elif firsts[i][0] < stop and firsts[i][0] + shape[0] > start:
                    size, left_out = struct.unpack("<II", body[i * (width + 8) :][:8])
                    raw = self._unpacked(self.at(to, size), h.filters, left_out, dims[-1])
                    yield firsts[i], np.frombuffer(raw[:whole], kind.dtype).reshape(shape)  # type: ignore[union-attr]

    @staticmethod
    def _unpacked(raw: bytes, filters: list[tuple[int, tuple[int, ...]]], left_out: int, size: int) -> bytes:
        for i in range(len(filters) - 1, -1, -1):
            what = filters[i][0]
            if left_out >> i & 1:
                continue
            if what == 1:
                raw = zlib.decompress(raw)
            elif what == 2:
                n = len(raw) // size
                raw = np.frombuffer(raw[: n * size], np.uint8).reshape(size, n).T.tobytes() + raw[n * size :]
            elif what == 3:
                raw = raw[:-4]
            else:
                raise Unsupported(f"filter {what}")
        return raw
