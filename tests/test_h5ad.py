"""HDF5 files: round trips, and parts of the format that other writers use, made byte by byte."""

import struct
import zlib

import numpy as np
import pytest

from tessera import SingleCell
from tessera.sources import h5ad
from tessera.sources.hdf5 import File, Unsupported


def chunked(w, path, a, chunk, deflate=True, shuffle=True, fan=3):
    """A chunked dataset with a version 1 B-tree of two levels."""
    size, rank = a.dtype.itemsize, a.ndim
    starts = [()]
    for n, c in zip(a.shape, chunk, strict=True):
        starts = [(*s, x) for s in starts for x in range(0, n, c)]
    entries = []
    for s in starts:
        block = np.zeros(chunk, a.dtype)
        part = a[tuple(slice(x, x + c) for x, c in zip(s, chunk, strict=True))]
        block[tuple(slice(0, n) for n in part.shape)] = part
        raw = block.tobytes()
        if shuffle:
            raw = np.frombuffer(raw, np.uint8).reshape(-1, size).T.tobytes()
        if deflate:
            raw = zlib.compress(raw)
        entries.append((struct.pack(f"<II{rank + 1}Q", len(raw), 0, *s, 0), w.put(raw)))
    last = struct.pack(f"<II{rank + 1}Q", 0, 0, *(-(-n // c) * c for n, c in zip(a.shape, chunk, strict=True)), 0)

    def node(level, some, end):
        return w.put(b"TREE" + struct.pack("<BBHQQ", 1, level, len(some), 2**64 - 1, 2**64 - 1) + b"".join(k + struct.pack("<Q", p) for k, p in some) + end)

    leaves = [(entries[i][0], node(0, entries[i : i + fan], (entries[i + fan :] or [(last, 0)])[0][0])) for i in range(0, len(entries), fan)]
    root = node(1, leaves, last)
    filters = ([(2, (size,))] if shuffle else []) + ([(1, (4,))] if deflate else [])
    body = struct.pack("<BB6x", 1, len(filters)) + b"".join(struct.pack("<HHHH", k, 0, 1, len(v)) + struct.pack("<I4x", *v) for k, v in filters)
    messages = [(0x01, w.space(a.shape)), (0x03, w.kind(a.dtype)), (0x08, struct.pack("<BBBQ", 3, 2, rank + 1, root) + struct.pack(f"<{rank + 1}I", *chunk, size)), *([(0x0B, body)] if filters else [])]
    w._into(path, w._header(messages))


@pytest.fixture
def small(spark):
    obs = spark.createDataFrame([(0, "c0", "a", 1, 0.5, True), (3, "c1", None, None, None, None), (4, "cé2", "b", 3, 2.5, False)], "cell_idx long, cell string, type string, n long, x double, ok boolean")
    var = spark.createDataFrame([(i, f"g{i}") for i in range(4)], "gene_idx int, gene string")
    x = spark.createDataFrame([(0, 1, 5), (0, 3, 2), (4, 0, 7)], "cell_idx long, gene_idx int, value long")
    pca = spark.createDataFrame([(0, [1.0, 2.0]), (3, [0.0, -1.0]), (4, [3.0, 4.0])], "cell_idx long, v array<double>")
    snn = spark.createDataFrame([(0, 4, 0.25), (4, 0, 0.25)], "src long, dst long, weight double")
    return SingleCell(x, obs, var, obsm={"pca": pca}, obsp={"snn": snn}, uns={"a": {"b": [1, 2], "c": "text"}, "d": 1.5})


def test_round_trip(spark, small, tmp_path):
    path = str(tmp_path / "x.h5ad")
    small.save(path)
    with pytest.raises(FileExistsError):
        small.save(path)
    s = SingleCell.load(spark, path)
    assert sorted(map(tuple, s.X.collect())) == [(0, 1, 5), (0, 3, 2), (2, 0, 7)]
    assert [tuple(r) for r in s.obs.orderBy("cell_idx").collect()] == [(0, "c0", "a", 1, 0.5, True), (1, "c1", "", None, pytest.approx(float("nan"), nan_ok=True), None), (2, "cé2", "b", 3, 2.5, False)]
    assert [tuple(r) for r in s.var.orderBy("gene_idx").collect()] == [(i, f"g{i}") for i in range(4)]
    assert [r["v"] for r in s.obsm["pca"].orderBy("cell_idx").collect()] == [[1.0, 2.0], [0.0, -1.0], [3.0, 4.0]]
    assert sorted(map(tuple, s.obsp["snn"].collect())) == [(0, 2, 0.25), (2, 0, 0.25)]
    assert s.uns == {"a": {"b": [1, 2], "c": "text"}, "d": 1.5}
    some = SingleCell.load(spark, path, X=False, obs_columns=["n"])
    assert some.X is None and some.obs.columns == ["cell_idx", "cell", "n"] and SingleCell.read_obs(spark, path).count() == 3
    assert {r["slot"]: r["rows"] for r in SingleCell.ls(spark, path).collect()} | {"uns": 0} == {"X": 3, "obs": 3, "var": 4, "obsm/pca": 3, "obsp/snn": 3, "uns": 0}
    assert SingleCell.read_slot(spark, path, "obsm", "pca").count() == 3 and SingleCell.read_uns(spark, path)["d"] == 1.5


def test_empty(spark, tmp_path):
    path = str(tmp_path / "none.h5ad")
    none = lambda schema: spark.createDataFrame([], schema)
    SingleCell(none("cell_idx long, gene_idx int, value double"), none("cell_idx long, cell string"), none("gene_idx int, gene string")).save(path)
    s = SingleCell.load(spark, path)
    assert s.X.count() == s.obs.count() == s.var.count() == 0


def test_chunks_and_filters(tmp_path):
    path = str(tmp_path / "c.h5")
    rng = np.random.default_rng(0)
    flat, square = rng.integers(0, 99, 1000).astype("<i4"), rng.normal(size=(37, 11)).astype("<f4")
    w = h5ad.Writer(path)
    for name, deflate, shuffle in (("both", True, True), ("none", False, False), ("deflate", True, False)):
        chunked(w, f"g/{name}", flat, (64,), deflate, shuffle)
        chunked(w, f"g/{name}2", square, (8, 4), deflate, shuffle)
    w.array("words", ["a", "", "long " * 2000, "é"])
    w.array("one", 3)
    for i in range(300):  # several symbol nodes
        w.array(f"many/k{i}", [i])
    w.close()
    with File(path) as f:
        for name in ("both", "none", "deflate"):
            for a, e in ((0, None), (0, 1), (63, 65), (640, 1000), (999, 1000), (5, 5)):
                assert np.array_equal(f.read(f"g/{name}", a, e), flat[a:e])
            for a, e in ((0, None), (7, 9), (36, 37)):
                assert np.array_equal(f.read(f"g/{name}2", a, e), square[a:e])
        assert f.read("words").tolist() == ["a", "", "long " * 2000, "é"] and f.read("one").tolist() == [3]
        assert len(f.keys("many")) == 300 and f.read("many/k299").tolist() == [299] and f.find("many/none") is None


def test_newer_headers(tmp_path):
    """A file of superblock 2 with version 2 headers, link messages and fixed strings."""
    path = tmp_path / "n.h5"
    body = bytearray(48)
    values = np.array([b"one", b"three"], "S6").tobytes()
    at_values = len(body)
    body += values + bytes(4)

    def header(messages):
        inner = b"".join(bytes([k]) + struct.pack("<HB", len(m), 0) + m for k, m in messages)
        place = len(body)
        body.extend(b"OHDR" + bytes([2, 1]) + struct.pack("<H", len(inner)) + inner + bytes(4))
        return place

    data = header([(0x01, bytes([2, 1, 0, 1]) + struct.pack("<Q", 2)), (0x03, struct.pack("<BBBBI", 0x13, 0, 0, 0, 6)), (0x08, struct.pack("<BBQQ", 3, 1, at_values, 12))])
    link = bytes([1, 0, 4]) + b"text" + struct.pack("<Q", data)
    root = header([(0x02, bytes([0, 0]) + struct.pack("<QQ", 2**64 - 1, 2**64 - 1)), (0x06, link)])
    body[:48] = b"\x89HDF\r\n\x1a\n" + bytes([2, 8, 8, 0]) + struct.pack("<QQQQ", 0, 2**64 - 1, len(body), root) + bytes(4)
    path.write_bytes(bytes(body))
    with File(str(path)) as f:
        assert f.keys() == ["text"] and f.read("text").tolist() == ["one", "three"]
    path.write_bytes(b"no such file at all" * 100)
    with pytest.raises(ValueError):
        File(str(path))
    assert issubclass(Unsupported, ValueError)


def test_categories_dense_counts_and_compressed_columns(spark, tmp_path):
    path = str(tmp_path / "k.h5ad")
    w = h5ad.Writer(path)
    dense = np.array([[0, 2], [3, 0], [0, 0]], "<f4")
    chunked(w, "X", dense, (2, 2))
    w.array("obs/_index", ["a", "b", "c"])
    w.array("obs/kind/categories", ["x", "y"])
    w.array("obs/kind/codes", np.array([1, -1, 0], "i1"))
    w.group("obs/kind", **{"encoding-type": "categorical", "ordered": False})
    w.array("obs/old", np.array([0, 0, 1], "i1"))
    w.array("obs/__categories/old", ["p", "q"])
    w.group("obs", **{"_index": "_index", "column-order": ["kind", "old"]})
    w.array("var/_index", ["g", "h"])
    w.group("var", **{"_index": "_index", "column-order": []})
    for name, values in (("data", np.array([5, 6, 7], "<f4")), ("indices", np.array([2, 0, 1], "<i4")), ("indptr", np.array([0, 1, 3], "<i8"))):
        w.array(f"layers/counts/{name}", values)
    w.group("layers/counts", **{"encoding-type": "csc_matrix", "shape": [3, 2]})
    w.close()
    s = SingleCell.from_h5ad(spark, path)
    assert sorted(map(tuple, s.X.collect())) == [(0, 1, 2.0), (1, 0, 3.0)]
    assert [tuple(r)[2:] for r in s.obs.orderBy("cell_idx").collect()] == [("y", "p"), (None, "p"), ("x", "q")]
    c = SingleCell.from_h5ad(spark, path, X="layers/counts")
    assert sorted(map(tuple, c.X.collect())) == [(0, 1, 6.0), (1, 1, 7.0), (2, 0, 5.0)]


def test_10x(spark, tmp_path):
    path = str(tmp_path / "t.h5")
    w = h5ad.Writer(path)
    w.array("matrix/barcodes", ["AAC", "GGT"])
    w.array("matrix/features/id", ["E1", "E2", "E3"])
    w.array("matrix/features/name", ["one", "two", "three"])
    for name, values in (("data", np.array([4, 1, 9], "<i4")), ("indices", np.array([0, 2, 1], "<i8")), ("indptr", np.array([0, 2, 3], "<i8")), ("shape", np.array([3, 2], "<i4"))):
        w.array(f"matrix/{name}", values)
    w.close()
    s = SingleCell.load(spark, path)
    assert sorted(map(tuple, s.X.collect())) == [(0, 0, 4), (0, 2, 1), (1, 1, 9)]
    assert s.shape == (2, 3) and s.var.columns == ["gene_idx", "gene", "id"]


class Annotated:
    """Stands in for an AnnData object: all that is asked of one is that it writes itself."""

    def __init__(self, small):
        self.small = small

    def write_h5ad(self, path):
        self.small.save(path)


def test_scanpy(spark, small, tmp_path):
    s = SingleCell.from_scanpy(spark, Annotated(small), str(tmp_path / "a"))
    assert s.shape == (3, 4) and s.X.count() == 3
    try:
        import anndata  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError):
            small.to_scanpy(str(tmp_path / "b"))
    else:
        assert small.to_scanpy(str(tmp_path / "b")).shape == (3, 4)
