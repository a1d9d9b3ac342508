"""SingleCell: a dataset of named Spark DataFrames with chained operators; every one returns a new dataset."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import aggregates as ag
from tessera.operators import cells as cl
from tessera.operators import graphs, integration, neighbors, ranks
from tessera.operators import tables as tb
from tessera.sources import h5ad, store

SLOTS = ("obsm", "varm", "obsp", "varp", "uns")
_UNS = (str, int, float, bool, list, dict, type(None))


class SingleCell:
    """Counts (cell_idx, gene_idx, value) with metadata.

    obs and var begin with cell_idx / gene_idx and a name column. obsm / varm hold frames keyed by the
    index, obsp / varp edge lists (src, dst, weight), uns a nested dict of plain values. Stored zeros
    are dropped when a dataset is made, so stored entries are detections.
    """

    def __init__(self, X: DataFrame | None, obs: DataFrame, var: DataFrame, *, obsm: Mapping[str, DataFrame] | None = None, varm: Mapping[str, DataFrame] | None = None, obsp: Mapping[str, DataFrame] | None = None, varp: Mapping[str, DataFrame] | None = None, uns: Mapping[str, Any] | None = None, check: bool = True):
        if check:
            for df, need in ((obs, "cell_idx"), (var, "gene_idx")):
                if not df.columns or df.columns[0] != need or len(df.columns) < 2:
                    raise TypeError(f"the first columns must be {need} and a name, not {df.columns[:2]}")
            if X is not None:
                if X.columns != ["cell_idx", "gene_idx", "value"]:
                    raise TypeError(f"X must have cell_idx, gene_idx and value, not {X.columns}")
                X = X.where("value <> 0")
            for name, slot, key in (("obsm", obsm, "cell_idx"), ("varm", varm, "gene_idx"), ("obsp", obsp, "src"), ("varp", varp, "src")):
                for k, df in (slot or {}).items():
                    if not isinstance(k, str) or key not in df.columns:
                        raise TypeError(f"{name}[{k!r}] has no column {key}")
            _check_uns(uns or {})
        self.X, self.obs, self.var = X, obs, var
        self.obsm, self.varm, self.obsp, self.varp, self.uns = dict(obsm or {}), dict(varm or {}), dict(obsp or {}), dict(varp or {}), dict(uns or {})

    def _with(self, **changes: Any) -> "SingleCell":
        parts = {k: getattr(self, k) for k in ("X", "obs", "var", *SLOTS)}
        return SingleCell(**{**parts, **changes}, check=False)

    # --- construction, sources and sinks

    @classmethod
    def from_frames(cls, X: DataFrame, obs: DataFrame, var: DataFrame, *, cell: str | None = None, gene: str | None = None) -> "SingleCell":
        """From long counts (cell name, gene name, value) and metadata that begin with the names."""
        cell, gene = cell or obs.columns[0], gene or var.columns[0]
        tb.require_unique(obs, cell)
        tb.require_unique(var, gene)
        o = tb.positions(obs, cell).select(F.col("position").alias("cell_idx"), *obs.columns)
        v = tb.positions(var, gene).select(F.col("position").cast("int").alias("gene_idx"), *var.columns)
        names = X.columns
        x = X.join(o.select(F.col(cell).alias(names[0]), "cell_idx"), names[0]).join(F.broadcast(v.select(F.col(gene).alias(names[1]), "gene_idx")), names[1])
        return cls(x.select("cell_idx", "gene_idx", F.col(names[2]).alias("value")), o, v)

    def save(self, path: str, *, overwrite: bool = False) -> None:
        """A folder of Parquet tables, or one HDF5 file if path ends in .h5ad, where null names become empty."""
        if path.endswith(".h5ad"):
            self._save_h5ad(path, overwrite)
            return
        for name, df in (("X", self.X), ("obs", self.obs), ("var", self.var)):
            if df is not None:
                store.write(df, f"{path}/{name}", overwrite)
        for slot in SLOTS[:4]:
            for k, df in getattr(self, slot).items():
                store.write(df, f"{path}/{slot}/{k}", overwrite)
        store.write_json(self.obs.sparkSession, self.uns, f"{path}/uns", overwrite)

    def _save_h5ad(self, path: str, overwrite: bool) -> None:
        path = h5ad.local(path)
        if os.path.exists(path) and not overwrite:
            raise FileExistsError(path)
        # Rows of the file are places, whatever the indices are.
        cells = tb.positions(self.obs, "cell_idx").select("cell_idx", F.col("position").alias("_cell"))
        genes = tb.positions(self.var, "gene_idx").select("gene_idx", F.col("position").alias("_gene"))
        w = h5ad.Writer(path)
        n, m = h5ad.write_frame(w, "obs", self.obs, "cell_idx"), h5ad.write_frame(w, "var", self.var, "gene_idx")
        if self.X is not None:
            x = self.X.join(cells, "cell_idx").join(F.broadcast(genes), "gene_idx").select("_cell", "_gene", "value")
            h5ad.write_sparse(w, "X", x, (n, m), self.X.schema["value"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"))
        for slot, held, key, place, to, size in (("obsm", self.obsm, "cell_idx", "_cell", cells, n), ("varm", self.varm, "gene_idx", "_gene", genes, m)):
            w.group(slot, **{"encoding-type": "dict", "encoding-version": "0.1.0"})
            for k, df in held.items():
                if "v" in df.columns:
                    h5ad.write_vectors(w, f"{slot}/{k}", df.join(to, key).select(place, "v"), place, size)
        for slot, held, to, key, size in (("obsp", self.obsp, cells, "cell_idx", n), ("varp", self.varp, genes, "gene_idx", m)):
            w.group(slot, **{"encoding-type": "dict", "encoding-version": "0.1.0"})
            for k, df in held.items():
                src, dst = (to.toDF(c, f"_{c}") for c in ("src", "dst"))
                weight = next(c for c in df.columns if c not in ("src", "dst"))
                h5ad.write_sparse(w, f"{slot}/{k}", df.join(src, "src").join(dst, "dst").select("_src", "_dst", weight), (size, size), False)
        h5ad.write_plain(w, "uns", self.uns)
        w.group("", **{"encoding-type": "anndata", "encoding-version": "0.1.0"})
        w.close()

    @classmethod
    def from_h5ad(cls, spark: SparkSession, path: str, *, X: bool | str = True, obs_columns: Sequence[str] | None = None, var_columns: Sequence[str] | None = None, obsm: Sequence[str] | None = None, varm: Sequence[str] | None = None, obsp: Sequence[str] | None = None, varp: Sequence[str] | None = None, uns: bool = True) -> "SingleCell":
        """An .h5ad file. X: whether to take counts, or where they stand (such as "raw/X" or "layers/counts");
        columns and keys: those wanted, all by default. Each frame reads its own part of the file when it runs."""
        held = h5ad.slots(path)
        wanted = lambda slot, keys: [k for k in held.get(slot, []) if keys is None or k in keys]
        with h5ad.File(h5ad.local(path)) as f:
            flat = {f"{s}/{k}" for s in ("obsm", "varm") for k in held.get(s, []) if f.is_dataset(f"{s}/{k}") and len(f.shape(f"{s}/{k}")) == 2}
        at = "X" if X is True else X
        dense = lambda slot, keys, key: {k: h5ad.vectors(spark, path, f"{slot}/{k}", key) for k in wanted(slot, keys) if f"{slot}/{k}" in flat}
        pairs = lambda slot, keys: {k: h5ad.entries(spark, path, f"{slot}/{k}", ("src", "dst", "weight")) for k in wanted(slot, keys)}
        return cls(
            h5ad.entries(spark, path, at).where("value <> 0") if at and (at != "X" or "X" in held) else None,
            h5ad.frame(spark, path, "obs", "cell_idx", obs_columns),
            h5ad.frame(spark, path, "var", "gene_idx", var_columns, wide=False),
            obsm=dense("obsm", obsm, "cell_idx"), varm=dense("varm", varm, "gene_idx"), obsp=pairs("obsp", obsp), varp=pairs("varp", varp),
            uns=h5ad.plain(path) if uns else {}, check=False,
        )

    def to_scanpy(self, path: str) -> Any:
        """An AnnData object on the driver, by way of the file it is written to. Needs the anndata package."""
        import anndata

        self.save(path if path.endswith(".h5ad") else f"{path}.h5ad")
        return anndata.read_h5ad(h5ad.local(path if path.endswith(".h5ad") else f"{path}.h5ad"))

    @classmethod
    def from_scanpy(cls, spark: SparkSession, adata: Any, path: str) -> "SingleCell":
        """A dataset from an AnnData object, by way of a file in a folder that all tasks can read; tasks go on
        reading it, so it has to stay."""
        path = path if path.endswith(".h5ad") else f"{path}.h5ad"
        adata.write_h5ad(h5ad.local(path))
        return cls.from_h5ad(spark, path)

    @classmethod
    def from_10x(cls, spark: SparkSession, path: str) -> "SingleCell":
        """A 10x .h5 file: group `matrix`, genes x cells in compressed columns."""
        with h5ad.File(h5ad.local(path)) as f:
            names = [k for k in ("name", "id", "feature_type", "genome") if f.is_dataset(f"matrix/features/{k}")]
            cells, features = f.read("matrix/barcodes").tolist(), [f.read(f"matrix/features/{k}").tolist() for k in names]
        o = spark.createDataFrame(list(enumerate(cells)), "cell_idx long, cell string")
        v = spark.createDataFrame([(i, *r) for i, r in enumerate(zip(*features, strict=True))], "gene_idx int, " + ", ".join(f"{'gene' if i == 0 else k} string" for i, k in enumerate(names)))
        return cls(h5ad.entries(spark, path, "matrix", rows_first=True), o, v)

    @classmethod
    def load(cls, spark: SparkSession, path: str, *, X: bool = True, obs_columns: Sequence[str] | None = None, var_columns: Sequence[str] | None = None) -> "SingleCell":
        if path.endswith(".h5ad"):
            return cls.from_h5ad(spark, path, X=X, obs_columns=obs_columns, var_columns=var_columns)
        if path.endswith(".h5"):
            return cls.from_10x(spark, path)
        o, v = cls.read_obs(spark, path, obs_columns), cls.read_var(spark, path, var_columns)
        x = spark.read.parquet(f"{path}/X") if X and store.exists(spark, f"{path}/X") else None
        slots = {s: {k: spark.read.parquet(f"{path}/{s}/{k}") for k in store.children(spark, f"{path}/{s}")} for s in SLOTS[:4]}
        return cls(x, o, v, **slots, uns=store.read_json(spark, f"{path}/uns"), check=False)

    @staticmethod
    def read_obs(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
        if path.endswith(".h5ad"):
            return h5ad.frame(spark, path, "obs", "cell_idx", columns)
        return _some(spark.read.parquet(f"{path}/obs"), columns)

    @staticmethod
    def read_var(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
        if path.endswith(".h5ad"):
            return h5ad.frame(spark, path, "var", "gene_idx", columns, wide=False)
        return _some(spark.read.parquet(f"{path}/var"), columns)

    @staticmethod
    def read_slot(spark: SparkSession, path: str, slot: str, key: str) -> DataFrame:
        if path.endswith(".h5ad"):
            if slot in ("obsm", "varm"):
                return h5ad.vectors(spark, path, f"{slot}/{key}", "cell_idx" if slot == "obsm" else "gene_idx")
            return h5ad.entries(spark, path, f"{slot}/{key}", ("src", "dst", "weight"))
        return spark.read.parquet(f"{path}/{slot}/{key}")

    @staticmethod
    def read_uns(spark: SparkSession, path: str) -> dict:
        return h5ad.plain(path) if path.endswith(".h5ad") else store.read_json(spark, f"{path}/uns")

    @staticmethod
    def ls(spark: SparkSession, path: str) -> DataFrame:
        """(slot, columns, rows) from schemas, headers and footers alone."""
        if path.endswith(".h5ad"):
            return spark.createDataFrame(h5ad.listing(path), "slot string, columns string, rows long")
        found = [n for n in ("X", "obs", "var") if store.exists(spark, f"{path}/{n}")]
        found += [f"{s}/{k}" for s in SLOTS[:4] for k in store.children(spark, f"{path}/{s}")]
        frames = {n: spark.read.parquet(f"{path}/{n}") for n in found}
        rows = [(n, ", ".join(f"{a}: {b}" for a, b in df.dtypes), df.count()) for n, df in frames.items()]
        return spark.createDataFrame(rows, "slot string, columns string, rows long")

    @classmethod
    def from_mtx(cls, spark: SparkSession, matrix: str, barcodes: str, features: str) -> "SingleCell":
        """MatrixMarket counts, genes x cells, with one name a line (the first tab-separated field)."""
        name = lambda p: F.split("value", "\t")[0]
        o = tb.positions(spark.read.text(barcodes).withColumn("_i", F.monotonically_increasing_id()), "_i").select(F.col("position").alias("cell_idx"), name(0).alias("cell"))
        v = tb.positions(spark.read.text(features).withColumn("_i", F.monotonically_increasing_id()), "_i").select(F.col("position").cast("int").alias("gene_idx"), name(0).alias("gene"))
        x = store.read_mtx(spark, matrix).select(F.col("col").alias("cell_idx"), F.col("row").cast("int").alias("gene_idx"), "value")
        return cls(x, o, v)

    # --- slots

    @property
    def obs_names(self) -> DataFrame:
        return self.obs.select(self.obs.columns[1])

    @property
    def var_names(self) -> DataFrame:
        return self.var.select(self.var.columns[1])

    @property
    def shape(self) -> tuple[int, int]:
        return self.obs.count(), self.var.count()

    @property
    def num_threads(self) -> int:
        return self.obs.sparkSession.sparkContext.defaultParallelism

    def set_num_threads(self, n: int) -> "SingleCell":
        """Accepted for compatibility; the cluster decides."""
        if n == 0 or n < -1:
            raise ValueError("num_threads must be positive or -1")
        return self

    def copy(self, deep: bool = False) -> "SingleCell":
        return self._with()

    def equals(self, other: "SingleCell") -> bool:
        pairs = [(self.obs, other.obs), (self.var, other.var)]
        if (self.X is None) != (other.X is None) or self.uns != other.uns:
            return False
        pairs += [(self.X, other.X)] if self.X is not None else []
        for s in SLOTS[:4]:
            a, b = getattr(self, s), getattr(other, s)
            if a.keys() != b.keys():
                return False
            pairs += [(a[k], b[k]) for k in a]
        return all(tb.same_rows(a, b) for a, b in pairs)

    __eq__ = equals  # type: ignore[assignment]
    __hash__ = None  # type: ignore[assignment]

    def set_obs_names(self, column: str) -> "SingleCell":
        tb.require_unique(self.obs, column)
        return self._with(obs=self.obs.select("cell_idx", column, *[c for c in self.obs.columns[1:] if c != column]))

    def set_var_names(self, column: str) -> "SingleCell":
        tb.require_unique(self.var, column)
        return self._with(var=self.var.select("gene_idx", column, *[c for c in self.var.columns[1:] if c != column]))

    def make_obs_names_unique(self) -> "SingleCell":
        return self._with(obs=tb.unique_names(self.obs, self.obs.columns[1], "cell_idx"))

    def make_var_names_unique(self) -> "SingleCell":
        return self._with(var=tb.unique_names(self.var, self.var.columns[1], "gene_idx"))

    def peek_obs(self, row: int = 0) -> DataFrame:
        return _peek(self.obs, "cell_idx", row)

    def peek_var(self, row: int = 0) -> DataFrame:
        return _peek(self.var, "gene_idx", row)

    def tocsr(self) -> "SingleCell":
        return self._with(X=self.X.repartitionByRange("cell_idx").sortWithinPartitions("cell_idx", "gene_idx"))

    def tocsc(self) -> "SingleCell":
        return self._with(X=self.X.repartitionByRange("gene_idx").sortWithinPartitions("gene_idx", "cell_idx"))

    def drop_X(self) -> "SingleCell":
        return self._with(X=None)

    def select_slot(self, slot: str, *keys: str) -> "SingleCell":
        held = getattr(self, slot)
        return self._with(**{slot: {k: held[k] for k in keys}})

    def with_slot(self, slot: str, **entries: Any) -> "SingleCell":
        if slot == "uns":
            _check_uns(entries)
        return self._with(**{slot: {**getattr(self, slot), **entries}})

    def drop_slot(self, slot: str, *keys: str) -> "SingleCell":
        held = dict(getattr(self, slot))
        for k in keys:
            del held[k]
        return self._with(**{slot: held})

    def rename_slot(self, slot: str, mapping: Mapping[str, str] | Callable[[str], str]) -> "SingleCell":
        new = (lambda k: mapping(k)) if callable(mapping) else (lambda k: mapping.get(k, k))
        return self._with(**{slot: {new(k): v for k, v in getattr(self, slot).items()}})

    # --- metadata, filters, indexing

    def _subset(self, obs: DataFrame | None = None, var: DataFrame | None = None) -> "SingleCell":
        """The rows of obs and var that are left, everywhere; an empty result is kept as such."""
        out: dict[str, Any] = {}
        x = self.X
        for key, meta, slot, pairs in (("cell_idx", obs, "obsm", "obsp"), ("gene_idx", var, "varm", "varp")):
            if meta is None:
                continue
            ids = meta.select(key)
            x = x.join(ids, key, "left_semi").select("cell_idx", "gene_idx", "value") if x is not None else None
            out["obs" if key == "cell_idx" else "var"] = meta
            out[slot] = {k: df.join(ids, key, "left_semi").select(*df.columns) for k, df in getattr(self, slot).items()}
            ends = {e: ids.select(F.col(key).alias(e)) for e in ("src", "dst")}
            out[pairs] = {k: df.join(ends["src"], "src", "left_semi").join(ends["dst"], "dst", "left_semi").select(*df.columns) for k, df in getattr(self, pairs).items()}
        return self._with(X=x, **out)

    def filter_obs(self, *predicates: tb.Expr, **constraints: object) -> "SingleCell":
        return self._subset(obs=tb.keep_where(self.obs, predicates, constraints))

    def filter_var(self, *predicates: tb.Expr, **constraints: object) -> "SingleCell":
        return self._subset(var=tb.keep_where(self.var, predicates, constraints))

    def select_obs(self, *exprs: tb.Expr, **named: tb.Expr) -> "SingleCell":
        return self._with(obs=tb.select(self.obs, self.obs.columns[:2], exprs, named))

    def select_var(self, *exprs: tb.Expr, **named: tb.Expr) -> "SingleCell":
        return self._with(var=tb.select(self.var, self.var.columns[:2], exprs, named))

    def with_columns_obs(self, **named: Any) -> "SingleCell":
        return self._with(obs=tb.with_columns(self.obs, self.obs.columns[:2], named))

    def with_columns_var(self, **named: Any) -> "SingleCell":
        return self._with(var=tb.with_columns(self.var, self.var.columns[:2], named))

    def drop_obs(self, columns: str | Iterable[str], *more: str) -> "SingleCell":
        return self._with(obs=tb.drop(self.obs, self.obs.columns[:2], tb.names_of(columns, *more)))

    def drop_var(self, columns: str | Iterable[str], *more: str) -> "SingleCell":
        return self._with(var=tb.drop(self.var, self.var.columns[:2], tb.names_of(columns, *more)))

    def rename_obs(self, mapping: Mapping[str, str] | Callable[[str], str]) -> "SingleCell":
        return self._with(obs=tb.rename(self.obs, mapping, ("cell_idx",)))

    def rename_var(self, mapping: Mapping[str, str] | Callable[[str], str]) -> "SingleCell":
        return self._with(var=tb.rename(self.var, mapping, ("gene_idx",)))

    def cast_obs(self, types: Mapping[str, str], strict: bool = True) -> "SingleCell":
        return self._with(obs=tb.cast(self.obs, types, strict))

    def cast_var(self, types: Mapping[str, str], strict: bool = True) -> "SingleCell":
        return self._with(var=tb.cast(self.var, types, strict))

    def cast_X(self, dtype: str) -> "SingleCell":
        return self._with(X=self.X.withColumn("value", F.col("value").cast(dtype)))

    def join_obs(self, other: DataFrame, **options: Any) -> "SingleCell":
        return self._with(obs=tb.join(self.obs, other, **options))

    def join_var(self, other: DataFrame, **options: Any) -> "SingleCell":
        return self._with(var=tb.join(self.var, other, **options))

    def __getitem__(self, item: Any) -> "SingleCell":
        """Cells, or (cells, genes), by position, name, slice (positions, or names with both ends), list or
        Boolean column."""
        cells, genes = item if isinstance(item, tuple) else (item, slice(None))
        return self._subset(obs=_pick(self.obs, "cell_idx", cells), var=_pick(self.var, "gene_idx", genes))

    def cell(self, name: str) -> DataFrame:
        """(gene, value) of one cell, zeros included."""
        return self._dense("cell_idx", self.obs, name, "gene_idx", self.var)

    def gene(self, name: str) -> DataFrame:
        """(cell, value) of one gene, zeros included."""
        return self._dense("gene_idx", self.var, name, "cell_idx", self.obs)

    def _dense(self, key: str, meta: DataFrame, name: str, other: str, others: DataFrame) -> DataFrame:
        row = meta.where(F.col(meta.columns[1]) == name).select(key).first()
        if row is None:
            raise ValueError(f"no {meta.columns[1]} {name!r}")
        some = self.X.where(F.col(key) == row[0]).select(other, "value")
        return others.join(some, other, "left").select(others.columns[1], F.coalesce("value", F.lit(0)).alias("value"))

    def get_sample_covariates(self, ID_column: str) -> DataFrame:
        return tb.constant_within(self.obs.drop(*self.obs.columns[:2]) if ID_column not in self.obs.columns[:2] else self.obs, ID_column)

    def subsample_obs(self, **options: Any) -> "SingleCell":
        column = options.pop("subsample_column", None)
        by = options.pop("by_column", None)
        kept = tb.subsample(self.obs, "cell_idx", by=by, **options)
        if column is None:
            return self._subset(obs=kept)
        return self._with(obs=self.obs.join(kept.select("cell_idx", F.lit(True).alias(column)), "cell_idx", "left").na.fill(False, [column]))

    def subsample_var(self, **options: Any) -> "SingleCell":
        by = options.pop("by_column", None)
        return self._subset(var=tb.subsample(self.var, "gene_idx", by=by, **options))

    def split_by_obs(self, column: str) -> dict[Any, "SingleCell"]:
        values = [r[0] for r in self.obs.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).collect()]
        return {v: self.filter_obs(F.col(column) == F.lit(v)) for v in values}

    def split_by_var(self, column: str) -> dict[Any, "SingleCell"]:
        values = [r[0] for r in self.var.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).collect()]
        return {v: self.filter_var(F.col(column) == F.lit(v)) for v in values}

    def eliminate_zeros(self) -> "SingleCell":
        return self._with(X=self.X.where("value <> 0"))

    def has_canonical_format(self) -> bool:
        return not self.X.groupBy("cell_idx", "gene_idx").count().where("count > 1").limit(1).count()

    # --- functions of slots

    def pipe(self, function: Callable[..., Any], *args: Any, **kwargs: Any) -> Any:
        return function(self, *args, **kwargs)

    def pipe_X(self, function: Callable[..., DataFrame], *args: Any, **kwargs: Any) -> "SingleCell":
        return self._with(X=function(self.X, *args, **kwargs))

    def pipe_obs(self, function: Callable[..., DataFrame], *args: Any, **kwargs: Any) -> "SingleCell":
        return self._with(obs=function(self.obs, *args, **kwargs))

    def pipe_var(self, function: Callable[..., DataFrame], *args: Any, **kwargs: Any) -> "SingleCell":
        return self._with(var=function(self.var, *args, **kwargs))

    def pipe_slot(self, slot: str, function: Callable[..., dict], *args: Any, **kwargs: Any) -> "SingleCell":
        return self._with(**{slot: function(getattr(self, slot), *args, **kwargs)})

    def pipe_slot_key(self, slot: str, key: str, function: Callable[..., Any], *args: Any, **kwargs: Any) -> "SingleCell":
        held = getattr(self, slot)
        return self._with(**{slot: {**held, key: function(held[key], *args, **kwargs)}})

    # --- analytics

    def _add_obs(self, df: DataFrame) -> "SingleCell":
        new = [c for c in df.columns if c != "cell_idx"]
        return self._with(obs=self.obs.drop(*new).join(df, "cell_idx", "left"))

    def _passing(self) -> DataFrame:
        return self.obs.where("passed_QC") if "passed_QC" in self.obs.columns else self.obs

    def _require_counts(self, allow_float: bool) -> None:
        kind = self.X.schema["value"].dataType.simpleString()
        if not allow_float and kind in ("float", "double"):
            raise TypeError(f"X is {kind}; allow_float=True takes it for counts and drops fractions")

    def qc_metrics(self, *, mito: Column | None = None, allow_float: bool = False) -> "SingleCell":
        self._require_counts(allow_float)
        flag = cl.is_mito(self.var.columns[1]) if mito is None else mito
        return self._add_obs(ag.qc_metrics(self.X, self.obs, self.var.where(flag)))

    def qc(self, *, max_mito_fraction: float | None = 0.05, min_genes: int | None = 100, nonzero_MALAT1: bool = True, required_gene: str = "MALAT1", custom_filter: Column | None = None, remove_doublets: bool = False, batch_column: str | None = None, mito: Column | None = None, subset: bool = False, allow_float: bool = False, QC_column: str = "passed_QC") -> "SingleCell":
        self._require_counts(allow_float)
        flag = cl.is_mito(self.var.columns[1]) if mito is None else mito
        metrics = ag.qc_metrics(self.X, self.obs, self.var.where(flag))
        gene = None
        if nonzero_MALAT1:
            row = self.var.where(F.col(self.var.columns[1]) == required_gene).first()
            if row is None:
                raise ValueError(f"no gene {required_gene!r}")
            gene = row[0]
        passed = cl.qc_flags(metrics, self.X, max_mito_fraction=max_mito_fraction, min_genes=min_genes, required_gene=gene)
        out = self._add_obs(passed)
        if custom_filter is not None:
            out = out._with(obs=out.obs.withColumn("passed_QC", F.col("passed_QC") & F.coalesce(custom_filter, F.lit(False))))
        if remove_doublets:
            out = out.find_doublets(batch_column=batch_column)
            out = out._with(obs=out.obs.withColumn("passed_QC", F.col("passed_QC") & ~F.coalesce("doublet", F.lit(False))).drop("doublet", "doublet_score"))
        if QC_column != "passed_QC":
            out = out.rename_obs({"passed_QC": QC_column})
        out = out.with_slot("uns", QCed=True)
        return out.filter_obs(F.col(QC_column)) if subset else out

    def skip_qc(self) -> "SingleCell":
        return self.with_slot("uns", QCed=True)

    def find_doublets(self, *, batch_column: str | None = None, doublet_fraction: float | None = None, doublet_score_column: str = "doublet_score", num_genes: int = 500, seed: int = 0) -> "SingleCell":
        cells = self._passing()
        parts = [cells] if batch_column is None else [cells.where(F.col(batch_column) == F.lit(r[0])) for r in cells.select(batch_column).where(F.col(batch_column).isNotNull()).distinct().collect()]
        found = None
        for part in parts:
            own = self.X.join(part.select("cell_idx"), "cell_idx", "left_semi")
            d = cl.find_doublets(own, part, num_genes=num_genes, doublet_fraction=doublet_fraction, seed=seed)
            found = d if found is None else found.unionByName(d)
        return self._add_obs(found.withColumnRenamed("doublet_score", doublet_score_column))

    def hvg(self, *others: "SingleCell", num_genes: int = 2000, batch_column: str | None = None, span: float = 0.3, allow_float: bool = False) -> "SingleCell | tuple[SingleCell, ...]":
        """Variable genes; with other datasets, of the genes all share, ranked over all of them as batches."""
        self._require_counts(allow_float)
        if not others:
            cells = self._passing()
            found = cl.hvg(self.X.join(cells.select("cell_idx"), "cell_idx", "left_semi"), self.var, cells, num_genes=num_genes, batch=batch_column, span=span)
            return self._with(var=self.var.drop("highly_variable", "highly_variable_rank").join(F.broadcast(found), "gene_idx", "left"))
        sets = [self, *others]
        name = self.var.columns[1]
        shared = self.var.select(name)
        for s in others:
            shared = shared.join(s.var.select(F.col(s.var.columns[1]).alias(name)), name, "left_semi")
        genes = tb.positions(shared, name).select(F.col("position").cast("int").alias("g"), name)
        x, cells, base = None, None, 0
        for i, s in enumerate(sets):
            ok = s._passing()
            to = s.var.select("gene_idx", F.col(s.var.columns[1]).alias(name)).join(genes, name)
            part = s.X.join(ok.select("cell_idx"), "cell_idx", "left_semi").join(F.broadcast(to.select("gene_idx", "g")), "gene_idx").select((F.col("cell_idx") + base).alias("cell_idx"), F.col("g").alias("gene_idx"), "value")
            own = ok.select((F.col("cell_idx") + base).alias("cell_idx"), F.lit(i).alias("_set"))
            x, cells = (part, own) if x is None else (x.unionByName(part), cells.unionByName(own))
            base += (s.obs.agg(F.max("cell_idx")).first()[0] or 0) + 1
        found = cl.hvg(x, genes.select(F.col("g").alias("gene_idx"), name), cells, num_genes=num_genes, batch="_set", span=span)
        named = found.join(genes.withColumnRenamed("g", "gene_idx"), "gene_idx").drop("gene_idx")
        return tuple(s._with(var=s.var.join(F.broadcast(named.withColumnRenamed(name, s.var.columns[1])), s.var.columns[1], "left").select(*s.var.columns, F.coalesce("highly_variable", F.lit(False)).alias("highly_variable"), "highly_variable_rank")) for s in sets)

    def normalize(self, method: str = "log1pPF", *, inplace: bool = False, allow_float: bool = False) -> "SingleCell":
        self._require_counts(allow_float)
        flags = self.obs.select("cell_idx", F.coalesce("passed_QC", F.lit(False)).alias("passed_QC")) if "passed_QC" in self.obs.columns else self.obs.select("cell_idx", F.lit(True).alias("passed_QC"))
        return self._with(X=cl.normalize(self.X, flags, method)).with_slot("uns", normalized=True)

    def pca(self, *others: "SingleCell", num_PCs: int = 50) -> "SingleCell | tuple[SingleCell, ...]":
        """Principal components of the variable genes; several datasets share them, by gene name."""
        if not others:
            cells = self._passing()
            genes = self.var.where("highly_variable") if "highly_variable" in self.var.columns else self.var
            scores, loadings = cl.pca(self.X.join(cells.select("cell_idx"), "cell_idx", "left_semi"), cells, genes, num_PCs)
            return self.with_slot("obsm", pca=scores).with_slot("varm", pca=loadings)
        sets, parts, base, bases = [self, *others], [], 0, []
        name = self.var.columns[1]
        genes = self.var.where("highly_variable").select("gene_idx", name)
        cells = None
        for s in sets:
            ok = s._passing()
            to = s.var.select(F.col("gene_idx").alias("own"), F.col(s.var.columns[1]).alias(name)).join(genes, name)
            parts.append(s.X.withColumnRenamed("gene_idx", "own").join(F.broadcast(to), "own").join(ok.select("cell_idx"), "cell_idx", "left_semi").select((F.col("cell_idx") + base).alias("cell_idx"), "gene_idx", "value"))
            mine = ok.select((F.col("cell_idx") + base).alias("cell_idx"))
            cells = mine if cells is None else cells.unionByName(mine)
            bases.append(base)
            base += (s.obs.agg(F.max("cell_idx")).first()[0] or 0) + 1
        scores, loadings = cl.pca(tb.concat_rows(parts), cells, genes, num_PCs)
        ends = [*bases[1:], base]
        return tuple(s.with_slot("obsm", pca=scores.where((F.col("cell_idx") >= a) & (F.col("cell_idx") < e)).select((F.col("cell_idx") - a).alias("cell_idx"), "v")) for s, a, e in zip(sets, bases, ends, strict=True))

    def neighbors(self, *, num_neighbors: int = 20, PC_key: str = "pca", exact: bool = False, **options: Any) -> "SingleCell":
        v = self.obsm[PC_key]
        found = neighbors.knn_exact(v, num_neighbors) if exact else neighbors.neighbors(v, num_neighbors, **options)
        return self.with_slot("obsm", neighbors=found)

    def shared_neighbors(self, *, min_shared_neighbors: int = 3) -> "SingleCell":
        knn = self.obsm["neighbors"]
        stale = knn.join(self.obs.select(F.col("cell_idx").alias("nbr_idx")), "nbr_idx", "left_anti").limit(1).count()
        if stale:
            raise ValueError("neighbors name cells that are no longer there: run neighbors() again")
        return self.with_slot("obsp", shared_neighbors=neighbors.shared_neighbors(knn, min_shared_neighbors=min_shared_neighbors))

    def cluster(self, *, resolution: float | Sequence[float] = 1.0, min_cluster_size: int = 1, seed: int = 0) -> "SingleCell":
        return self._add_obs(graphs.cluster(self.obsp["shared_neighbors"], self._passing(), resolution, min_cluster_size=min_cluster_size, seed=seed))

    def harmonize(self, *others: "SingleCell", batch_column: str | None = None, PC_key: str = "pca", Harmony_key: str = "harmony", **options: Any) -> "SingleCell | tuple[SingleCell, ...]":
        """Batch-corrected components; several datasets are batches of their own."""
        if not others:
            return self.with_slot("obsm", **{Harmony_key: integration.harmonize(self.obsm[PC_key], self.obs, batch_column, **options)})
        sets, base, bases, v, b = [self, *others], 0, [], None, None
        for i, s in enumerate(sets):
            moved = s.obsm[PC_key].select((F.col("cell_idx") + base).alias("cell_idx"), "v")
            own = F.lit(str(i)) if batch_column is None else F.concat_ws("/", F.lit(str(i)), F.col(batch_column).cast("string"))
            labels = s.obs.select((F.col("cell_idx") + base).alias("cell_idx"), own.alias("_batch"))
            v, b = (moved, labels) if v is None else (v.unionByName(moved), b.unionByName(labels))
            bases.append(base)
            base += (s.obs.agg(F.max("cell_idx")).first()[0] or 0) + 1
        out = integration.harmonize(v, b, "_batch", **options)
        return tuple(s.with_slot("obsm", **{Harmony_key: out.where((F.col("cell_idx") >= a) & (F.col("cell_idx") < e)).select((F.col("cell_idx") - a).alias("cell_idx"), "v")}) for s, a, e in zip(sets, bases, [*bases[1:], base], strict=True))

    def label_transfer_from(self, other: "SingleCell", original_cell_type_column: str, *, num_neighbors: int = 20, cell_type_column: str | None = None, key: str = "harmony", next_best: bool = False, exact: bool = False) -> "SingleCell":
        name = cell_type_column or original_cell_type_column
        known = other.obs.where(F.col(original_cell_type_column).isNotNull()).select("cell_idx", F.col(original_cell_type_column).alias(name))
        ref = other.obsm[key].join(known.select("cell_idx"), "cell_idx", "left_semi")
        knn = neighbors.knn_exact(self.obsm[key], num_neighbors, ref) if exact else neighbors.neighbors(self.obsm[key], num_neighbors, reference=ref)
        out = neighbors.label_transfer(knn, known, label=name, next_best=next_best)
        return self._add_obs(out.withColumnRenamed("confidence", f"{name}_confidence").withColumnRenamed("next_best_confidence", f"next_best_{name}_confidence"))

    def _embed(self, how: Callable[..., DataFrame], name: str, PC_key: str, options: Mapping[str, Any]) -> "SingleCell":
        return self.with_slot("obsm", **{name: how(self.obsm[PC_key], self.obsm["neighbors"], **options)})

    def umap(self, *, PC_key: str = "pca", **options: Any) -> "SingleCell":
        return self._embed(graphs.umap, "umap", PC_key, options)

    def pacmap(self, *, PC_key: str = "pca", **options: Any) -> "SingleCell":
        return self._embed(graphs.pacmap, "pacmap", PC_key, options)

    def localmap(self, *, PC_key: str = "pca", **options: Any) -> "SingleCell":
        return self._embed(graphs.localmap, "localmap", PC_key, options)

    def find_markers(self, cell_type_column: str, **options: Any) -> DataFrame:
        """(cell_type, gene, detection_rate, fold_change[, marker]) by descending fold change."""
        cells = self._passing().where(F.col(cell_type_column).isNotNull()).select("cell_idx", F.col(cell_type_column).alias("cell_type"))
        sizes = cells.groupBy("cell_type").agg(F.count("*").alias("n"))
        found = ranks.find_markers(ag.grouped_detection(self.X, cells, "cell_type"), sizes, "cell_type", **options)
        names = self.var.select("gene_idx", F.col(self.var.columns[1]).alias("gene"))
        out = found.join(F.broadcast(names), "gene_idx").select("cell_type", "gene", *found.columns[2:])
        return out.orderBy("cell_type", F.col("fold_change").desc(), "gene")

    def pseudobulk(self, ID_column: str, cell_type_column: str, *, allow_float: bool = False) -> "Pseudobulk":
        from tessera.pseudobulk import Pseudobulk

        self._require_counts(allow_float)
        cells = self._passing().na.drop(subset=[ID_column, cell_type_column])
        groups = cells.select("cell_idx", F.col(cell_type_column).alias("cell_type"), F.col(ID_column).alias("sample"))
        gene = self.var.columns[1]
        sums = ag.grouped_sum(self.X, groups, "cell_type", "sample").join(F.broadcast(self.var.select("gene_idx", F.col(gene).alias("gene"))), "gene_idx")
        covariates = tb.constant_within(cells.drop(*cells.columns[:2]), ID_column).withColumnRenamed(ID_column, "sample")
        covariates = covariates.drop("cell_type") if "cell_type" in covariates.columns else covariates
        obs = groups.groupBy("cell_type", "sample").agg(F.count("*").alias("num_cells")).join(covariates, "sample", "left")
        obs = obs.select("cell_type", "sample", "num_cells", *[c for c in covariates.columns if c != "sample"])
        var = obs.select("cell_type").distinct().crossJoin(F.broadcast(self.var.drop("gene_idx").withColumnRenamed(gene, "gene")))
        return Pseudobulk(sums.select("cell_type", "sample", "gene", "value"), obs, var)

    def plot_data(self, key: str, *columns: str) -> DataFrame:
        """Coordinates of an embedding with metadata, for any plotting library."""
        return self.obsm[key].join(self.obs.select("cell_idx", *columns), "cell_idx")

    def heatmap_data(self, rows: str, columns: str, normalize: bool = False) -> DataFrame:
        return ag.crosstab(self.obs, rows, columns, normalize)

    def marker_data(self, genes: Sequence[str], cell_type_column: str) -> DataFrame:
        """Detection rate and mean of genes in each cell type (a dot plot's numbers)."""
        cells = self.obs.where(F.col(cell_type_column).isNotNull()).select("cell_idx", F.col(cell_type_column).alias("cell_type"))
        some = self.var.where(F.col(self.var.columns[1]).isin(list(genes)))
        d = ag.grouped_detection(self.X, cells, "cell_type", some)
        sizes = cells.groupBy("cell_type").agg(F.count("*").alias("n"))
        return d.join(sizes, "cell_type").join(F.broadcast(some.select("gene_idx", F.col(self.var.columns[1]).alias("gene"))), "gene_idx").select("cell_type", "gene", (F.col("detected") / F.col("n")).alias("detection_rate"), (F.col("total") / F.col("n")).alias("mean"))


def concat_obs(datasets: Sequence[SingleCell], *more: SingleCell, dataset_column: str | None = None, dataset_labels: Sequence[str] | None = None, flexible: bool = False) -> SingleCell:
    """Stacks cells. Strict: equal genes and obs schemas. Flexible: genes and columns that all share. Cell
    names that repeat are an error."""
    sets = [*([datasets] if isinstance(datasets, SingleCell) else datasets), *more]
    gene, cell = sets[0].var.columns[1], sets[0].obs.columns[1]
    names = [s.var.select(F.col(s.var.columns[1]).alias(gene)) for s in sets]
    shared = names[0]
    for n in names[1:]:
        if not flexible and not tb.same_rows(names[0], n):
            raise ValueError("genes differ; flexible=True keeps what they share")
        shared = shared.join(n, gene, "left_semi")
    var = sets[0].var.join(shared, gene, "left_semi").select(*sets[0].var.columns)
    labels = dataset_labels or [str(i) for i in range(len(sets))]
    obs, xs, base = [], [], 0
    for s, label in zip(sets, labels, strict=True):
        o = s.obs.withColumn("cell_idx", F.col("cell_idx") + base)
        obs.append(o.withColumn(dataset_column, F.lit(label)) if dataset_column else o)
        to = s.var.select(F.col("gene_idx").alias("own"), F.col(s.var.columns[1]).alias(gene)).join(var.select("gene_idx", gene), gene).select("own", "gene_idx")
        xs.append(s.X.withColumnRenamed("gene_idx", "own").join(F.broadcast(to), "own").select((F.col("cell_idx") + base).alias("cell_idx"), "gene_idx", "value"))
        base += (s.obs.agg(F.max("cell_idx")).first()[0] or 0) + 1
    out = tb.concat_rows(obs, flexible)
    tb.require_unique(out, cell)
    return SingleCell(tb.concat_rows(xs), out, var, check=False)


def concat_var(datasets: Sequence[SingleCell], *more: SingleCell, dataset_column: str | None = None, dataset_labels: Sequence[str] | None = None, flexible: bool = False) -> SingleCell:
    """Stacks genes: the mirror of concat_obs."""
    turned = [_turned(s) for s in [*([datasets] if isinstance(datasets, SingleCell) else datasets), *more]]
    return _turned(concat_obs(turned, dataset_column=dataset_column, dataset_labels=dataset_labels, flexible=flexible))


def _turned(s: SingleCell) -> SingleCell:
    obs = s.var.withColumnRenamed("gene_idx", "cell_idx").withColumn("cell_idx", F.col("cell_idx").cast("long"))
    var = s.obs.withColumnRenamed("cell_idx", "gene_idx")
    return SingleCell(s.X.select(F.col("gene_idx").cast("long").alias("cell_idx"), F.col("cell_idx").alias("gene_idx"), "value"), obs, var, check=False)


def _some(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    return df if columns is None else df.select(*df.columns[:2], *[c for c in columns if c not in df.columns[:2]])


def _peek(df: DataFrame, key: str, row: int) -> DataFrame:
    """(column, value) of the row at a position."""
    one = tb.positions(df, key).where(F.col("position") == row)
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in df.columns if c != key))))


def _pick(df: DataFrame, key: str, item: Any) -> DataFrame | None:
    name = df.columns[1]
    if isinstance(item, slice) and item == slice(None):
        return None
    if isinstance(item, Column):
        return df.where(item)
    if isinstance(item, slice) and (isinstance(item.start, str) or isinstance(item.stop, str)):
        ends = {r[name]: r[key] for r in df.where(F.col(name).isin([x for x in (item.start, item.stop) if x is not None])).select(name, key).collect()}
        out = df
        if item.start is not None:
            out = out.where(F.col(key) >= ends[item.start])
        return out.where(F.col(key) <= ends[item.stop]) if item.stop is not None else out
    if isinstance(item, str) or (isinstance(item, (list, tuple)) and item and isinstance(item[0], str)):
        wanted = [item] if isinstance(item, str) else list(item)
        out = df.where(F.col(name).isin(wanted))
        if out.count() < len(set(wanted)):
            raise ValueError(f"some of {wanted} are not there")
        return out
    n = df.count()
    at = tb.positions(df, key)
    if isinstance(item, slice):
        r = range(*item.indices(n))
        test = (F.col("position") >= min(r, default=n)) & (F.col("position") <= max(r, default=-1)) & (F.pmod(F.col("position") - (r[0] if len(r) else 0), F.lit(abs(r.step))) == 0)
        return at.where(test).select(*df.columns)
    wanted = [item] if isinstance(item, int) else list(item)
    if any(not -n <= i < n for i in wanted):
        raise IndexError(f"positions must be in [-{n}, {n})")
    return at.where(F.col("position").isin([i % n for i in wanted])).select(*df.columns)


def _check_uns(uns: Any) -> None:
    if not isinstance(uns, _UNS):
        raise TypeError(f"uns can't hold a {type(uns).__name__}")
    for v in uns.values() if isinstance(uns, dict) else uns if isinstance(uns, list) else ():
        _check_uns(v)
