"""Pseudobulk and DE: samples x genes of every cell type as three frames, and differential-expression tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import bulk, ranks
from tessera.operators import tables as tb
from tessera.sources import store

COUNT_TYPES = ("int", "bigint", "float", "double")


class Pseudobulk:
    """X (cell_type, sample, gene, value), obs (cell_type, sample, ...), var (cell_type, gene, ...).

    Operators take cell_types / excluded_cell_types to act on some cell types and leave the others as they
    are.
    """

    def __init__(self, X: DataFrame, obs: DataFrame, var: DataFrame, *, check: bool = True):
        if check:
            if X.columns != ["cell_type", "sample", "gene", "value"] or obs.columns[:2] != ["cell_type", "sample"] or var.columns[:2] != ["cell_type", "gene"]:
                raise TypeError("frames must begin with (cell_type, sample, gene, value), (cell_type, sample) and (cell_type, gene)")
            if X.schema["value"].dataType.simpleString() not in COUNT_TYPES:
                raise TypeError(f"values must be one of {COUNT_TYPES}")
        self.X, self.obs, self.var = X, obs, var

    def _with(self, **changes: DataFrame) -> "Pseudobulk":
        return Pseudobulk(**{"X": self.X, "obs": self.obs, "var": self.var, **changes}, check=False)

    # --- cell types

    def keys(self) -> list[str]:
        return [r[0] for r in self.obs.select("cell_type").distinct().orderBy("cell_type").collect()]

    def __iter__(self) -> Iterator[str]:
        return iter(self.keys())

    def __len__(self) -> int:
        return len(self.keys())

    def __contains__(self, cell_type: str) -> bool:
        return bool(self.obs.where(F.col("cell_type") == cell_type).limit(1).count())

    def _one(self, cell_type: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        return tuple(df.where(F.col("cell_type") == cell_type) for df in (self.X, self.obs, self.var))  # type: ignore[return-value]

    def values(self) -> list[tuple[DataFrame, DataFrame, DataFrame]]:
        return [self._one(k) for k in self.keys()]

    def items(self) -> list[tuple[str, tuple[DataFrame, DataFrame, DataFrame]]]:
        return [(k, self._one(k)) for k in self.keys()]

    def iter_X(self) -> Iterator[DataFrame]:
        return (x for x, _, _ in self.values())

    def iter_obs(self) -> Iterator[DataFrame]:
        return (o for _, o, _ in self.values())

    def iter_var(self) -> Iterator[DataFrame]:
        return (v for _, _, v in self.values())

    def __or__(self, other: "Pseudobulk") -> "Pseudobulk":
        if self.obs.join(other.obs.select("cell_type"), "cell_type", "left_semi").limit(1).count():
            raise ValueError("cell types overlap")
        return Pseudobulk(self.X.unionByName(other.X), self.obs.unionByName(other.obs, allowMissingColumns=True), self.var.unionByName(other.var, allowMissingColumns=True))

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Pseudobulk) and all(tb.same_rows(a, b) for a, b in ((self.X, other.X), (self.obs, other.obs), (self.var, other.var)))

    __hash__ = None  # type: ignore[assignment]

    def copy(self, deep: bool = False) -> "Pseudobulk":
        return self._with()

    def split_by_cell_type(self) -> tuple["Pseudobulk", ...]:
        return tuple(self.select_cell_types(k) for k in self.keys())

    @property
    def shape(self) -> DataFrame:
        """(cell_type, samples, genes)."""
        o = self.obs.groupBy("cell_type").agg(F.count("*").alias("samples"))
        return o.join(self.var.groupBy("cell_type").agg(F.count("*").alias("genes")), "cell_type")

    @property
    def obs_names(self) -> DataFrame:
        return self.obs.select("cell_type", "sample")

    @property
    def var_names(self) -> DataFrame:
        return self.var.select("cell_type", "gene")

    def select_cell_types(self, cell_types: str | Iterable[str], *more: str) -> "Pseudobulk":
        some = tb.names_of(cell_types, *more)
        missing = set(some) - set(self.keys())
        if missing:
            raise ValueError(f"no cell types {sorted(missing)}")
        return self._with(**{n: getattr(self, n).where(F.col("cell_type").isin(some)) for n in ("X", "obs", "var")})

    def drop_cell_types(self, cell_types: str | Iterable[str], *more: str) -> "Pseudobulk":
        some = tb.names_of(cell_types, *more)
        if not set(self.keys()) - set(some):
            raise ValueError("no cell type would be left")
        return self._with(**{n: getattr(self, n).where(~F.col("cell_type").isin(some)) for n in ("X", "obs", "var")})

    def rename_cell_types(self, mapping: Mapping[str, str] | Callable[[str], str]) -> "Pseudobulk":
        old = self.keys()
        new = {k: mapping(k) if callable(mapping) else mapping.get(k, k) for k in old}
        if len(set(new.values())) < len(old):
            raise ValueError("two cell types would have one name")
        return self._with(**{n: getattr(self, n).replace(new, subset=["cell_type"]) for n in ("X", "obs", "var")})

    def _at(self, slot: str, f: Callable[[DataFrame], DataFrame], cell_types: Any = None, excluded_cell_types: Any = None) -> DataFrame:
        """f on the chosen cell types' rows of a slot; others are added as they are."""
        df = getattr(self, slot)
        if cell_types is None and excluded_cell_types is None:
            return f(df)
        if cell_types is not None and excluded_cell_types is not None:
            raise ValueError("give either cell_types or excluded_cell_types")
        some = tb.names_of(cell_types if cell_types is not None else excluded_cell_types)
        inside = F.col("cell_type").isin(some) if cell_types is not None else ~F.col("cell_type").isin(some)
        return f(df.where(inside)).unionByName(df.where(~inside), allowMissingColumns=True)

    # --- metadata

    def _kept(self, obs: DataFrame | None = None, var: DataFrame | None = None) -> "Pseudobulk":
        x = self.X
        if obs is not None:
            x = x.join(obs.select("cell_type", "sample"), ["cell_type", "sample"], "left_semi")
        if var is not None:
            x = x.join(var.select("cell_type", "gene"), ["cell_type", "gene"], "left_semi")
        return self._with(X=x.select("cell_type", "sample", "gene", "value"), **({"obs": obs} if obs is not None else {}), **({"var": var} if var is not None else {}))

    def filter_obs(self, *predicates: tb.Expr, cell_types: Any = None, excluded_cell_types: Any = None, **constraints: object) -> "Pseudobulk":
        return self._kept(obs=self._at("obs", lambda d: tb.keep_where(d, predicates, constraints), cell_types, excluded_cell_types))

    def filter_var(self, *predicates: tb.Expr, cell_types: Any = None, excluded_cell_types: Any = None, **constraints: object) -> "Pseudobulk":
        return self._kept(var=self._at("var", lambda d: tb.keep_where(d, predicates, constraints), cell_types, excluded_cell_types))

    def _meta(self, slot: str, f: Callable[[DataFrame, list[str]], DataFrame], options: Mapping[str, Any]) -> "Pseudobulk":
        return self._with(**{slot: self._at(slot, lambda d: f(d, d.columns[:2]), options.get("cell_types"), options.get("excluded_cell_types"))})

    def select_obs(self, *exprs: tb.Expr, cell_types: Any = None, excluded_cell_types: Any = None, **named: tb.Expr) -> "Pseudobulk":
        return self._meta("obs", lambda d, k: tb.select(d, k, exprs, named), {"cell_types": cell_types, "excluded_cell_types": excluded_cell_types})

    def select_var(self, *exprs: tb.Expr, cell_types: Any = None, excluded_cell_types: Any = None, **named: tb.Expr) -> "Pseudobulk":
        return self._meta("var", lambda d, k: tb.select(d, k, exprs, named), {"cell_types": cell_types, "excluded_cell_types": excluded_cell_types})

    def with_columns_obs(self, *, cell_types: Any = None, excluded_cell_types: Any = None, **named: Any) -> "Pseudobulk":
        return self._meta("obs", lambda d, k: tb.with_columns(d, k, named), {"cell_types": cell_types, "excluded_cell_types": excluded_cell_types})

    def with_columns_var(self, *, cell_types: Any = None, excluded_cell_types: Any = None, **named: Any) -> "Pseudobulk":
        return self._meta("var", lambda d, k: tb.with_columns(d, k, named), {"cell_types": cell_types, "excluded_cell_types": excluded_cell_types})

    def drop_obs(self, columns: str | Iterable[str], *more: str, **options: Any) -> "Pseudobulk":
        return self._meta("obs", lambda d, k: tb.drop(d, k, tb.names_of(columns, *more)), options)

    def drop_var(self, columns: str | Iterable[str], *more: str, **options: Any) -> "Pseudobulk":
        return self._meta("var", lambda d, k: tb.drop(d, k, tb.names_of(columns, *more)), options)

    def rename_obs(self, mapping: Mapping[str, str] | Callable[[str], str], **options: Any) -> "Pseudobulk":
        return self._meta("obs", lambda d, k: tb.rename(d, mapping, k), options)

    def rename_var(self, mapping: Mapping[str, str] | Callable[[str], str], **options: Any) -> "Pseudobulk":
        return self._meta("var", lambda d, k: tb.rename(d, mapping, k), options)

    def cast_obs(self, dtypes: Mapping[str, str], *, strict: bool = True, **options: Any) -> "Pseudobulk":
        return self._meta("obs", lambda d, k: tb.cast(d, dtypes, strict), options)

    def cast_var(self, dtypes: Mapping[str, str], *, strict: bool = True, **options: Any) -> "Pseudobulk":
        return self._meta("var", lambda d, k: tb.cast(d, dtypes, strict), options)

    def cast_X(self, dtype: str) -> "Pseudobulk":
        return self._with(X=self.X.withColumn("value", F.col("value").cast(dtype)))

    def join_obs(self, other: DataFrame, *, cell_types: Any = None, excluded_cell_types: Any = None, **options: Any) -> "Pseudobulk":
        return self._meta("obs", lambda d, k: tb.join(d, other, **options), {"cell_types": cell_types, "excluded_cell_types": excluded_cell_types})

    def join_var(self, other: DataFrame, *, cell_types: Any = None, excluded_cell_types: Any = None, **options: Any) -> "Pseudobulk":
        return self._meta("var", lambda d, k: tb.join(d, other, **options), {"cell_types": cell_types, "excluded_cell_types": excluded_cell_types})

    def set_obs_names(self, column: str) -> "Pseudobulk":
        """Another unique column as the samples' names."""
        tb.require_unique(self.obs, "cell_type", column)
        to = self.obs.select("cell_type", "sample", F.col(column).alias("_new"))
        obs = self.obs.withColumnsRenamed({"sample": "_old", column: "sample"}).withColumnRenamed("_old", "previous_sample")
        x = self.X.join(to, ["cell_type", "sample"]).select("cell_type", F.col("_new").alias("sample"), "gene", "value")
        return self._with(X=x, obs=obs.select("cell_type", "sample", *[c for c in obs.columns if c not in ("cell_type", "sample")]))

    def set_var_names(self, column: str) -> "Pseudobulk":
        tb.require_unique(self.var, "cell_type", column)
        to = self.var.select("cell_type", "gene", F.col(column).alias("_new"))
        var = self.var.withColumnsRenamed({"gene": "_old", column: "gene"}).withColumnRenamed("_old", "previous_gene")
        x = self.X.join(to, ["cell_type", "gene"]).select("cell_type", "sample", F.col("_new").alias("gene"), "value")
        return self._with(X=x, var=var.select("cell_type", "gene", *[c for c in var.columns if c not in ("cell_type", "gene")]))

    def __getitem__(self, item: Any) -> "Pseudobulk":
        """Cell types, or (cell types, samples[, genes]): names, lists of names or slice(None)."""
        types, samples, genes = (*item, slice(None), slice(None))[:3] if isinstance(item, tuple) else (item, slice(None), slice(None))
        out = self if types == slice(None) else self.select_cell_types(types)
        if samples != slice(None):
            out = out.filter_obs(F.col("sample").isin(tb.names_of(samples)))
        return out if genes == slice(None) else out.filter_var(F.col("gene").isin(tb.names_of(genes)))

    def sample(self, cell_type: str, sample: str) -> DataFrame:
        """(gene, value) of one sample, zeros included."""
        x = self.X.where((F.col("cell_type") == cell_type) & (F.col("sample") == sample)).select("gene", "value")
        return self.var.where(F.col("cell_type") == cell_type).select("gene").join(x, "gene", "left").na.fill(0, ["value"])

    def gene(self, cell_type: str, gene: str) -> DataFrame:
        """(sample, value) of one gene, zeros included."""
        x = self.X.where((F.col("cell_type") == cell_type) & (F.col("gene") == gene)).select("sample", "value")
        return self.obs.where(F.col("cell_type") == cell_type).select("sample").join(x, "sample", "left").na.fill(0, ["value"])

    def peek_obs(self, cell_type: str | None = None, *, row: int = 0) -> DataFrame:
        return self._peek(self.obs, "sample", cell_type, row)

    def peek_var(self, cell_type: str | None = None, *, row: int = 0) -> DataFrame:
        return self._peek(self.var, "gene", cell_type, row)

    def _peek(self, df: DataFrame, key: str, cell_type: str | None, row: int) -> DataFrame:
        one = tb.positions(df.where(F.col("cell_type") == (cell_type or self.keys()[0])), key).where(F.col("position") == row)
        return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in df.columns))))

    def to_df(self, *, obs_columns: Sequence[str] = (), genes: Sequence[str] | None = None, cell_type_column: str = "cell_type") -> DataFrame:
        """A row for each (cell type, sample), a column for each gene; null where the type has no such gene."""
        names = list(genes) if genes is not None else [r[0] for r in self.var.select("gene").distinct().orderBy("gene").collect()]
        rows = bulk.full(self.X, self.obs, self.var.where(F.col("gene").isin(names)))
        wide = rows.groupBy("cell_type", "sample").pivot("gene", names).agg(F.first("value"))
        out = self.obs.select("cell_type", "sample", *obs_columns).join(wide, ["cell_type", "sample"], "left")
        return out.withColumnRenamed("cell_type", cell_type_column)

    def concat_obs(self, datasets: "Pseudobulk | Sequence[Pseudobulk]", *more: "Pseudobulk", dataset_column: str | None = None, dataset_labels: Sequence[str] | None = None, flexible: bool = False) -> "Pseudobulk":
        """Stacks samples of each cell type; genes and columns must agree, or with flexible are intersected."""
        sets = [self, *([datasets] if isinstance(datasets, Pseudobulk) else datasets), *more]
        labels = dataset_labels or [str(i) for i in range(len(sets))]
        obs = tb.concat_rows([s.obs.withColumn(dataset_column, F.lit(n)) if dataset_column else s.obs for s, n in zip(sets, labels, strict=True)], flexible)
        tb.require_unique(obs, "cell_type", "sample")
        genes = sets[0].var
        for s in sets[1:]:
            if not flexible and not tb.same_rows(sets[0].var_names, s.var_names):
                raise ValueError("genes differ; flexible=True keeps what they share")
            genes = genes.join(s.var_names, ["cell_type", "gene"], "left_semi")
        x = tb.concat_rows([s.X for s in sets]).join(genes.select("cell_type", "gene"), ["cell_type", "gene"], "left_semi")
        return Pseudobulk(x.select("cell_type", "sample", "gene", "value"), obs, genes)

    def concat_var(self, datasets: "Pseudobulk | Sequence[Pseudobulk]", *more: "Pseudobulk", dataset_column: str | None = None, dataset_labels: Sequence[str] | None = None, flexible: bool = False) -> "Pseudobulk":
        """Stacks genes of each cell type; the mirror of concat_obs."""
        turn = lambda p: Pseudobulk(p.X.select("cell_type", F.col("gene").alias("sample"), F.col("sample").alias("gene"), "value"), p.var.withColumnRenamed("gene", "sample"), p.obs.withColumnRenamed("sample", "gene"))
        rest = [*([datasets] if isinstance(datasets, Pseudobulk) else datasets), *more]
        return turn(turn(self).concat_obs([turn(p) for p in rest], dataset_column=dataset_column, dataset_labels=dataset_labels, flexible=flexible))

    def _subsampled(self, slot: str, key: str, n: int | None, fraction: float | None, by: str | None, column: str | None, seed: int) -> "Pseudobulk":
        kept = None
        for t in self.keys():
            part = getattr(self, slot).where(F.col("cell_type") == t)
            some = tb.subsample(part, key, n=n, fraction=fraction, by=by, seed=seed)
            kept = some if kept is None else kept.unionByName(some)
        if column is None:
            return self._kept(**{slot: kept})
        flag = kept.select("cell_type", key, F.lit(True).alias(column))
        return self._with(**{slot: getattr(self, slot).join(flag, ["cell_type", key], "left").na.fill(False, [column])})

    def subsample_obs(self, *, n: int | None = None, fraction: float | None = None, by_column: str | None = None, subsample_column: str | None = None, seed: int = 0) -> "Pseudobulk":
        return self._subsampled("obs", "sample", n, fraction, by_column, subsample_column, seed)

    def subsample_var(self, *, n: int | None = None, fraction: float | None = None, by_column: str | None = None, subsample_column: str | None = None, seed: int = 0) -> "Pseudobulk":
        return self._subsampled("var", "gene", n, fraction, by_column, subsample_column, seed)

    # --- functions

    def pipe(self, function: Callable[..., Any], *args: Any, **kwargs: Any) -> Any:
        return function(self, *args, **kwargs)

    def pipe_X(self, function: Callable[..., DataFrame], *args: Any, **kwargs: Any) -> "Pseudobulk":
        return self._with(X=function(self.X, *args, **kwargs))

    def pipe_obs(self, function: Callable[..., DataFrame], *args: Any, **kwargs: Any) -> "Pseudobulk":
        return self._with(obs=function(self.obs, *args, **kwargs))

    def pipe_var(self, function: Callable[..., DataFrame], *args: Any, **kwargs: Any) -> "Pseudobulk":
        return self._with(var=function(self.var, *args, **kwargs))

    def _mapped(self, slot: str, function: Callable[..., Any], args: tuple, cell_types: Any, excluded_cell_types: Any, kwargs: Mapping[str, Any]) -> "Pseudobulk":
        schema = getattr(self, slot).schema
        return self._with(**{slot: self._at(slot, lambda d: d.groupBy("cell_type").applyInPandas(lambda pdf: function(pdf, *args, **kwargs), schema), cell_types, excluded_cell_types)})

    def map_X(self, function: Callable[..., Any], *args: Any, cell_types: Any = None, excluded_cell_types: Any = None, **kwargs: Any) -> "Pseudobulk":
        """A pandas function of each cell type's rows, in one task each."""
        return self._mapped("X", function, args, cell_types, excluded_cell_types, kwargs)

    def map_obs(self, function: Callable[..., Any], *args: Any, cell_types: Any = None, excluded_cell_types: Any = None, **kwargs: Any) -> "Pseudobulk":
        return self._mapped("obs", function, args, cell_types, excluded_cell_types, kwargs)

    def map_var(self, function: Callable[..., Any], *args: Any, cell_types: Any = None, excluded_cell_types: Any = None, **kwargs: Any) -> "Pseudobulk":
        return self._mapped("var", function, args, cell_types, excluded_cell_types, kwargs)

    # --- statistics

    def _require_counts(self, allow_float: bool) -> None:
        kind = self.X.schema["value"].dataType.simpleString()
        if not allow_float and kind in ("float", "double"):
            raise TypeError(f"X is {kind}; allow_float=True takes it for counts")

    def qc(self, group_column: str | None, *, custom_filter: Column | None = None, min_samples: int = 2, min_cells: int | None = 10, max_standard_deviations: float | None = 3, min_nonzero_fraction: float | None = 0.8, error_if_negative_counts: bool = True, allow_float: bool = False, verbose: bool = False) -> "Pseudobulk":
        self._require_counts(allow_float)
        if error_if_negative_counts and self.X.where("value < 0").limit(1).count():
            raise ValueError("there are negative counts")
        x, o, v = bulk.qc(self.X, self.obs, self.var, group_column, custom_filter=custom_filter, min_samples=min_samples, min_cells=min_cells, max_standard_deviations=max_standard_deviations, min_nonzero_fraction=min_nonzero_fraction)
        if not o.limit(1).count():
            raise ValueError("no cell type passes")
        return Pseudobulk(x.select(*self.X.columns), o.select(*self.obs.columns), v.select(*self.var.columns))

    def library_size(self, *, library_size_column: str = "library_size", logratio_trim: float = 0.3, sum_trim: float = 0.05, A_cutoff: float = -1e10, allow_float: bool = False, overwrite: bool = False) -> "Pseudobulk":
        self._require_counts(allow_float)
        if library_size_column in self.obs.columns and not overwrite:
            raise ValueError(f"{library_size_column!r} is there already; overwrite=True replaces it")
        sizes = bulk.library_size(self.X, self.obs, self.var, logratio_trim=logratio_trim, sum_trim=sum_trim, a_cutoff=A_cutoff)
        return self._with(obs=self.obs.drop(library_size_column).join(sizes.withColumnRenamed("library_size", library_size_column), ["cell_type", "sample"], "left"))

    def cpm(self, *, library_size_column: str = "library_size", allow_float: bool = False) -> "Pseudobulk":
        self._require_counts(allow_float)
        return self._with(X=bulk.cpm(self.X, self.obs, library_size_column))

    def log_cpm(self, *, library_size_column: str = "library_size", prior_count: float = 2, allow_float: bool = False) -> "Pseudobulk":
        self._require_counts(allow_float)
        return self._with(X=bulk.log_cpm(self.X, self.obs, self.var, library_size_column, prior_count))

    def regress_out(self, formula: str, *, categorical_columns: Sequence[str] = (), ordinal_columns: Sequence[str] = (), error_if_int: bool = True) -> "Pseudobulk":
        return self._with(X=bulk.regress_out(self.X, self.obs, formula, categorical=categorical_columns, ordinal=ordinal_columns, error_if_int=error_if_int))

    def de(self, formula: str, *, coefficient: str | int | None = None, contrasts: Mapping[str, str] | None = None, group: str | bool | None = None, categorical_columns: Sequence[str] = (), ordinal_columns: Sequence[str] = (), library_size_column: str = "library_size", return_voom_info: bool = True, allow_float: bool = False) -> "DE":
        self._require_counts(allow_float)
        found = lambda trend: bulk.de(self.X, self.obs, self.var, formula, coefficient=coefficient, contrasts=contrasts, group=group, library=library_size_column, categorical=categorical_columns, ordinal=ordinal_columns, trend=trend)
        return DE(found(False), found(True) if return_voom_info else None)

    # --- sources and sinks

    def save(self, path: str, *, overwrite: bool = False) -> None:
        for n in ("X", "obs", "var"):
            store.write(getattr(self, n), f"{path}/{n}", overwrite, ("cell_type",))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Pseudobulk":
        front = {"X": ["cell_type", "sample", "gene", "value"], "obs": ["cell_type", "sample"], "var": ["cell_type", "gene"]}
        frames = {}
        for n, keys in front.items():
            df = spark.read.parquet(f"{path}/{n}").withColumn("cell_type", F.col("cell_type").cast("string"))
            frames[n] = df.select(*keys, *[c for c in df.columns if c not in keys])
        return cls(**frames)


class DE:
    """Differential-expression table of eleven columns."""

    COLUMNS = ["cell_type", "coefficient", "gene", "logFC", "SE", "LCI", "UCI", "AveExpr", "p", "Bonferroni", "FDR"]
    VOOM = ["cell_type", "group", "gene", "mean", "spread", "fit"]

    def __init__(self, table: DataFrame, voom_plot_data: DataFrame | None = None):
        """voom_plot_data: (cell_type, group, gene, mean, spread, fit) behind the weights; run only when used."""
        if table.columns != self.COLUMNS:
            raise TypeError(f"the table must have the columns {self.COLUMNS}")
        if voom_plot_data is not None and voom_plot_data.columns != self.VOOM:
            raise TypeError(f"the voom data must have the columns {self.VOOM}")
        self.table, self.voom_plot_data = table, voom_plot_data

    @property
    def groups(self) -> dict[str, tuple[str, ...] | None] | None:
        """The groups with a trend of their own in each cell type: None where there is one trend, and None
        altogether without voom data."""
        if self.voom_plot_data is None:
            return None
        rows = self.voom_plot_data.groupBy("cell_type").agg(F.sort_array(F.collect_set("group")).alias("g")).collect()
        return {r["cell_type"]: tuple(r["g"]) or None for r in rows}

    def voom_data(self, cell_type: str) -> DataFrame:
        """A voom plot's numbers for any plotting library, by mean."""
        if self.voom_plot_data is None:
            raise ValueError("there is no voom data; de(return_voom_info=True) keeps it")
        return self.voom_plot_data.where(F.col("cell_type") == cell_type).drop("cell_type").orderBy("group", "mean")

    def get_hits(self, *, significance_column: str = "FDR", threshold: float = 0.05, num_top_hits: int | None = None) -> DataFrame:
        return ranks.get_hits(self.table, significance_column, threshold, num_top_hits)

    def get_num_hits(self, *, significance_column: str = "FDR", threshold: float = 0.05) -> DataFrame:
        return ranks.get_num_hits(self.table, significance_column, threshold)

    def volcano_data(self, cell_type: str, *, significance_column: str = "FDR", threshold: float = 0.05) -> DataFrame:
        """A volcano plot's numbers for any plotting library."""
        return self.table.where(F.col("cell_type") == cell_type).select("gene", "logFC", (-F.log10("p")).alias("neg_log10_p"), (F.col(significance_column) < threshold).alias("significant"))

    def __eq__(self, other: object) -> bool:
        return isinstance(other, DE) and tb.same_rows(self.table, other.table)

    __hash__ = None  # type: ignore[assignment]

    def __repr__(self) -> str:
        r = self.table.agg(F.count_distinct("cell_type").alias("t"), F.count_distinct("coefficient").alias("c"), F.count("*").alias("n")).first()
        return f"DE of {r['t']} cell types, {r['c']} coefficients, {r['n']} rows"

    def save(self, path: str, *, overwrite: bool = False) -> None:
        store.write(self.table, f"{path}/table", overwrite)
        if self.voom_plot_data is not None:
            store.write(self.voom_plot_data, f"{path}/voom", overwrite)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "DE":
        voom = spark.read.parquet(f"{path}/voom") if store.exists(spark, f"{path}/voom") else None
        return cls(spark.read.parquet(f"{path}/table"), voom)
