"""Pseudobulk statistics: sample and gene QC, TMM library sizes, CPM, designs, regression, limma-voom.

Frames: counts (cell_type, sample, gene, value) without zeros needed, obs (cell_type, sample, num_cells, ...),
var (cell_type, gene, ...). What is relational is one plan for all cell types; the linear models run as one
task for each cell type (samples x genes matrices, which are small)."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import stats

def of_type() -> "WindowSpec":  # noqa: F821
    return Window.partitionBy("cell_type")


def full(counts: DataFrame, obs: DataFrame, var: DataFrame) -> DataFrame:
    """Counts with zeros: every sample of a cell type with every gene of it."""
    grid = obs.select("cell_type", "sample").join(var.select("cell_type", "gene"), "cell_type")
    return grid.join(counts, ["cell_type", "sample", "gene"], "left").na.fill(0, ["value"])


def qc(counts: DataFrame, obs: DataFrame, var: DataFrame, group: str | None, *, custom_filter: Column | None = None, min_samples: int = 2, min_cells: int | None = 10, max_standard_deviations: float | None = 3, min_nonzero_fraction: float | None = 0.8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(counts, obs, var) of the samples, genes and cell types that pass.

    In order: enough samples; custom filter; known group; enough cells; enough samples again; number of zero
    genes below mean + k population standard deviations; enough samples; genes whose
    (1 - min_nonzero_fraction) quantile over the samples of every group is above zero (negative values count
    as zeros there). With a group, a cell type needs min_samples in each of its groups, and two groups at least.
    """

    def enough(o: DataFrame) -> DataFrame:
        if group is None:
            return o.withColumn("_n", F.count("*").over(of_type())).where(F.col("_n") >= min_samples).drop("_n")
        # By windows: a join with its own aggregate would double the plan at each of the three checks.
        known = F.col(group).isNotNull()
        each = F.count("*").over(Window.partitionBy("cell_type", group))
        marked = o.withColumn("_n", F.when(known, each)).withColumns({"_m": F.min("_n").over(of_type()), "_g": F.size(F.collect_set(group).over(of_type()))})
        return marked.where((F.col("_m") >= min_samples) & (F.col("_g") > 1)).drop("_n", "_m", "_g")

    # Samples x genes are small beside the cells they come from, and every filter reads them again.
    counts, obs, var = counts.persist(), obs.persist(), var.persist()
    o = enough(obs)
    if custom_filter is not None:
        o = o.where(custom_filter)
    if group is not None:
        o = o.where(F.col(group).isNotNull())
    if min_cells is not None:
        o = o.where(F.col("num_cells") >= min_cells)
    o = enough(o)
    if max_standard_deviations is not None:
        genes = var.groupBy("cell_type").agg(F.count("*").alias("_g"))
        seen = counts.where("value <> 0").groupBy("cell_type", "sample").agg(F.count("*").alias("_s"))
        z = o.join(genes, "cell_type").join(seen, ["cell_type", "sample"], "left").withColumn("_z", F.col("_g") - F.coalesce("_s", F.lit(0)))
        limit = F.avg("_z").over(of_type()) + max_standard_deviations * F.stddev_pop("_z").over(of_type())
        o = z.withColumn("_l", limit).where("_z < _l").drop("_g", "_s", "_z", "_l")
        o = enough(o)
    o = o.persist()  # a row for each sample
    v = var.join(o.select("cell_type").distinct(), "cell_type", "left_semi")
    kept = counts.join(o.select("cell_type", "sample"), ["cell_type", "sample"], "left_semi")
    if min_nonzero_fraction is not None:
        by = ["cell_type", *([group] if group else [])]
        # The quantile of n samples lies between two of them, of which the upper one is the (ceil(h) + 1)-th for
        # h = (n - 1) q; it is above zero where no more than ceil(h) samples are zero. So counts of samples
        # that have a gene are enough, and no zeros are made.
        sizes = o.groupBy(*by).agg(F.count("*").alias("_n")).withColumn("_need", F.col("_n") - F.ceil((F.col("_n") - 1) * F.lit(1 - min_nonzero_fraction)))
        groups = sizes.groupBy("cell_type").agg(F.count("*").alias("_groups"))
        have = kept.where("value > 0").join(o.select("cell_type", "sample", *by[1:]), ["cell_type", "sample"]).groupBy(*by, "gene").agg(F.count("*").alias("_have"))
        passed = have.join(sizes, by).where("_have >= _need").groupBy("cell_type", "gene").agg(F.count("*").alias("_passed"))
        good = passed.join(groups, "cell_type").where("_passed = _groups")
        v = v.join(good.select("cell_type", "gene"), ["cell_type", "gene"], "left_semi")
        kept = kept.join(v.select("cell_type", "gene"), ["cell_type", "gene"], "left_semi")
    return kept, o, v


def tmm(x: np.ndarray, logratio_trim: float = 0.3, sum_trim: float = 0.05, a_cutoff: float = -1e10) -> np.ndarray:
    """Trimmed-mean-of-M-values factors of a samples x genes matrix, with product 1."""
    lib = x.sum(axis=1).astype(float)
    x = x[:, (x > 0).any(axis=0)]
    if not x.shape[1] or len(x) < 2:
        return np.ones(len(lib))
    f75 = np.quantile(x, 0.75, axis=1) / lib
    ref = int(np.argmax(np.sqrt(x).sum(axis=1))) if np.median(f75) < 1e-20 else int(np.argmin(np.abs(f75 - f75.mean())))
    out = np.ones(len(x))
    for i in range(len(x)):
        both = (x[i] > 0) & (x[ref] > 0)
        a, b = x[i, both] / lib[i], x[ref, both] / lib[ref]
        r, s = np.log2(a / b), (np.log2(a) + np.log2(b)) / 2
        w = 1 / ((lib[i] - x[i, both]) / lib[i] / x[i, both] + (lib[ref] - x[ref, both]) / lib[ref] / x[ref, both])
        ok = np.isfinite(r) & (s > a_cutoff)
        r, s, w = r[ok], s[ok], w[ok]
        # Ranks by what the logs are of, so that ties do not hang on their rounding.
        ratio, product = (x[i, both] / x[ref, both])[ok], (x[i, both] * x[ref, both])[ok]
        if not len(r) or np.abs(r).max() < 1e-6:
            continue
        n = len(r)
        low_r, low_s = int(n * logratio_trim) + 1, int(n * sum_trim) + 1
        rr, rs = _ranks(ratio), _ranks(product)
        keep = (rr >= low_r) & (rr <= n + 1 - low_r) & (rs >= low_s) & (rs <= n + 1 - low_s)
        f = (w[keep] * r[keep]).sum() / w[keep].sum() if keep.any() else 0.0
        out[i] = 2**f if np.isfinite(f) else 1.0
    return out / np.exp(np.log(out).mean())


def _ranks(x: np.ndarray) -> np.ndarray:
    """Ascending ranks with ties at their average."""
    _, inv, n = np.unique(x, return_inverse=True, return_counts=True)
    last = np.cumsum(n)
    return ((last - n + 1 + last) / 2)[inv]


def library_size(counts: DataFrame, obs: DataFrame, var: DataFrame, **options: float) -> DataFrame:
    """(cell_type, sample, library_size): total counts times the TMM factor."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="sample", columns="gene", values="value").fillna(0)
        x = m.to_numpy(float)
        return pd.DataFrame({"cell_type": pdf["cell_type"].iloc[0], "sample": m.index, "library_size": x.sum(axis=1) * tmm(x, **options)})

    rows = full(counts, obs, var).select("cell_type", F.col("sample").cast("string").alias("sample"), "gene", F.col("value").cast("double").alias("value"))
    found = rows.groupBy("cell_type").applyInPandas(run, "cell_type string, sample string, library_size double")
    return found.withColumn("sample", F.col("sample").cast(obs.schema["sample"].dataType))


def cpm(counts: DataFrame, obs: DataFrame, column: str = "library_size") -> DataFrame:
    """(cell_type, sample, gene, value): counts per million of the library."""
    return counts.join(obs.select("cell_type", "sample", column), ["cell_type", "sample"]).select("cell_type", "sample", "gene", (F.col("value") / F.col(column) * 1e6).alias("value"))


def log_cpm(counts: DataFrame, obs: DataFrame, var: DataFrame, column: str = "library_size", prior_count: float = 2) -> DataFrame:
    """log2 counts per million with a prior in proportion to the library, zeros included."""
    lib = obs.select("cell_type", "sample", F.col(column).alias("_l"), (F.lit(float(prior_count)) * F.col(column) / F.avg(column).over(of_type())).alias("_a"))
    rows = full(counts, obs, var).join(lib, ["cell_type", "sample"])
    y = F.log2(F.col("value") + F.col("_a")) - F.log2(F.col("_l") + 2 * F.col("_a")) + F.lit(float(np.log2(1e6)))
    return rows.select("cell_type", "sample", "gene", y.alias("value"))


class Design:
    """Design matrix of a model formula over sample metadata: `+ : * - 0 1`, backticks, log2() and the like.

    Categorical columns (text, booleans, or named) get treatment contrasts against their first level;
    ordinal ones get orthogonal polynomials; whole numbers must be declared one or the other unless
    error_if_int is off. Columns of zeros are dropped.
    """

    CALLS = {"log2": np.log2, "log": np.log, "log10": np.log10, "log1p": np.log1p, "sqrt": np.sqrt, "exp": np.exp}

    def __init__(self, formula: str, data: pd.DataFrame, *, categorical: Sequence[str] = (), ordinal: Sequence[str] = (), levels: Mapping[str, Sequence] | None = None, error_if_int: bool = True):
        self.data, self.categorical, self.ordinal, self.levels, self.error_if_int = data, set(categorical), set(ordinal), dict(levels or {}), error_if_int
        terms, intercept = self._terms(formula)
        cols: list[tuple[str, np.ndarray]] = [("(Intercept)", np.ones(len(data)))] if intercept else []
        self.term_columns: dict[str, list[str]] = {}
        whole = intercept
        for t in terms:
            parts = [self._columns(v, not whole and len(t) == 1) for v in t]
            whole = whole or (len(t) == 1 and self._is_categorical(t[0]))
            made = [("", np.ones(len(data)))]
            for p in parts:
                made = [(f"{a}:{b}" if a else b, x * y) for b, y in p for a, x in made]
            self.term_columns[":".join(t)] = [n for n, _ in made]
            cols += made
        self.names = [n for n, x in cols if np.any(x != 0)]
        self.matrix = np.column_stack([x for _, x in cols if np.any(x != 0)]) if cols else np.empty((len(data), 0))
        self.intercept = intercept

    @staticmethod
    def variables(formula: str) -> list[str]:
        return list(dict.fromkeys(a or b for a, b in re.findall(r"`([^`]+)`|\b([A-Za-z.][\w.]*)\b(?!\s*\()", formula.lstrip("~ "))))

    def _terms(self, formula: str) -> tuple[list[tuple[str, ...]], bool]:
        body, held = formula.strip().removeprefix("~"), []
        body = re.sub(r"`([^`]+)`", lambda m: held.append(m[1]) or f"\x01{len(held) - 1}\x02", body)
        back = lambda s: re.sub(r"\x01(\d+)\x02", lambda m: held[int(m[1])], s.strip())
        terms: list[tuple[str, ...]] = []
        intercept = True
        for sign, part in re.findall(r"([+-]?)\s*((?:[^+\-()]|\([^)]*\))+)", body):
            part = part.strip()
            if part in ("0", "1"):
                intercept = (part == "1") != (sign == "-")
                continue
            names = [back(x) for x in part.split("*")]
            made = [tuple(back(y) for y in x.split(":")) for x in part.split("*")] if len(names) == 1 else []
            if len(names) > 1:
                for mask in sorted(range(1, 1 << len(names)), key=lambda m: (m.bit_count(), m)):
                    made.append(tuple(n for i, n in enumerate(names) if mask >> i & 1))
            for t in made:
                if sign == "-":
                    terms = [x for x in terms if x != t]
                elif t not in terms:
                    terms.append(t)
        return sorted(terms, key=len), intercept

    def _values(self, name: str) -> tuple[str, np.ndarray | pd.Series]:
        call = re.fullmatch(r"(\w+)\((.+)\)", name)
        if call and call[1] in self.CALLS:
            return "number", self.CALLS[call[1]](self.data[call[2].strip()].to_numpy(float))
        if name not in self.data:
            raise ValueError(f"the formula's {name!r} is no column")
        s = self.data[name]
        if s.isna().any():
            raise ValueError(f"{name!r} has missing values")
        if name in self.ordinal:
            return "ordinal", s
        if name in self.categorical or s.dtype == object or s.dtype == bool or str(s.dtype) in ("category", "str", "string"):
            return "category", s
        if self.error_if_int and np.issubdtype(s.dtype, np.integer):
            raise ValueError(f"{name!r} is integer: name it in categorical_columns or ordinal_columns, or make it a float")
        return "number", s.to_numpy(float)

    def _is_categorical(self, name: str) -> bool:
        return self._values(name)[0] == "category"

    def _columns(self, name: str, whole: bool) -> list[tuple[str, np.ndarray]]:
        kind, s = self._values(name)
        if kind == "number":
            return [(name, np.asarray(s))]
        levels = list(self.levels.get(name) or sorted(s.unique()))
        if kind == "category":
            return [(f"{name}{v}", (s == v).to_numpy(float)) for v in levels[0 if whole else 1 :]]
        x = np.arange(1.0, len(levels) + 1)
        q, r = np.linalg.qr(np.vander(x - x.mean(), len(levels), increasing=True))
        poly = (q * np.sign(np.diag(r)))[:, 1:]
        at = s.map({v: i for i, v in enumerate(levels)}).to_numpy()
        tags = [".L", ".Q", ".C"] + [f"^{i}" for i in range(4, len(levels))]
        return [(f"{name}{tags[i]}", poly[at, i]) for i in range(poly.shape[1])]


def regress_out(values: DataFrame, obs: DataFrame, formula: str, **options) -> DataFrame:
    """Residuals of least squares on the design, for each gene of each cell type."""
    used = Design.variables(formula)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="sample", columns="gene", values="value").fillna(0.0)
        o = pdf.drop_duplicates("sample").set_index("sample").loc[m.index]
        d = Design(formula, o, **options).matrix
        if d.shape[0] <= d.shape[1] or np.linalg.matrix_rank(d) < d.shape[1]:
            raise ValueError("the design has dependent columns or too few samples")
        r = m.to_numpy(float) - d @ np.linalg.lstsq(d, m.to_numpy(float), rcond=None)[0]
        out = pd.DataFrame(r, index=m.index, columns=m.columns).stack().rename("value").reset_index()
        out.insert(0, "cell_type", pdf["cell_type"].iloc[0])
        return out[["cell_type", "sample", "gene", "value"]]

    rows = values.join(obs.select("cell_type", "sample", *used), ["cell_type", "sample"]).withColumn("value", F.col("value").cast("double"))
    schema = f"cell_type string, sample {obs.schema['sample'].dataType.simpleString()}, gene string, value double"
    return rows.groupBy("cell_type").applyInPandas(run, schema)


def squeeze(s2: np.ndarray, df: np.ndarray) -> tuple[float, float]:
    """(d0, s0^2) of the scaled F distribution of variances, by the moments of their logs."""
    ok = (df > 0) & (s2 > 0)
    e = np.log(s2[ok]) - stats.digamma(df[ok] / 2) + np.log(df[ok] / 2)
    mean = e.mean()
    spread = ((e - mean) ** 2).sum() / max(1, len(e) - 1) - stats.trigamma(df[ok] / 2).mean()
    if spread <= 0:
        return np.inf, float(np.exp(mean))
    d0 = 2 * stats.trigamma_inverse(float(spread))
    return d0, float(np.exp(mean + stats.digamma(d0 / 2) - np.log(d0 / 2)))


def voom(y: np.ndarray, design: np.ndarray, lib: np.ndarray, span: float = 0.5) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """log2 CPM (samples x genes), precision weights, and the trend (x, y, fitted)."""
    e = np.log2((y + 0.5) / (lib[:, None] + 1) * 1e6)
    beta = np.linalg.lstsq(design, e, rcond=None)[0]
    fit = design @ beta
    sd = np.sqrt(((e - fit) ** 2).sum(axis=0) / max(1, len(y) - np.linalg.matrix_rank(design)))
    sx = e.mean(axis=0) + np.mean(np.log2(lib + 1)) - np.log2(1e6)
    sy = np.sqrt(sd)
    some = y.any(axis=0)
    trend = stats.lowess(sx[some], sy[some], span)
    order = np.argsort(sx[some], kind="stable")
    fitted = np.log2(2**fit * (lib[:, None] + 1) / 1e6)
    w = np.interp(fitted, sx[some][order], trend[order]) ** -4
    return e, w, {"x": sx[some], "y": sy[some], "fit": trend, "genes": np.flatnonzero(some)}


def contrast_matrix(contrasts: Mapping[str, str], names: Sequence[str]) -> np.ndarray:
    """Columns of coefficients for linear combinations such as "a - b" or "(a + b) / 2"."""
    out = np.zeros((len(names), len(contrasts)))
    by_length = sorted(range(len(names)), key=lambda i: -len(names[i]))
    for c, text in enumerate(contrasts.values()):
        expr = text.replace("`", "")
        for i in by_length:
            expr = expr.replace(names[i], f"\x01{i}\x02")
        expr = re.sub("\x01(\\d+)\x02", r"v[\1]", expr)
        if not re.fullmatch(r"(?:v\[\d+\]|[\d.]+|[\s+\-*/()])+", expr):
            raise ValueError(f"unknown name in contrast {text!r}; there are {list(names)}")
        basis = np.eye(len(names))
        out[:, c] = eval(expr, {"__builtins__": {}}, {"v": basis})  # noqa: S307  only indices and arithmetic are left
    return out


DE_COLUMNS = "cell_type string, coefficient string, gene string, logFC double, SE double, LCI double, UCI double, AveExpr double, p double, Bonferroni double, FDR double"


def weighted(y: np.ndarray, design: np.ndarray, lib: np.ndarray, groups: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, dict[str, dict[str, np.ndarray]]]:
    """log2 CPM and precision weights of samples x genes counts, and the trend behind them for each group
    ("" where there is one for all)."""
    if groups is None:
        e, w, trend = voom(y, design, lib)
        return e, w, {"": trend}
    e, w, trends = np.log2((y + 0.5) / (lib[:, None] + 1) * 1e6), np.empty(y.shape), {}
    for g in np.unique(groups):
        m = groups == g
        d = design[m]
        rank = lambda j, d=d: int(np.linalg.matrix_rank(d[:, :j])) if j else 0
        q = [j for j in range(d.shape[1]) if rank(j + 1) > rank(j)]
        d = d[:, q]
        _, w[m], trends[str(g)] = voom(y[m], np.ones((m.sum(), 1)) if d.shape[1] >= m.sum() else d, lib[m])
    return e, w, trends


def fit_de(y: np.ndarray, design: np.ndarray, lib: np.ndarray, coef: np.ndarray, groups: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """limma-voom of samples x genes counts: effects of the columns of coef. groups: a mean-variance trend for
    each of them."""
    e, w, _ = weighted(y, design, lib, groups)
    n, k = design.shape
    xtwx = np.einsum("ni,ng,nj->gij", design, w, design)
    xtwy = np.einsum("ni,ng,ng->gi", design, w, e)
    inv = np.linalg.inv(xtwx)
    beta = np.einsum("gij,gj->gi", inv, xtwy)
    res = e - design @ beta.T
    df = np.full(y.shape[1], n - k, float)
    s2 = (w * res**2).sum(axis=0) / (n - k)
    d0, s0 = squeeze(s2, df)
    post = np.full_like(s2, s0) if np.isinf(d0) else (d0 * s0 + df * s2) / (d0 + df)
    total = np.minimum(d0 + df, df.sum())
    logfc = beta @ coef
    se = np.sqrt(np.einsum("ic,gij,jc->gc", coef, inv, coef)) * np.sqrt(post)[:, None]
    half = se * stats.t_quantile(0.975, total)[:, None]
    return {"logFC": logfc, "SE": se, "LCI": logfc - half, "UCI": logfc + half, "p": stats.t_sf2(logfc / se, total[:, None]), "AveExpr": e.mean(axis=0)}


def de(counts: DataFrame, obs: DataFrame, var: DataFrame, formula: str, *, coefficient: str | int | None = None, contrasts: Mapping[str, str] | None = None, group: str | bool | None = None, library: str = "library_size", trend: bool = False, **options) -> DataFrame:
    """The DE table of all cell types, or with trend the numbers behind their weights (mean log2 count, root of
    the standard deviation, and the fitted curve, of each gene and group): one task each. Default coefficient: the first after the intercept;
    default group: the categorical column behind it, where each of its groups has two samples."""
    used = [c for c in dict.fromkeys([*Design.variables(formula), *([group] if isinstance(group, str) else [])])]

    def prepared(pdf: pd.DataFrame) -> tuple:
        m = pdf.pivot(index="sample", columns="gene", values="value").fillna(0.0)
        o = pdf.drop_duplicates("sample").set_index("sample").loc[m.index]
        d = Design(formula, o, **options)
        x = d.matrix
        if x.shape[0] <= x.shape[1] or np.linalg.matrix_rank(x) < x.shape[1]:
            raise ValueError(f"{pdf['cell_type'].iloc[0]}: the design has dependent columns or too few samples")
        if contrasts:
            names, coef = list(contrasts), contrast_matrix(contrasts, d.names)
        else:
            i = coefficient if isinstance(coefficient, int) else d.names.index(coefficient) if coefficient is not None else int(d.intercept)
            names, coef = [d.names[i]], np.eye(len(d.names))[:, [i]]
        behind = group if isinstance(group, str) else None
        if group is None and not contrasts:
            behind = next((v for v in Design.variables(formula) if v in o and d._is_categorical(v) and names[0].startswith(v)), None)
        groups = None
        if behind is not None:
            groups = o[behind].astype(str).to_numpy()
            if np.unique(groups, return_counts=True)[1].min() < 2:
                if isinstance(group, str):
                    raise ValueError(f"a group of {behind!r} has one sample")
                groups = None
        return m, o, x, names, coef, groups

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m, o, x, names, coef, groups = prepared(pdf)
        f = fit_de(m.to_numpy(float), x, o[library].to_numpy(float), coef, groups)
        parts = []
        for c, name in enumerate(names):
            p = f["p"][:, c]
            n, order = len(p), np.argsort(-p, kind="stable")
            q = np.empty(n)
            q[order] = np.minimum.accumulate(p[order] * n / np.arange(n, 0, -1))
            parts.append(pd.DataFrame({"cell_type": pdf["cell_type"].iloc[0], "coefficient": name, "gene": m.columns, **{k: f[k][:, c] for k in ("logFC", "SE", "LCI", "UCI")}, "AveExpr": f["AveExpr"], "p": p, "Bonferroni": np.minimum(1, p * n), "FDR": q}))
        return pd.concat(parts)

    rows = full(counts, obs, var).join(obs.select("cell_type", "sample", library, *[c for c in used if c in obs.columns and c != library]), ["cell_type", "sample"]).withColumn("value", F.col("value").cast("double"))
    if not trend:
        return rows.groupBy("cell_type").applyInPandas(run, DE_COLUMNS)

    def trends(pdf: pd.DataFrame) -> pd.DataFrame:
        m, o, x, _, _, groups = prepared(pdf)
        found = weighted(m.to_numpy(float), x, o[library].to_numpy(float), groups)[2]
        parts = [pd.DataFrame({"cell_type": pdf["cell_type"].iloc[0], "group": g or None, "gene": m.columns[t["genes"]], "mean": t["x"], "spread": t["y"], "fit": t["fit"]}) for g, t in found.items()]
        return pd.concat(parts)

    return rows.groupBy("cell_type").applyInPandas(trends, "cell_type string, group string, gene string, mean double, spread double, fit double")
