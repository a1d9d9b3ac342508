"""Column resolution and metadata operators on plain DataFrames; SingleCell and Pseudobulk build on these."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Expr = str | Column | Callable[[DataFrame], Column]


def resolve(df: DataFrame, expr: Expr) -> Column:
    """A column by name, expression, or function of the frame."""
    if isinstance(expr, str):
        if expr not in df.columns:
            raise ValueError(f"no column {expr!r}; there are {df.columns}")
        return F.col(f"`{expr}`")
    return expr if isinstance(expr, Column) else expr(df)


def names_of(columns: str | Iterable[str], *more: str) -> list[str]:
    return [*([columns] if isinstance(columns, str) else columns), *more]


def keep_where(df: DataFrame, predicates: Sequence[Expr], constraints: Mapping[str, object]) -> DataFrame:
    """Rows that meet all predicates and equal all constraints."""
    for p in predicates:
        df = df.where(resolve(df, p))
    for name, value in constraints.items():
        df = df.where(resolve(df, name) == F.lit(value))
    return df


def select(df: DataFrame, keys: Sequence[str], exprs: Sequence[Expr], named: Mapping[str, Expr]) -> DataFrame:
    """Projection with the keys first."""
    chosen = [resolve(df, e) if not isinstance(e, str) else F.col(f"`{e}`") for e in exprs if not (isinstance(e, str) and e in keys)]
    return df.select(*keys, *chosen, *(resolve(df, e).alias(n) for n, e in named.items()))


def with_columns(df: DataFrame, keys: Sequence[str], named: Mapping[str, Expr | object]) -> DataFrame:
    taken = [k for k in keys if k in named]
    if taken:
        raise ValueError(f"key columns {taken} can't be replaced")
    made = {n: resolve(df, e) if isinstance(e, Column) or callable(e) or (isinstance(e, str) and e in df.columns) else F.lit(e) for n, e in named.items()}
    return df.withColumns(made)


def drop(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    for c in columns:
        resolve(df, c)
        if c in keys:
            raise ValueError(f"{c!r} is a key and can't be dropped")
    return df.drop(*columns)


def rename(df: DataFrame, mapping: Mapping[str, str] | Callable[[str], str], keys: Sequence[str] = ()) -> DataFrame:
    renamed = {c: mapping(c) for c in df.columns if c not in keys} if callable(mapping) else dict(mapping)
    for c in renamed:
        resolve(df, c)
    out = [renamed.get(c, c) for c in df.columns]
    if len(set(out)) < len(out):
        raise ValueError("two columns would have one name")
    return df.toDF(*out)


def cast(df: DataFrame, types: Mapping[str, str], strict: bool = True) -> DataFrame:
    """strict: values that can't be cast are errors, else nulls."""
    return df.withColumns({c: resolve(df, c).cast(t) if strict else resolve(df, c).try_cast(t) for c, t in types.items()})


def join(left: DataFrame, right: DataFrame, *, on=None, left_on=None, right_on=None, suffix: str = "_right", validate: str = "m:m", nulls_equal: bool = False, coalesce: bool = True) -> DataFrame:
    """Left equi-join that may not make rows: a right key that meets a left row twice is an error."""
    if (on is None) == (left_on is None) or (left_on is None) != (right_on is None):
        raise ValueError("give either on, or left_on and right_on")
    lefts, rights = names_of(on if on is not None else left_on), names_of(on if on is not None else right_on)
    if validate not in ("m:m", "1:1", "1:m", "m:1"):
        raise ValueError(f"unknown validate={validate!r}")
    for df, cols, need in ((left, lefts, validate[0] == "1"), (right, rights, True)):
        keyed = df if nulls_equal else df.na.drop(subset=cols)
        if need and (df is right or validate[0] == "1"):
            keyed = keyed.join(left.select(*(F.col(a).alias(b) for a, b in zip(lefts, rights, strict=True))).distinct(), rights, "left_semi") if df is right and validate[2] == "m" and not nulls_equal else keyed
            if keyed.groupBy(*cols).count().where("count > 1").limit(1).count():
                raise ValueError(f"keys {cols} are not unique")
    renamed = {c: c + suffix if c in left.columns else c for c in right.columns if c not in rights}
    other = right.select(*(F.col(c).alias(f"__{i}") for i, c in enumerate(rights)), *(F.col(c).alias(n) for c, n in renamed.items()))
    test = F.lit(True)
    for i, c in enumerate(lefts):
        test &= left[c].eqNullSafe(F.col(f"__{i}")) if nulls_equal else left[c] == F.col(f"__{i}")
    out = left.join(other, test, "left")
    kept = [] if coalesce else [F.col(f"__{i}").alias(c + suffix if c in left.columns else c) for i, c in enumerate(rights)]
    return out.select(*(left[c] for c in left.columns), *kept, *renamed.values())


def unique_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """Appends -1, -2 and so on to repeats, passing over names that are there already."""
    place = Window.partitionBy(name).orderBy(order)
    made = df.withColumn("_n", F.row_number().over(place) - 1)
    while True:
        out = made.withColumn("_new", F.when(F.col("_n") == 0, F.col(name)).otherwise(F.concat(F.col(name), F.lit("-"), F.col("_n").cast("string"))))
        # Made names that clash with others move on by one; the first by order keeps its name.
        rank = F.row_number().over(Window.partitionBy("_new").orderBy((F.col("_n") != 0).cast("int"), order))
        again = out.withColumn("_r", rank)
        if not again.where("_r > 1 and _new is not null").limit(1).count():
            return out.withColumn(name, F.col("_new")).drop("_n", "_new")
        made = again.withColumn("_n", F.when((F.col("_r") > 1) & F.col("_new").isNotNull(), F.col("_n") + F.count_if(F.col("_r") > 1).over(Window.partitionBy(name).orderBy(order))).otherwise(F.col("_n"))).drop("_new", "_r")


def positions(df: DataFrame, order: str) -> DataFrame:
    """Adds `position`, 0-based by an ascending unique column, without putting all rows into one task."""
    laid = df.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id())
    local = laid.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1)
    sizes = local.groupBy("_p").agg(F.count("*").alias("_c"), F.min(order).alias("_m"))
    starts = sizes.select("_p", F.coalesce(F.sum("_c").over(Window.orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    return local.join(F.broadcast(starts), "_p").withColumn("position", F.col("_s") + F.col("_r")).drop("_p", "_r", "_s")


def filter_columns(df: DataFrame, predicate: Callable[[Column], Column]) -> DataFrame:
    """Columns whose predicate over all rows is true; one aggregate for all of them."""
    row = df.agg(*(predicate(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns))).first()
    return df.select(*(F.col(f"`{c}`") for i, c in enumerate(df.columns) if row[i]))


def constant_within(df: DataFrame, key: str) -> DataFrame:
    """One row for each key with the columns that have at most one value (null counts) within every key."""
    others = [c for c in df.columns if c != key]
    if not others:
        return df.select(key).distinct()
    per = df.groupBy(key).agg(*(F.count_distinct(F.struct(F.col(c))).alias(f"n{i}") for i, c in enumerate(others)), *(F.first(F.col(c)).alias(f"v{i}") for i, c in enumerate(others)))
    most = per.agg(*(F.max(f"n{i}") for i in range(len(others)))).first()
    return per.select(key, *(F.col(f"v{i}").alias(c) for i, c in enumerate(others) if (most[i] or 0) <= 1))


def subsample(df: DataFrame, order: str, *, n: int | None = None, fraction: float | None = None, by: str | None = None, seed: int = 0, draw: Column | None = None) -> DataFrame:
    """Exactly n rows (or the rounded fraction) by the rank of a hashed draw, in strata of `by` if given.

    Strata get their rounded share; what rounding leaves over or short is taken from the largest strata
    (added to the smallest), so that the total is exact. Null strata are left out. The draw depends on the
    row's key and the seed alone, not on partitions.
    """
    if (n is None) == (fraction is None):
        raise ValueError("give either n or fraction")
    draw = F.xxhash64(F.col(order), F.lit(seed)) if draw is None else draw
    if by is None:
        total = df.count()
        take = round(fraction * total) if n is None else n
        if take > total:
            raise ValueError(f"n={n} is more than the {total} rows")
        # Global top-n: partial limits in every partition, then one merge of n rows at most.
        chosen = df.withColumn("_d", draw).orderBy("_d", order).limit(take)
        return chosen.drop("_d")
    sizes = {r[0]: r[1] for r in df.where(F.col(by).isNotNull()).groupBy(by).count().collect()}  # one row for each stratum
    total = sum(sizes.values())
    want = round(fraction * total) if n is None else n
    if want > total:
        raise ValueError(f"n={n} is more than the {total} rows")
    quota = {k: min(v, round(want * v / total)) for k, v in sizes.items()} if total else {}
    while (off := want - sum(quota.values())) != 0:
        step = 1 if off > 0 else -1
        ranked = sorted(quota, key=lambda k: (step * sizes[k], str(k)))
        for k in ranked:
            if 0 <= quota[k] + step <= sizes[k] and off:
                quota[k] += step
                off -= step
    spark = df.sparkSession
    table = spark.createDataFrame(list(quota.items()) or [(None, 0)], f"`{by}` {df.schema[by].dataType.simpleString()}, _q long")
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(draw, order)))
    return ranked.join(F.broadcast(table), by).where("_r <= _q").select(*df.columns)


def concat_rows(frames: Sequence[DataFrame], flexible: bool = False) -> DataFrame:
    """Strict: schemas are equal. Flexible: the columns of one name and type that all frames have."""
    first = frames[0]
    if not flexible:
        for f in frames[1:]:
            if [(x.name, x.dataType) for x in f.schema] != [(x.name, x.dataType) for x in first.schema]:
                raise ValueError("schemas differ; flexible=True keeps what they share")
        shared = first.columns
    else:
        shared = [x.name for x in first.schema if all(x.name in f.columns and f.schema[x.name].dataType == x.dataType for f in frames)]
    out = first.select(*shared)
    for f in frames[1:]:
        out = out.unionByName(f.select(*shared))
    return out


def require_unique(df: DataFrame, *columns: str) -> None:
    if df.groupBy(*columns).count().where("count > 1").limit(1).count():
        raise ValueError(f"{columns} are not unique")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equal columns, types and multisets of rows; NaN equals NaN."""
    if [(x.name, x.dataType) for x in a.schema] != [(x.name, x.dataType) for x in b.schema]:
        return False
    return not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()


def align(df: DataFrame, name: str, wanted: DataFrame | Sequence[str], order: str | None = None, missing: str = "error") -> DataFrame:
    """(request, *columns of df) of the rows with the wanted names, by place in the request.

    wanted: a list, or a frame with the column `name`, numbered by its column `order`. missing: "error" for
    names that df does not hold, "drop" to leave them out, "null" to keep them with nulls.
    """
    if isinstance(wanted, DataFrame):
        if order is None:
            raise ValueError("a frame of names needs a column that orders it")
        asked = positions(wanted.select(name, order), order).select(F.col("position").alias("request"), name)
    else:
        asked = df.sparkSession.createDataFrame(list(enumerate(wanted)), f"request long, `{name}` {df.schema[name].dataType.simpleString()}")
    if missing not in ("error", "drop", "null"):
        raise ValueError("missing must be error, drop or null")
    if missing == "error" and (gone := asked.join(df, name, "left_anti").limit(5).collect()):
        raise ValueError(f"names that are not there: {[r[name] for r in gone]}")
    return asked.join(df, name, "left" if missing == "null" else "inner").select("request", *(F.col(f"`{c}`") for c in df.columns))


def recode(codes: Column, old: Sequence[str], new: Sequence[str], other: int | None = None) -> Column:
    """Codes of `old` levels as codes of `new` ones; a level that `new` does not have, and a code that is no level,
    become `other` (null by default)."""
    at = {v: i for i, v in enumerate(new)}
    if len(at) < len(new) or len(set(old)) < len(old):
        raise ValueError("levels must be unlike")
    table = F.array(*(F.lit(at.get(v, other)).cast("int") for v in old)) if old else F.array().cast("array<int>")
    return F.coalesce(F.when(codes >= 0, F.get(table, codes.cast("int"))), F.lit(other).cast("int"))


def encode(column: Column, levels: Sequence[str]) -> Column:
    """The place of a value among the levels; null for others."""
    if not levels:
        return F.lit(None).cast("int")
    return F.element_at(F.create_map(*(F.lit(x) for i, v in enumerate(levels) for x in (v, i))), column)
