"""DataFrame verbs. Order is explicit: where rows have an order, a column of it is given."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POSITION = "_pos"
AGGREGATES = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count, "std": F.stddev_samp, "var": F.var_samp, "median": F.median}


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def from_columns(spark: SparkSession, columns: dict[str, list]) -> DataFrame:
    """Columns of equal length, with their positions."""
    lengths = {len(v) for v in columns.values()}
    if len(lengths) > 1:
        raise ValueError("columns must have equal lengths")
    names = list(columns)
    return spark.createDataFrame([(i, *row) for i, row in enumerate(zip(*columns.values(), strict=True))], [POSITION, *names])


def from_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """The union of all keys in the order they come first; missing cells are null."""
    names = list(dict.fromkeys(k for r in rows for k in r))
    return spark.createDataFrame([tuple(r.get(k) for k in names) for r in rows], names)


def series(spark: SparkSession, data: list, index: list[str] | None = None, name: str = "value") -> DataFrame:
    """_pos, idx and the values."""
    index = [str(i) for i in range(len(data))] if index is None else index
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(zip(index, data, strict=True))], [POSITION, "idx", name])


def series_from_map(spark: SparkSession, m: dict) -> DataFrame:
    keys = sorted(m)
    return series(spark, [m[k] for k in keys], keys)


def shape(df: DataFrame) -> DataFrame:
    """rows, cols."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("cols", F.lit(len(df.columns)))


def row_count(df: DataFrame) -> int:
    return df.count()


def columns(df: DataFrame) -> list[str]:
    return df.columns


def series_name(s: DataFrame) -> str:
    """The name of a series' values: the column that is neither position nor index."""
    return next(c for c in s.columns if c not in (POSITION, "idx"))


def index(s: DataFrame) -> DataFrame:
    """A series' positions and index."""
    return s.select(POSITION, "idx")


def map_series(s: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    """The series with f of each value."""
    name = series_name(s)
    return s.withColumn(name, f(F.col(name)))


def map_rows(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Each row with these columns computed from it."""
    return df.withColumns(values)


def for_each(df: DataFrame, f: Callable) -> None:
    """f of each row, for its effects, on the executors; for streams see windows.to_batches()."""
    df.foreach(f)


def rows(df: DataFrame) -> DataFrame:
    """Each row as one struct."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def is_null(name: str) -> Column:
    return F.col(name).isNull()


def not_null(name: str) -> Column:
    return F.col(name).isNotNull()


def dtypes(df: DataFrame) -> list[tuple[str, str]]:
    return df.dtypes


def head(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)


def tail(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """The last n rows, in order."""
    return df.orderBy(*[F.col(o).desc() for o in order]).limit(n).orderBy(*order)


def select(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*names)


def drop(df: DataFrame, *names: str) -> DataFrame:
    """Unknown names are passed over."""
    return df.drop(*names)


def filter_(df: DataFrame, predicate: Column | str) -> DataFrame:
    return df.filter(predicate)


where = filter_


def filter_by_column(df: DataFrame, name: str, p: Callable[[Column], Column]) -> DataFrame:
    return df.filter(p(F.col(name)))


def with_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.withColumn(name, value)


add_column = with_column


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def sort(df: DataFrame, name: str, ascending: bool = True, by_text: bool = False) -> DataFrame:
    """By value, or by the printed value (where "10" comes before "9")."""
    key = F.col(name).cast("string") if by_text else F.col(name)
    return df.orderBy(key.asc() if ascending else key.desc())


def sort_by(df: DataFrame, names: list[str], ascending: list[bool] | bool = True) -> DataFrame:
    return df.orderBy(*names, ascending=ascending)


def row(df: DataFrame, i: int, position: str = POSITION) -> DataFrame:
    return df.filter(F.col(position) == i)


def describe(df: DataFrame) -> str:
    return f"DataFrame(columns=[{', '.join(df.columns)}], rows={df.count()})"


def summary(df: DataFrame, *names: str) -> DataFrame:
    """column, n, mean, sd, min, q1, median, q3, max of numeric columns, in one pass."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in names]
    long = df.select(F.explode(F.array(*cells)).alias("e")).select("e.*")
    q = F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return long.groupBy("column").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.min("x").alias("min"), q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3"), F.max("x").alias("max"))


def distinct(df: DataFrame) -> DataFrame:
    return df.distinct()


def distinct_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in this order, by an aggregate: no group is gathered in a task."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min(F.struct(*[F.col(o).alias(f"_{k}") for k, o in enumerate(order)], *[F.col(c) for c in rest])).alias("_f")
    return df.groupBy(*keys).agg(first).select(*[F.col(c) if c in keys else F.col(f"_f.{c}") for c in df.columns])


def unique(df: DataFrame, name: str, position: str = POSITION) -> DataFrame:
    """Distinct values in the order they come first."""
    return df.groupBy(name).agg(F.min(position).alias(position)).orderBy(position)


def value_counts(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(name).agg(F.count(F.lit(1)).alias("n"))


def drop_nulls(df: DataFrame, *names: str) -> DataFrame:
    return df.na.drop(subset=list(names) or None)


def fill_nulls(df: DataFrame, values: dict) -> DataFrame:
    return df.na.fill(values)


def sample(df: DataFrame, share: float, key: str, seed: int = 42) -> DataFrame:
    """The rows whose key's hash falls in the share: the same rows whatever the partitions."""
    return df.filter(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) < int(share * 1_000_000))


def group_agg(df: DataFrame, keys: list[str], aggregates: dict[str, tuple[str, str]], order: list[str] | None = None) -> DataFrame:
    """aggregates: name of the result -> (column, sum mean min max count std var median first last); first and last go by the order."""
    out = []
    for name, (column, kind) in aggregates.items():
        if kind in ("first", "last"):
            pick = F.min_by if kind == "first" else F.max_by
            out.append(pick(F.col(column), F.struct(*(order or []))).alias(name))
        else:
            out.append(AGGREGATES[kind](F.col(column)).alias(name))
    return df.groupBy(*keys).agg(*out)


def join(df: DataFrame, other: DataFrame, on, how: str = "inner") -> DataFrame:
    """how: inner, left, right, outer, semi, anti, cross."""
    if how == "cross":
        return df.crossJoin(other)
    return df.join(other, on, {"outer": "full", "semi": "left_semi", "anti": "left_anti"}.get(how, how))


def asof_join(left: DataFrame, right: DataFrame, by: list[str], time: str, values: list[str], suffix: str = "_asof") -> DataFrame:
    """left with the values of the last row of right, of the same keys, at or before its time.

    Both sides go into one table and the last values are carried forward, so that no pair of rows is made.
    """
    kept = [c for c in left.columns if c not in by and c != time]
    a = left.select(*by, time, F.struct(*[F.col(c) for c in kept]).alias("_l"), F.lit(None).cast(right.select(F.struct(*values).alias("s")).schema["s"].dataType).alias("_r"), F.lit(1).alias("_side"))
    b = right.select(*by, time, F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), F.struct(*values).alias("_r"), F.lit(0).alias("_side"))
    w = Window.partitionBy(*by).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_r", F.last("_r", ignorenulls=True).over(w)).filter("_side = 1")
    return both.select(*by, time, *[F.col(f"_l.{c}").alias(c) for c in kept], *[F.col(f"_r.{v}").alias(v + suffix) for v in values])


def concat(*dfs: DataFrame) -> DataFrame:
    """One below the other by name; columns that one lacks are null."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def pivot(df: DataFrame, index: list[str], column: str, value: str, kinds: list, aggregate: str = "sum") -> DataFrame:
    """A column for each of the named kinds."""
    return df.groupBy(*index).pivot(column, kinds).agg(AGGREGATES[aggregate](F.col(value)))


def melt(df: DataFrame, ids: list[str], values: list[str], name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(ids, values, name, value)


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark keeps at most k of a group in each task before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def to_list(df: DataFrame, name: str, order: list[str], by: list[str]) -> DataFrame:
    """The column's values of each group as a list in order."""
    packed = F.array_sort(F.collect_list(F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], F.col(name).alias("v"))))
    return df.groupBy(*by).agg(F.transform(packed, lambda s: s["v"]).alias(name))


def to_map(df: DataFrame) -> DataFrame:
    """Each row as a map from names to printed values."""
    return df.select(F.create_map(*[x for c in df.columns for x in (F.lit(c), F.col(c).cast("string"))]).alias("row"))


def apply(df: DataFrame, f: Callable[[Column], Column], *names: str) -> DataFrame:
    return df.withColumns({c: f(F.col(c)) for c in names})
