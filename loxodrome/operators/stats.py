"""Statistics: aggregate columns, and series computed over an order within groups.

A series function takes a DataFrame, the value's column, the order (columns) and the groups
(columns, maybe none). Without groups the whole table is one window partition, as the semantics of
a running series need; give groups wherever the data has them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loxodrome.functions import distributions
from loxodrome.session import use_scratch


def _d(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


# aggregates


def mean(c) -> Column:
    return F.avg(_d(c))


def series_mean(c) -> Column:
    """The sum of the numbers by the count of all cells, nil included; 0 of none."""
    n = F.count(F.lit(1))
    return F.when(n == 0, 0.0).otherwise(F.coalesce(F.sum(_d(c)), F.lit(0.0)) / F.greatest(n, F.lit(1)))


def series_sum(c) -> Column:
    return F.coalesce(F.sum(_d(c)), F.lit(0.0))


def median(c) -> Column:
    """As an aggregate, which holds a group's distinct values; quantiles() spreads them."""
    return F.median(_d(c))


def mode(c) -> Column:
    """The most frequent value, the smallest of several."""
    return F.mode(c, True)


def variance(c) -> Column:
    """Of the sample."""
    return F.var_samp(_d(c))


def stddev(c) -> Column:
    return F.stddev_samp(_d(c))


def percentile(c, p: float) -> Column:
    """p from 0 to 100, by linear interpolation; as an aggregate, see quantiles()."""
    return F.percentile(_d(c), p / 100)


def quartiles(c) -> Column:
    q = F.percentile(_d(c), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return F.struct(q[0].alias("q1"), q[1].alias("q2"), q[2].alias("q3"))


def iqr(c) -> Column:
    q = quartiles(c)
    return q["q3"] - q["q1"]


def stat_range(c) -> Column:
    return F.max(_d(c)) - F.min(_d(c))


def sem(c) -> Column:
    return F.stddev_samp(_d(c)) / F.sqrt(F.count(c))


def skewness(c) -> Column:
    """Of the population."""
    return F.skewness(_d(c))


def kurtosis(c) -> Column:
    """Excess, of the population."""
    return F.kurtosis(_d(c))


def product(c) -> Column:
    """1 of none."""
    return F.coalesce(F.product(_d(c)), F.lit(1.0))


def covariance(x, y) -> Column:
    return F.covar_samp(_d(x), _d(y))


def correlation(x, y) -> Column:
    """Pearson's; 0 where either side is constant."""
    flat = (F.var_pop(_d(x)) == 0) | (F.var_pop(_d(y)) == 0)
    return F.when(flat, 0.0).otherwise(F.covar_pop(_d(x), _d(y)) / F.nullif(F.stddev_pop(_d(x)) * F.stddev_pop(_d(y)), F.lit(0.0)))


def linreg(x, y) -> Column:
    """struct<slope, intercept, r2>; r2 is 0 where y is constant."""
    slope = F.regr_slope(_d(y), _d(x))
    return F.struct(slope.alias("slope"), F.regr_intercept(_d(y), _d(x)).alias("intercept"), F.when(F.var_pop(_d(y)) == 0, 0.0).otherwise(F.regr_r2(_d(y), _d(x))).alias("r2"))


def linear_regression(x, y) -> Column:
    """struct<slope, intercept, r_squared, std_err>; std_err is the root of the residuals' squares by n - 2."""
    sxx, syy, sxy, n = F.regr_sxx(_d(y), _d(x)), F.regr_syy(_d(y), _d(x)), F.regr_sxy(_d(y), _d(x)), F.regr_count(_d(y), _d(x))
    rest = F.greatest(syy - sxy * sxy / F.nullif(sxx, F.lit(0.0)), F.lit(0.0))
    line = linreg(x, y)
    return F.struct(line["slope"].alias("slope"), line["intercept"].alias("intercept"), line["r2"].alias("r_squared"), F.sqrt(rest / F.nullif(n - 2, F.lit(0))).alias("std_err"))


def weighted_mean(v, w) -> Column:
    return F.sum(_d(v) * _d(w)) / F.nullif(F.sum(_d(w)), F.lit(0.0))


def weighted_variance(v, w) -> Column:
    """With reliability weights."""
    sw, sww = F.sum(_d(w)), F.sum(_d(w) * _d(w))
    m = F.sum(_d(v) * _d(w)) / sw
    return (F.sum(_d(w) * _d(v) * _d(v)) - sw * m * m) / (sw - sww / sw)


def running(df: DataFrame, order: list[str], value, out: str) -> DataFrame:
    """df with the sum of value over each row and all rows before it in the order (rows of equal order share a task, in any order).

    Rows are dealt by ranges of the order and summed within each; the sums of the ranges before, one
    row for each partition, are added. No task sees all rows.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = kept(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    before = dealt.groupBy("_range").agg(F.sum(value).alias("_all")).withColumn("_before", F.sum("_all").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)))  # n rows
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = dealt.join(F.broadcast(before.select("_range", "_before")), "_range")
    return both.withColumn(out, F.sum(value).over(own) + F.coalesce("_before", F.lit(0))).drop("_range", "_before")


def kept(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the shared folder."""
    use_scratch(df.sparkSession)
    return df.checkpoint()


def quantiles(df: DataFrame, c: str, shares: list[float], by: list[str] = []) -> DataFrame:  # noqa: B006
    """by, q0, q1, ...: the values at these shares of each group, by linear interpolation, exactly; groups without values are left out.

    Values are counted first and then numbered by a running count over ranges, so neither a group nor
    its distinct values have to fit one task.
    """
    counts = df.filter(F.col(c).isNotNull()).groupBy(*by, _d(c).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    run = running(counts, [*by, "_v"], F.col("_n"), "_upto")
    total = run.groupBy(*by).agg(F.min(F.col("_upto") - F.col("_n")).alias("_start"), F.sum("_n").alias("_t"))
    both = _back(run, total, by)
    low, high = F.col("_upto") - F.col("_n") - F.col("_start"), F.col("_upto") - F.col("_start")
    at = lambda rank: F.max(F.when((low <= rank) & (rank < high), F.col("_v")))
    picks = []
    for i, p in enumerate(shares):
        goal = (F.col("_t") - 1) * F.lit(float(p))
        picks += [at(F.floor(goal)).alias(f"_a{i}"), at(F.ceil(goal)).alias(f"_b{i}"), F.max(goal - F.floor(goal)).alias(f"_f{i}")]
    found = both.groupBy(*by).agg(*picks)
    return found.select(*by, *[(F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * F.col(f"_f{i}")).alias(f"q{i}") for i in range(len(shares))])


def modes(df: DataFrame, c: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """by, mode: the most frequent value of each group, the smallest of several, from counts of values."""
    counts = df.filter(F.col(c).isNotNull()).groupBy(*by, F.col(c).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*by).agg(F.min_by("_v", F.struct(-F.col("_n"), F.col("_v"))).alias("mode"))


def trimmed_mean(df: DataFrame, c: str, share: float) -> DataFrame:
    """The mean without this share of the values at either end."""
    cut = quantiles(df, c, [share, 1 - share])
    return df.join(F.broadcast(cut), _d(c).between(F.col("q0"), F.col("q1"))).agg(F.avg(_d(c)).alias("trimmed_mean"))


def winsorized(df: DataFrame, c: str, share: float, out: str = "winsorized") -> DataFrame:
    """df with the values at either end drawn to the percentiles there."""
    cut = quantiles(df, c, [share, 1 - share]).select(F.col("q0").alias("_lo"), F.col("q1").alias("_hi"))
    return df.join(F.broadcast(cut)).withColumn(out, F.greatest(F.col("_lo"), F.least(F.col("_hi"), _d(c)))).drop("_lo", "_hi")


def outliers(df: DataFrame, c: str, k: float = 1.5) -> DataFrame:
    """The rows more than k interquartile ranges beyond the quartiles."""
    q = quantiles(df, c, [0.25, 0.75]).select(F.col("q0").alias("_q1"), F.col("q1").alias("_q3"))
    span = (F.col("_q3") - F.col("_q1")) * k
    return df.join(F.broadcast(q), (_d(c) < F.col("_q1") - span) | (_d(c) > F.col("_q3") + span)).drop("_q1", "_q3")


def confidence_interval(c, z: float = 1.959963984540054) -> Column:
    """struct<lo, hi> of the mean, by the normal distribution."""
    half = sem(c) * z
    return F.struct((F.avg(_d(c)) - half).alias("lo"), (F.avg(_d(c)) + half).alias("hi"))


def t_test(x, y) -> Column:
    """struct<t, df>: Welch's test of the means of two columns."""
    nx, ny, vx, vy = F.count(x), F.count(y), F.var_samp(_d(x)), F.var_samp(_d(y))
    a, b = vx / nx, vy / ny
    return F.struct(((F.avg(_d(x)) - F.avg(_d(y))) / F.sqrt(a + b)).alias("t"), ((a + b) * (a + b) / (a * a / (nx - 1) + b * b / (ny - 1))).alias("df"))


def paired_t_test(x, y) -> Column:
    """struct<t, df> of the mean difference of two columns."""
    return one_sample_t_test(_d(x) - _d(y), 0.0)


def one_sample_t_test(x, mean: float) -> Column:
    """struct<t, df>: whether the mean is this one."""
    n = F.count(_d(x))
    return F.struct(((F.avg(_d(x)) - mean) / (F.stddev_samp(_d(x)) / F.sqrt(n))).alias("t"), (n - 1).cast("double").alias("df"))


def with_p_value(test: Column) -> Column:
    """struct<t, df> with the chance of a statistic at least as far from 0."""
    return F.struct(test["t"].alias("statistic"), (2 * (1 - distributions.t(test["df"]).cdf(F.abs(test["t"])))).alias("p_value"), test["df"].alias("degrees_of_freedom"))


def anova(df: DataFrame, c: str, group: str) -> DataFrame:
    """statistic, p_value, df1, df2 of the analysis of variance between the groups, from their counts, means and variances."""
    g = df.filter(F.col(c).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(_d(c)).alias("m"), F.var_pop(_d(c)).alias("v"))
    all_ = g.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("groups"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"))
    parts = g.join(F.broadcast(all_)).agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("mean"), 2.0)).alias("between"), F.sum(F.col("n") * F.col("v")).alias("within"), F.first("rows").alias("rows"), F.first("groups").alias("groups"))
    one, two = F.col("groups") - 1, F.col("rows") - F.col("groups")
    stat = parts.select(((F.col("between") / one) / (F.col("within") / two)).alias("statistic"), one.alias("df1"), two.alias("df2"))
    return stat.select("statistic", (1 - distributions.f(F.col("df1"), F.col("df2")).cdf(F.col("statistic"))).alias("p_value"), "df1", "df2")


def chi_square_test(df: DataFrame, observed: str, expected: str) -> DataFrame:
    """statistic, p_value, degrees_of_freedom of observed against expected counts, a row each."""
    stat = df.agg(F.sum(F.pow(_d(observed) - _d(expected), 2.0) / _d(expected)).alias("statistic"), (F.count(F.lit(1)) - 1).alias("degrees_of_freedom"))
    return stat.select("statistic", (1 - distributions.chisquare(F.col("degrees_of_freedom")).cdf(F.col("statistic"))).alias("p_value"), "degrees_of_freedom")


def ks_test(df: DataFrame, c: str, dist: distributions.Distribution) -> DataFrame:
    """statistic, p_value (of the limiting distribution), n: the greatest distance of the values' shares from the distribution."""
    counts = df.filter(F.col(c).isNotNull()).groupBy(_d(c).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    run = running(counts, ["_v"], F.col("_n"), "_upto").withColumn("_f", dist.cdf(F.col("_v")))
    run = run.join(F.broadcast(counts.agg(F.sum("_n").alias("_t"))))
    off = F.greatest(F.abs(F.col("_upto") / F.col("_t") - F.col("_f")), F.abs((F.col("_upto") - F.col("_n")) / F.col("_t") - F.col("_f")))
    found = run.agg(F.max(off).alias("statistic"), F.first("_t").alias("n"))
    z = F.col("statistic") * F.sqrt("n")
    p = sum((F.lit(2.0 * (-1) ** (k - 1)) * F.exp(-2.0 * k * k * z * z) for k in range(1, 101)), F.lit(0.0))
    return found.select("statistic", F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("p_value"), "n")


def bootstrap_ci(df: DataFrame, c: str, key: str, resamples: int = 200, level: float = 0.95, seed: int = 42) -> DataFrame:
    """lo, hi: percentiles of the means of resamples, in each of which a row counts as often as a Poisson number of mean 1, drawn by the hash of its key, says.

    One pass, in which each row is dealt to all resamples and summed by them where it is; nothing is collected but a mean for each resample, or sampled.
    """
    shares, total = [], 0.0
    for k in range(9):
        total += math.exp(-1) / math.factorial(k)
        shares.append(total)

    weight = F.lit(len(shares))
    for k in reversed(range(len(shares))):
        weight = F.when(F.col("u") < shares[k], k).otherwise(weight)
    known = df.filter(F.col(c).isNotNull()).select(_d(c).alias("v"), F.col(key).alias("k"))
    drawn = known.select("v", "k", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("i")).select("v", "i", (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "i", "k"), 11) / F.lit(float(1 << 53))).alias("u"))
    means = drawn.select("v", "i", weight.alias("w")).groupBy("i").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("m"))
    ordered = means.agg(F.array_sort(F.collect_list("m")).alias("m"))  # a row for each resample
    edge = (1 - level) / 2
    at = lambda share: F.get("m", F.lit(min(resamples - 1, max(0, round(share * (resamples - 1))))))
    return ordered.select(at(edge).alias("lo"), at(1 - edge).alias("hi"))


def predicted(model: Column, x) -> Column:
    """The value of a fitted line (struct with slope and intercept)."""
    return model["slope"] * _d(x) + model["intercept"]


# series


def _w(order: list[str], by: list[str]) -> Window:
    return Window.partitionBy(*by).orderBy(*order) if by else Window.partitionBy(F.lit(0)).orderBy(*order)


def _g(by: list[str]) -> Window:
    return Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))


def zscore(df: DataFrame, c: str, by: list[str] = [], out: str = "z") -> DataFrame:  # noqa: B006
    """0 where there is no spread. Grouped statistics are joined back, so no group has to fit one task."""
    stat = df.groupBy(*by).agg(F.avg(_d(c)).alias("_m"), F.stddev_samp(_d(c)).alias("_s"))
    return _back(df, stat, by).withColumn(out, F.when(F.coalesce("_s", F.lit(0.0)) == 0, 0.0).otherwise((_d(c) - F.col("_m")) / F.nullif("_s", F.lit(0.0)))).drop("_m", "_s")


standardize = zscore


def _back(df: DataFrame, stat: DataFrame, by: list[str]) -> DataFrame:
    """df joined with statistics of its groups; null groups meet each other."""
    if not by:
        return df.join(F.broadcast(stat))  # one row
    names = {b: f"_by_{b}" for b in by}
    stat = stat.withColumnsRenamed(names)
    on = None
    for b, n in names.items():
        one = F.col(b).eqNullSafe(F.col(n))
        on = one if on is None else on & one
    return df.join(stat, on).drop(*names.values())


def min_max_scale(df: DataFrame, c: str, lo: float = 0.0, hi: float = 1.0, by: list[str] = [], out: str = "scaled") -> DataFrame:  # noqa: B006
    """lo where there is no range."""
    stat = df.groupBy(*by).agg(F.min(_d(c)).alias("_a"), F.max(_d(c)).alias("_b"))
    span = F.col("_b") - F.col("_a")
    return _back(df, stat, by).withColumn(out, F.when(span == 0, float(lo)).otherwise(lo + (_d(c) - F.col("_a")) / F.nullif(span, F.lit(0.0)) * (hi - lo))).drop("_a", "_b")


def moving_mean(df: DataFrame, c: str, size: int, order: list[str], by: list[str] = [], out: str = "moving_mean") -> DataFrame:  # noqa: B006
    """Full windows only."""
    w = _w(order, by)
    return df.withColumn(out, F.avg(_d(c)).over(w.rowsBetween(-(size - 1), 0))).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") >= size).drop("_n")


def moving_std(df: DataFrame, c: str, size: int, order: list[str], by: list[str] = [], out: str = "moving_std") -> DataFrame:  # noqa: B006
    w = _w(order, by)
    return df.withColumn(out, F.stddev_samp(_d(c)).over(w.rowsBetween(-(size - 1), 0))).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") >= size).drop("_n")


def scan_sum(df: DataFrame, c: str, order: list[str], by: list[str] = [], out: str = "running") -> DataFrame:  # noqa: B006
    return df.withColumn(out, F.sum(_d(c)).over(_w(order, by).rowsBetween(Window.unboundedPreceding, 0)))


def autocorr(df: DataFrame, c: str, lag: int, order: list[str], by: list[str] = []) -> DataFrame:  # noqa: B006
    """The biased autocorrelation of each group; 0 of a constant series."""
    m = F.avg(_d(c)).over(_g(by))
    part = df.select(*by, (_d(c) - m).alias("_x"), (F.lag(_d(c), lag).over(_w(order, by)) - m).alias("_y"))
    total = F.sum(F.col("_x") * F.col("_x"))
    return part.groupBy(*by).agg(F.when(total == 0, 0.0).otherwise(F.coalesce(F.sum(F.col("_x") * F.col("_y")), F.lit(0.0)) / F.nullif(total, F.lit(0.0))).alias("autocorr"))


def ewma(df: DataFrame, c: str, alpha: float, order: list[str], by: list[str]) -> DataFrame:
    """by, position, value, ewma: e[i] = alpha x[i] + (1 - alpha) e[i - 1], from e[0] = x[0]; null values are left out.

    A running sum of alpha x[k] / w**k, with w = 1 - alpha, gives the recurrence without one; it starts
    anew every ``block`` rows, after which w**block is below what a double can tell, so that the end of
    the block before is all that has to be carried.
    """
    w = 1 - alpha
    block = max(2, math.ceil(math.log(1e-18) / math.log(w))) if 0 < w < 1 else 2
    ordered = _w(order, by)
    each = df.filter(F.col(c).isNotNull()).select(*by, *[F.col(o) for o in order if o not in by], _d(c).alias("value")).withColumn("position", F.row_number().over(ordered) - 1)
    j = F.col("position") % block
    each = each.withColumn("_b", F.floor(F.col("position") / block)).withColumn("_j", j.cast("double"))
    term = F.when(F.col("position") == 0, F.col("value")).otherwise(F.col("value") * alpha)
    own = Window.partitionBy(*by, "_b").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("_l", F.pow(F.lit(float(w)), F.col("_j")) * F.sum(term * F.pow(F.lit(float(w)), -F.col("_j"))).over(own))
    line = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    end = F.last(F.when(F.col("_j") == block - 1, F.col("_l")), ignorenulls=True).over(line)
    return each.withColumn("_e", end).select(*by, F.col("position").cast("int").alias("position"), "value", (F.col("_l") + F.coalesce(F.pow(F.lit(float(w)), F.col("_j") + 1) * F.col("_e"), F.lit(0.0))).alias("ewma"))


def average_rank(df: DataFrame, c: str, out: str) -> DataFrame:
    """Ties share the mean of their ranks, which come from a running count over the distinct values."""
    upto = running(df.groupBy(c).agg(F.count(F.lit(1)).alias("_n")), [c], F.col("_n"), "_upto")
    return df.join(upto.select(F.col(c).alias("_v"), (F.col("_upto") - (F.col("_n") - 1) / 2).alias(out)), F.col(c).eqNullSafe(F.col("_v"))).drop("_v")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    ranked = average_rank(average_rank(df.select(x, y), x, "_rx"), y, "_ry")
    return ranked.agg(correlation("_rx", "_ry").alias("spearman"))


def kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """Kendall's tau-a, without pairs: at each bit of the x values' dense ranks, two values whose higher bits agree are in order by that bit, and running counts in the order of y tell how many of the one lie below and above the other.

    The table grows by the number of bits only, and no task sees more than its range of it.
    """
    n = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    n = kept(n)
    ranks = running(n.select("x").distinct(), ["x"], F.lit(1), "r").select("x", (F.col("r") - 1).alias("r"))
    ranks = kept(ranks)
    bits = int(ranks.agg(F.max("r")).first()[0] or 0).bit_length()
    total = n.agg(F.sum("n").alias("t"))
    levels = n.join(ranks, "x").select("y", "n", "r", F.explode(F.sequence(F.lit(0), F.lit(max(bits - 1, 0)))).alias("level"))
    by = levels.select("level", F.expr("shiftright(r, level + 1)").alias("prefix"), F.expr("shiftright(r, level) % 2").alias("bit"), "y", "n")
    spots = by.groupBy("level", "prefix", "y").agg(F.sum(F.when(F.col("bit") == 0, F.col("n")).otherwise(0)).alias("zero"), F.sum(F.when(F.col("bit") == 1, F.col("n")).otherwise(0)).alias("one"))
    run = running(spots, ["level", "prefix", "y"], F.col("zero"), "upto")
    group = run.groupBy("level", "prefix").agg(F.min(F.col("upto") - F.col("zero")).alias("start"), F.sum("zero").alias("zeros"))
    below = F.col("upto") - F.col("zero") - F.col("start")
    score = F.sum(F.col("one") * (below - (F.col("zeros") - below - F.col("zero"))))
    return run.join(group, ["level", "prefix"]).agg(score.cast("double").alias("s")).join(F.broadcast(total)).select((F.coalesce("s", F.lit(0.0)) / (F.col("t") * (F.col("t") - 1) / 2)).alias("kendall"))
