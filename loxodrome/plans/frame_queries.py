"""Queries over whole tables: DataFrame verbs, statistics, joins, set operations and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from loxodrome.functions import distributions, sets
from loxodrome.operators import frame, stats
from loxodrome.plans.base import Registry, real, table

REGISTRY = Registry()
query = REGISTRY.query


@query("""
select l_returnflag, l_linestatus, round(sum(l_quantity), 4) as sum_qty,
       round(avg(l_extendedprice), 4) as mean_price,
       round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) as weighted_price,
       round(stddev_samp(l_quantity), 6) as sd_qty, count(*) as n
from lineitem where l_shipdate <= timestamp '1998-09-02' group by all
""")
def group_agg(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 4).alias("sum_qty"),
        F.round(F.avg("l_extendedprice"), 4).alias("mean_price"),
        F.round(F.sum(F.col("l_extendedprice") * F.col("l_quantity")) / F.sum("l_quantity"), 4).alias("weighted_price"),
        F.round(F.stddev_samp("l_quantity"), 6).alias("sd_qty"),
        F.count(F.lit(1)).alias("n"),
    )


@query("select l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) as net from lineitem where l_quantity > 45 and l_returnflag = 'R'")
def df_filter_select(spark, sf_dir):
    li = frame.filter_(table(spark, sf_dir, "lineitem"), (F.col("l_quantity") > 45) & (F.col("l_returnflag") == "R"))
    return frame.select(frame.with_column(li, "net", F.col("l_extendedprice") * (1 - F.col("l_discount"))), "l_orderkey", "l_linenumber", "net")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20")
def df_sort_head(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return frame.sort_by(orders, ["o_totalprice", "o_orderkey"], [False, True]).limit(20)


@query("select o_orderkey, o_custkey from (select * from orders order by o_orderkey desc limit 7) order by o_orderkey")
def df_tail(spark, sf_dir):
    return frame.tail(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], 7)


@query("select c_custkey from customer order by cast(c_custkey as varchar), c_custkey limit 25")
def df_sort_by_text(spark, sf_dir):
    return frame.sort(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", by_text=True).limit(25)


@query("select count(*) as rows, 5 as cols from customer")
def df_shape(spark, sf_dir):
    return frame.shape(table(spark, sf_dir, "customer"))


@query("select * from part where p_partkey = 17")
def df_row(spark, sf_dir):
    return frame.row(table(spark, sf_dir, "part"), 17, "p_partkey")


@query("select o_custkey, o_orderkey, o_totalprice, rank from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders) where rank <= 3")
def top_k_by_group(spark, sf_dir):
    return frame.top_k(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)


@query("select event_type, count(*) as length, round(coalesce(sum(value), 0), 4) as sum, round(coalesce(sum(value), 0) / count(*), 6) as mean, min(value) as min, max(value) as max, count(value) as count from events group by event_type")
def series_stats(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("length"), F.round(stats.series_sum("value"), 4).alias("sum"), F.round(stats.series_mean("value"), 6).alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("count")
    )


@query("""
select event_id, coalesce(case when value < 20 then null else value end, -1) as filled from events
where (case when event_id % 7 = 0 then null else user_id end) is not null
""")
def fill_drop_nil(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("value") >= 20, F.col("value")).alias("filled"), F.when(F.col("event_id") % 7 != 0, F.col("user_id")).alias("u"))
    return frame.fill_nulls(frame.drop_nulls(e, "u"), {"filled": -1.0}).drop("u")


@query("select p_type, min(p_partkey) as p_partkey from part group by p_type")
def unique(spark, sf_dir):
    return frame.unique(table(spark, sf_dir, "part"), "p_type", "p_partkey")


@query("select p_brand, p_partkey, p_size from (select *, row_number() over (partition by p_brand order by p_size, p_partkey) as r from part) where r = 1")
def distinct_by(spark, sf_dir):
    return frame.distinct_by(table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size"), ["p_brand"], ["p_size", "p_partkey"])


@query("select p_brand, count(*) as n from part group by p_brand")
def value_counts(spark, sf_dir):
    return frame.value_counts(table(spark, sf_dir, "part"), "p_brand")


@query("select distinct l_returnflag, l_linestatus from lineitem")
def distinct(spark, sf_dir):
    return frame.distinct(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus"))


@query("""
select o_custkey, sum(o_totalprice) as total, count(o_orderkey) as n, arg_min(o_orderkey, (o_orderdate, o_orderkey)) as first_order, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as last_order
from orders group by o_custkey
""")
def group_agg_first_last(spark, sf_dir):
    return frame.group_agg(table(spark, sf_dir, "orders"), ["o_custkey"], {"total": ("o_totalprice", "sum"), "n": ("o_orderkey", "count"), "first_order": ("o_orderkey", "first"), "last_order": ("o_orderkey", "last")}, ["o_orderdate", "o_orderkey"])


@query("select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as q from lineitem group by cube (l_returnflag, l_linestatus)")
def cube(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query("select p_brand, p_type, count(*) as n from part group by rollup (p_brand, p_type)")
def rollup(spark, sf_dir):
    return table(spark, sf_dir, "part").rollup("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))


@query("select l_returnflag, l_linestatus, count(*) as n from lineitem group by grouping sets ((l_returnflag), (l_linestatus), ())")
def grouping_sets(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupingSets([[F.col("l_returnflag")], [F.col("l_linestatus")], []], "l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


def _join(how, sql):
    def run(spark, sf_dir):
        c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
        o = table(spark, sf_dir, "orders").select((F.col("o_custkey") * 2).alias("c_custkey"), "o_orderkey")
        found = frame.join(c, o, "c_custkey", how)
        return found.na.fill({"o_orderkey": -1}) if "o_orderkey" in found.columns else found

    run.__name__ = f"join_{how}"
    return query(sql)(run)


_SIDES = "from (select c_custkey, c_name from customer) c {} join (select o_custkey * 2 as c_custkey, o_orderkey from orders) o using (c_custkey)"
for _how, _sql in {"inner": "inner", "left": "left", "right": "right", "outer": "full", "semi": "semi", "anti": "anti"}.items():
    _join(_how, ("select c_custkey, c_name " if _how in ("semi", "anti") else "select c_custkey, c_name, coalesce(o_orderkey, -1) as o_orderkey ") + _SIDES.format(_sql))


@query("select n_name, r_name from nation, region")
def join_cross(spark, sf_dir):
    return frame.join(table(spark, sf_dir, "nation").select("n_name"), table(spark, sf_dir, "region").select("r_name"), None, "cross")


@query("""
select n_name, count(*) as n, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
group by n_name
""")
def join_three(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""
select a.user_id, a.ts, a.event_id, b.value as value_asof from (select user_id, ts, event_id from events where event_type = 'purchase') a
asof left join (select user_id, ts, max(value) as value from events where event_type <> 'purchase' group by user_id, ts) b on a.user_id = b.user_id and a.ts >= b.ts
""")
def asof(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    right = e.filter("event_type <> 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return frame.asof_join(e.filter("event_type = 'purchase'").select("user_id", "ts", "event_id"), right, ["user_id"], "ts", ["value"])


@query("select c_nationkey as k from customer where c_acctbal > 5000 union select s_nationkey from supplier where s_acctbal < 2000")
def union(spark, sf_dir):
    return sets.union_rows(*_keys(spark, sf_dir))


@query("select c_nationkey as k from customer where c_acctbal > 5000 intersect select s_nationkey from supplier where s_acctbal < 2000")
def intersect(spark, sf_dir):
    return sets.intersection_rows(*_keys(spark, sf_dir))


@query("select c_nationkey as k from customer where c_acctbal > 5000 except select s_nationkey from supplier where s_acctbal < 2000")
def except_(spark, sf_dir):
    return sets.difference_rows(*_keys(spark, sf_dir))


@query("""
(select c_nationkey as k from customer where c_acctbal > 5000 except select s_nationkey from supplier where s_acctbal < 2000)
union all (select s_nationkey from supplier where s_acctbal < 2000 except select c_nationkey from customer where c_acctbal > 5000)
""")
def symdiff(spark, sf_dir):
    return sets.symmetric_difference_rows(*_keys(spark, sf_dir))


def _keys(spark, sf_dir):
    return (table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").filter("s_acctbal < 2000").select(F.col("s_nationkey").alias("k")))


@query("select c_custkey as id, c_name as name, null as price from customer union all select p_partkey, p_name, p_retailprice from part")
def concat(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return frame.concat(a, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price")))


@query("""
select l_returnflag, round(sum(case when l_linestatus = 'O' then l_quantity end), 2) as "O", round(sum(case when l_linestatus = 'F' then l_quantity end), 2) as "F"
from lineitem group by l_returnflag
""")
def pivot(spark, sf_dir):
    out = frame.pivot(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_linestatus", "l_quantity", ["O", "F"])
    return out.select("l_returnflag", F.round("O", 2).alias("O"), F.round("F", 2).alias("F"))


@query("""
select l_orderkey, l_linenumber, 'l_discount' as variable, l_discount as value from lineitem
union all select l_orderkey, l_linenumber, 'l_tax', l_tax from lineitem
""")
def melt(spark, sf_dir):
    return frame.melt(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"])


@query("""
select 'l_quantity' as "column", count(l_quantity) as n, round(avg(l_quantity), 6) as mean, round(stddev_samp(l_quantity), 6) as sd, min(l_quantity) as min,
  quantile_cont(l_quantity, 0.25) as q1, quantile_cont(l_quantity, 0.5) as median, quantile_cont(l_quantity, 0.75) as q3, max(l_quantity) as max from lineitem
union all select 'l_tax', count(l_tax), round(avg(l_tax), 6), round(stddev_samp(l_tax), 6), min(l_tax), quantile_cont(l_tax, 0.25), quantile_cont(l_tax, 0.5), quantile_cont(l_tax, 0.75), max(l_tax) from lineitem
""")
def describe(spark, sf_dir):
    out = frame.summary(table(spark, sf_dir, "lineitem"), "l_quantity", "l_tax")
    return out.withColumn("mean", F.round("mean", 6)).withColumn("sd", F.round("sd", 6))


@query("select o_custkey, list(o_orderkey order by o_orderdate, o_orderkey) as o_orderkey from orders group by o_custkey")
def to_list(spark, sf_dir):
    return frame.to_list(table(spark, sf_dir, "orders"), "o_orderkey", ["o_orderdate", "o_orderkey"], ["o_custkey"])


# statistics


@query("""
select l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) as wm,
  round((sum(l_quantity * l_extendedprice * l_extendedprice) - sum(l_quantity) * pow(sum(l_quantity * l_extendedprice) / sum(l_quantity), 2)) / (sum(l_quantity) - sum(l_quantity * l_quantity) / sum(l_quantity)) / 1e6, 4) as wv
from lineitem group by l_returnflag
""")
def weighted(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(stats.weighted_mean("l_extendedprice", "l_quantity"), 4).alias("wm"), F.round(stats.weighted_variance("l_extendedprice", "l_quantity") / F.lit(1e6), 4).alias("wv"))


@query("""
select l_returnflag, quantile_cont(l_extendedprice, 0.1) as p10, median(l_extendedprice) as med, quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) as iqr,
  quantile_cont(l_quantity, 0.25) as q1, quantile_cont(l_quantity, 0.5) as q2, quantile_cont(l_quantity, 0.75) as q3, max(l_quantity) - min(l_quantity) as range
from lineitem group by l_returnflag
""")
def percentiles(spark, sf_dir):
    li, by = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice", "l_quantity"), ["l_returnflag"]
    price = stats.quantiles(li, "l_extendedprice", [0.1, 0.5, 0.25, 0.75], by).select(*by, F.col("q0").alias("p10"), F.col("q1").alias("med"), (F.col("q3") - F.col("q2")).alias("iqr"))
    quantity = stats.quantiles(li, "l_quantity", [0.25, 0.5, 0.75], by).select(*by, F.col("q0").alias("q1"), F.col("q1").alias("q2"), F.col("q2").alias("q3"))
    return price.join(quantity, by).join(li.groupBy(*by).agg(stats.stat_range("l_quantity").alias("range")), by)


@query("""
select o_custkey, round(quantile_cont(o_totalprice, 0.1), 4) as p10, round(median(o_totalprice), 4) as med, round(quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25), 4) as iqr, round(quantile_cont(o_totalprice, 0.25), 4) as q1, round(quantile_cont(o_totalprice, 0.5), 4) as q2,
  round(quantile_cont(o_totalprice, 0.75), 4) as q3 from orders group by o_custkey
""")
def percentile_aggregates(spark, sf_dir):
    """As aggregates, for groups whose values fit a task."""
    q, r = stats.quartiles("o_totalprice"), lambda c: F.round(c, 4)
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(r(stats.percentile("o_totalprice", 10)).alias("p10"), r(stats.median("o_totalprice")).alias("med"), r(stats.iqr("o_totalprice")).alias("iqr"), r(q["q1"]).alias("q1"), r(q["q2"]).alias("q2"), r(q["q3"]).alias("q3"))


@query("select p_brand, p_size as mode from (select p_brand, p_size, row_number() over (partition by p_brand order by count(*) desc, p_size) as r from part group by p_brand, p_size) where r = 1")
def mode(spark, sf_dir):
    return stats.modes(table(spark, sf_dir, "part"), "p_size", ["p_brand"])


@query("select p_type, p_size as mode from (select p_type, p_size, row_number() over (partition by p_type order by count(*) desc, p_size) as r from part group by p_type, p_size) where r = 1")
def mode_aggregate(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_type").agg(stats.mode("p_size").alias("mode"))


@query("""
with m as (select l_returnflag as k, avg(l_quantity) as m from lineitem group by 1),
d as (select k, l_quantity - m as d from lineitem join m on k = l_returnflag)
select k, round(avg(pow(d, 3)) / pow(avg(d * d), 1.5), 6) as skew, round(avg(pow(d, 4)) / pow(avg(d * d), 2) - 3, 6) as kurt, round(sqrt(sum(d * d) / (count(*) - 1)) / sqrt(count(*)), 8) as sem from d group by k
""")
def skew_kurt(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("k")).agg(F.round(stats.skewness("l_quantity"), 6).alias("skew"), F.round(stats.kurtosis("l_quantity"), 6).alias("kurt"), F.round(stats.sem("l_quantity"), 8).alias("sem"))


@query("""
select l_linestatus, round(corr(l_quantity, l_extendedprice), 8) as corr, round(covar_samp(l_quantity, l_extendedprice), 2) as cov, round(regr_slope(l_extendedprice, l_quantity), 4) as slope,
  round(regr_intercept(l_extendedprice, l_quantity), 2) as intercept, round(regr_r2(l_extendedprice, l_quantity), 8) as r2,
  round(sqrt((regr_syy(l_extendedprice, l_quantity) - pow(regr_sxy(l_extendedprice, l_quantity), 2) / regr_sxx(l_extendedprice, l_quantity)) / (count(*) - 2)), 2) as std_err
from lineitem group by l_linestatus
""")
def corr_linreg(spark, sf_dir):
    r = stats.linear_regression("l_quantity", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(
        F.round(stats.correlation("l_quantity", "l_extendedprice"), 8).alias("corr"), F.round(stats.covariance("l_quantity", "l_extendedprice"), 2).alias("cov"), F.round(r["slope"], 4).alias("slope"), F.round(r["intercept"], 2).alias("intercept"), F.round(r["r_squared"], 8).alias("r2"), F.round(r["std_err"], 2).alias("std_err")
    )


@query("select event_id, coalesce(round((value - avg(value) over w) / nullif(stddev_samp(value) over w, 0), 6), 0) as z from events window w as (partition by user_id)")
def zscore(spark, sf_dir):
    return stats.zscore(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), "value", ["user_id"]).select("event_id", F.round("z", 6).alias("z"))


@query("select event_id, round(case when max(value) over w = min(value) over w then 0 else (value - min(value) over w) / (max(value) over w - min(value) over w) end, 6) as scaled from events window w as (partition by event_type)")
def minmax(spark, sf_dir):
    return stats.min_max_scale(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), "value", by=["event_type"]).select("event_id", F.round("scaled", 6).alias("scaled"))


@query("""
select event_id, round(avg(value) over w, 6) as moving_mean, round(stddev_samp(value) over w, 6) as moving_std from events
window w as (partition by user_id order by event_id rows between 4 preceding and current row) qualify row_number() over (partition by user_id order by event_id) >= 5
""")
def moving(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    both = stats.moving_std(e, "value", 5, ["event_id"], ["user_id"]).select("event_id", F.round("moving_std", 6).alias("moving_std"))
    return stats.moving_mean(e, "value", 5, ["event_id"], ["user_id"]).select("event_id", F.round("moving_mean", 6).alias("moving_mean")).join(both, "event_id")


@query("select event_id, round(sum(value) over (partition by user_id order by event_id rows unbounded preceding), 4) as running from events")
def scan(spark, sf_dir):
    return stats.scan_sum(table(spark, sf_dir, "events"), "value", ["event_id"], ["user_id"]).select("event_id", F.round("running", 4).alias("running"))


@query("""
with d as (select user_id, event_id, value - avg(value) over (partition by user_id) as x from events),
l as (select user_id, x, lag(x, 2) over (partition by user_id order by event_id) as y from d)
select user_id, round(case when sum(x * x) = 0 then 0 else coalesce(sum(x * y), 0) / sum(x * x) end, 6) as autocorr from l group by user_id
""")
def autocorr(spark, sf_dir):
    out = stats.autocorr(table(spark, sf_dir, "events"), "value", 2, ["event_id"], ["user_id"])
    return out.select("user_id", F.round("autocorr", 6).alias("autocorr"))


@query("""
with recursive s as (select user_id, value, row_number() over (partition by user_id order by event_id) - 1 as i from events),
e(user_id, i, value, ewma) as (select user_id, i, value, value from s where i = 0 union all select s.user_id, s.i, s.value, 0.3 * s.value + (1 - 0.3) * e.ewma from e join s on s.user_id = e.user_id and s.i = e.i + 1)
select user_id, cast(i as integer) as position, value, round(1.3e-8 + ewma, 6) as ewma from e
""")
def ewma(spark, sf_dir):
    return stats.ewma(table(spark, sf_dir, "events"), "value", 0.3, ["event_id"], ["user_id"]).withColumn("ewma", F.round(F.lit(1.3e-8) + F.col("ewma"), 6))


@query("""
with r as (select rank() over (order by p_size) + (count(*) over (partition by p_size) - 1) / 2 as a, rank() over (order by p_retailprice) + (count(*) over (partition by p_retailprice) - 1) / 2 as b from part)
select round(corr(a, b), 8) as spearman from r
""")
def spearman(spark, sf_dir):
    return stats.spearman(table(spark, sf_dir, "part"), "p_size", "p_retailprice").select(F.round("spearman", 8).alias("spearman"))


@query("""
with p as (select p_size as x, length(p_name) as y from part),
s as (select sum(sign(b.y - a.y)) as s from p a join p b on a.x < b.x)
select round(s / ((select count(*) from p) * ((select count(*) from p) - 1) / 2), 8) as kendall from s
""")
def kendall(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_size").alias("x"), F.length("p_name").alias("y"))
    return stats.kendall(p, "x", "y").select(F.round("kendall", 8).alias("kendall"))


@query("select p_partkey from part, (select quantile_cont(p_retailprice, 0.25) as a, quantile_cont(p_retailprice, 0.75) as b from part) where p_retailprice < a - 0.2 * (b - a) or p_retailprice > b + 0.2 * (b - a)")
def outliers(spark, sf_dir):
    return stats.outliers(table(spark, sf_dir, "part"), "p_retailprice", 0.2).select("p_partkey")


@query("select round(avg(p_retailprice), 6) as trimmed_mean from part, (select quantile_cont(p_retailprice, 0.1) as a, quantile_cont(p_retailprice, 0.9) as b from part) where p_retailprice between a and b")
def trimmed_mean(spark, sf_dir):
    return stats.trimmed_mean(table(spark, sf_dir, "part"), "p_retailprice", 0.1).select(F.round("trimmed_mean", 6).alias("trimmed_mean"))


# frames: sources, shapes and rows


@query("select o_orderkey, o_custkey from orders order by o_orderkey limit 9")
def df_head(spark, sf_dir):
    return frame.head(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], 9)


@query("select c_custkey, c_nationkey, c_acctbal as balance, c_mktsegment, c_acctbal * 2 as twice from customer where c_acctbal > 0 and c_nationkey < 20")
def df_verbs(spark, sf_dir):
    c = frame.drop(table(spark, sf_dir, "customer"), "c_name", "nothing")
    c = frame.where(frame.filter_by_column(c, "c_acctbal", lambda x: x > 0), "c_nationkey < 20")
    return frame.add_column(frame.rename(c, {"c_acctbal": "balance"}), "twice", F.col("balance") * 2)


@query("""
select 'DataFrame(columns=[c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment], rows=' || count(*) || ')' as describe, count(*) as row_count, 'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment' as columns, 'bigint,string,int,double,string' as dtypes from customer
""")
def df_shapes(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    row = (frame.describe(c), frame.row_count(c), ",".join(frame.columns(c)), ",".join(t for _, t in frame.dtypes(c)))
    return spark.createDataFrame([row], "describe string, row_count bigint, columns string, dtypes string")


@query("""
select 0 as _pos, 'a' as idx, 1 as value, 'map' as source union all select 1, 'b', 2, 'map' union all select 0, '0', 7, 'list' union all select 1, '1', 8, 'list' union all select 0, 'x', 5, 'columns' union all select 1, 'y', 6, 'columns'
union all select 0, 'r', 1, 'rows' union all select 1, null, 2, 'rows' union all select -1, 'value', 3, 'name'
""")
def df_sources(spark, sf_dir):
    """Frames and series made of the caller's own values."""
    made = frame.series_from_map(spark, {"b": 2, "a": 1}).withColumn("source", F.lit("map"))
    made = made.unionByName(frame.series(spark, [7, 8]).withColumn("source", F.lit("list")))
    made = made.unionByName(frame.from_columns(spark, {"idx": ["x", "y"], "value": [5, 6]}).withColumn("source", F.lit("columns")))
    rows = frame.from_rows(spark, [{"_pos": 0, "idx": "r", "value": 1}, {"_pos": 1, "value": 2}]).withColumn("source", F.lit("rows"))
    named = frame.map_series(frame.series(spark, [2]), lambda v: v + 1).select(F.lit(-1).alias("_pos"), F.lit(frame.series_name(made.select("_pos", "idx", "value"))).alias("idx"), "value", F.lit("name").alias("source"))
    return made.unionByName(rows).unionByName(named).unionByName(frame.empty(spark, "_pos bigint, idx string, value bigint, source string"))


@query("""
select p_partkey, upper(p_brand) as p_brand, upper(p_type) as p_type, 'p_size=' || p_size || ',p_retailprice=' || (p_retailprice > 0) as row, p_size > 25 as is_null, p_size <= 25 as not_null, p_size * 2 as mapped from part
""")
def df_rows(spark, sf_dir):
    p = frame.apply(table(spark, sf_dir, "part"), F.upper, "p_brand", "p_type")
    small = p.select("p_partkey", "p_brand", "p_type", "p_size", F.when(F.col("p_size") <= 25, F.col("p_size")).alias("opt"), (F.col("p_retailprice") > 0).alias("p_retailprice"))
    m = frame.to_map(small.select("p_size", "p_retailprice")).columns[0]
    shown = F.concat_ws(",", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in ("p_size", "p_retailprice")])
    out = frame.map_rows(small, {"row": shown, "mapped": F.col("p_size") * 2, "is_null": frame.is_null("opt"), "not_null": frame.not_null("opt")})
    assert m == "row"
    return out.select("p_partkey", "p_brand", "p_type", "row", "is_null", "not_null", "mapped")


@query("select p_partkey, unnest(['p_brand', 'p_size']) as key, unnest([p_brand, cast(p_size as varchar)]) as value from part")
def df_to_map(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_size"))
    maps_ = frame.to_map(p.select("p_partkey", "p_brand", "p_size"))
    return maps_.select(F.col("row")["p_partkey"].cast("bigint").alias("p_partkey"), F.explode(F.map_filter("row", lambda k, _: k != "p_partkey")).alias("key", "value"))


@query("select c_nationkey as k from customer union select s_nationkey from supplier")
def df_union(spark, sf_dir):
    return frame.union(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))


@query()
def df_sample(spark, sf_dir):
    """A sample is the feature; tests hold its share and that it stays the same."""
    return frame.sample(table(spark, sf_dir, "orders").select("o_orderkey"), 0.25, "o_orderkey")


@query("""
with t as (select p_partkey as k, p_size as x from part), n as (select count(*) as n from t)
select round(max(greatest(abs(u / n.n - x / 51e0), abs((u - c) / n.n - x / 51e0))), 8) as statistic, any_value(n.n) as n from (select x, count(*) as c, sum(count(*)) over (order by x) as u from t group by x), n
""")
def ks_test(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_size").alias("x"))
    return stats.ks_test(p, "x", distributions.uniform(0.0, 51.0)).select(F.round("statistic", 8).alias("statistic"), "n")


@query("""
with g as (select p_partkey % 3 as g, count(*) as n, avg(p_size) as m, var_pop(p_size) as v from part group by 1), a as (select sum(n) as nn, sum(n * m) / sum(n) as mm, count(*) as k from g),
f as (select (sum(n * pow(m - mm, 2)) / (any_value(k) - 1)) / (sum(n * v) / (any_value(nn) - any_value(k))) as f, any_value(nn) - any_value(k) as d from g, a),
o as (select p_size % 3 as c, count(*) as n from part group by 1), x as (select sum(pow(n - t / 3e0, 2) / (t / 3e0)) as x from o, (select count(*) as t from part))
select 'anova' as test, round(f, 6) as statistic, round(pow(1 + 2 * f / d, -d / 2e0), 6) as p_value from f union all select 'chi square', round(x, 6), round(exp(-x / 2), 6) from x
union all select 'one sample t', round((avg(p_size) - 25) / (stddev_samp(p_size) / sqrt(count(*))), 6), null from part
union all select 'paired t', round(avg(p_size - p_retailprice / 40) / (stddev_samp(p_size - p_retailprice / 40) / sqrt(count(*))), 6), null from part
""")
def hypothesis_tests(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_size", (F.col("p_partkey") % 3).alias("g"), (F.col("p_size") % 3).alias("c"), (F.col("p_retailprice") / 40).alias("y"))
    counts = p.groupBy("c").agg(F.count(F.lit(1)).alias("n")).join(p.agg((F.count(F.lit(1)) / 3).alias("e")))
    named = lambda name, df, value: df.select(F.lit(name).alias("test"), F.round("statistic", 6).alias("statistic"), value.cast("double").alias("p_value"))
    rounded, none = F.round("p_value", 6), F.lit(None)
    t = lambda test: p.agg(test.alias("r")).select(F.col("r.t").alias("statistic"))
    out = named("anova", stats.anova(p, "p_size", "g"), rounded).union(named("chi square", stats.chi_square_test(counts, "n", "e"), rounded))
    return out.union(named("one sample t", t(stats.one_sample_t_test("p_size", 25.0)), none)).union(named("paired t", t(stats.paired_t_test("p_size", "y")), none))


@query(real("""
with t as (select p_partkey, p_size / 10e0 as x, p_size / 51e0 as u from part)
select p_partkey, round(exp(-x * x / 2) / sqrt(2 * pi()), 8) as normal_pdf, round(0.5 + (select sum(case when i % 200 = 0 then 1 when i % 2 = 1 then 4 else 2 end * exp(-pow(x * i / 200, 2) / 2)) * x / 600 / sqrt(2 * pi()) from range(201) r(i)), 7) as normal_cdf, round((x - 1) / 5, 8) as uniform_cdf_raw,
  round(1 - exp(-2 * x), 8) as exponential_cdf, round(-ln(1 - u) / 2, 8) as exponential_ppf, round(exp(-2.5) * pow(2.5, floor(x)) / factorial(cast(floor(x) as integer)), 8) as poisson_pmf, round((select sum(exp(-2.5) * pow(2.5, k) / factorial(cast(k as integer))) from range(6) r(k) where k <= x), 8) as poisson_cdf,
  round(case floor(x) when 0 then 0.0256 when 1 then 0.1536 when 2 then 0.3456 when 3 then 0.3456 when 4 then 0.1296 else 0 end, 8) as binomial_pmf, round(1 - exp(-x) * (1 + x), 8) as gamma_cdf, round(u * u * (3 - 2 * u), 8) as beta_cdf, round(1 - exp(-x / 2), 8) as chisquare_cdf, round(0.5 + x / (2 * sqrt(2 + x * x)), 8) as t_cdf,
  round(x / (1 + x), 8) as f_cdf, round(x, 6) as normal_round_trip, 2e0 as gamma_mean, round(1 / 20e0, 8) as beta_variance, round(1 / pow(1 + x, 2), 8) as f_pdf
from t
"""))
def distribution_functions(spark, sf_dir):
    d = distributions
    x, u = F.col("x"), F.col("u")
    t = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 10).alias("x"), (F.col("p_size") / 51).alias("u"))
    r = lambda c, k=8: F.round(c, k)
    return t.select(
        "p_partkey", r(d.normal().pdf(x)).alias("normal_pdf"), r(d.normal().cdf(x), 7).alias("normal_cdf"), r((d.uniform(0.0, 10.0).cdf(x) * 10 - 1) / 5).alias("uniform_cdf_raw"), r(d.exponential(2.0).cdf(x)).alias("exponential_cdf"), r(d.exponential(2.0).ppf(u)).alias("exponential_ppf"), r(d.poisson(2.5).pdf(F.floor(x))).alias("poisson_pmf"),
        r(d.poisson(2.5).cdf(x)).alias("poisson_cdf"), r(d.binomial(4, 0.6).pdf(F.floor(x))).alias("binomial_pmf"), r(d.gamma(2.0).cdf(x)).alias("gamma_cdf"), r(d.beta(2.0, 2.0).cdf(u)).alias("beta_cdf"), r(d.chisquare(2).cdf(x)).alias("chisquare_cdf"), r(d.t(2).cdf(x)).alias("t_cdf"), r(d.f(2, 2).cdf(x)).alias("f_cdf"),
        r(d.normal().ppf(d.normal().cdf(x)), 6).alias("normal_round_trip"), F.lit(d.gamma(2.0, 1.0).mean()).alias("gamma_mean"), r(F.lit(d.beta(2.0, 2.0).variance())).alias("beta_variance"), r(d.f(2, 2).pdf(x)).alias("f_pdf"),
    )


@query()
def bootstrap(spark, sf_dir):
    """Draws by hash have no SQL; tests hold the interval against the normal one."""
    return stats.bootstrap_ci(table(spark, sf_dir, "lineitem").withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber")), "l_quantity", "k", 100)
