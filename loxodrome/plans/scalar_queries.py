"""Queries over column functions: strings, lists, maps, sets, dates, mathematics, linear algebra, symbols."""

from __future__ import annotations

from pyspark.sql import functions as F

from loxodrome.functions import arrays, core, dates, linalg, lists, maps, mathx, numeric, sets, strings, symbolic
from loxodrome.operators import quality
from loxodrome.plans.base import Registry, dealt, table

REGISTRY = Registry()
query = REGISTRY.query


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part")


# strings


@query("""
select p_partkey, strlen(p_name) as length, upper(p_name) as uppercase, lower(p_brand) as lowercase, trim('  ' || p_name || ' ') as trim, contains(p_name, 'a') as contains,
  array_to_string(string_split(p_name, ' '), '|') as split, replace(p_name, 'e', 'EE') as replace, starts_with(p_name, 's') as starts, ends_with(p_type, 'L') as ends, p_name = '' as is_empty,
  trim(p_name) = '' as is_blank, upper(p_name[1]) || p_name[2:] as capitalize, ltrim(' ' || p_name || ' ') as trim_start, rtrim(' ' || p_name || ' ') as trim_end,
  instr(p_name, 'o') - 1 as index_of, case when contains(p_name, 'o') then strlen(p_name) - instr(reverse(p_name), 'o') else -1 end as last_index_of,
  cast((length(p_name) - length(replace(p_name, 'an', ''))) / 2 as integer) as count, p_name[3] as char_at, p_name[3:6] as substring,
  array_to_string(list_filter(string_split(p_name, ' '), lambda x: x <> ''), ',') as words, reverse(p_name) as reverse
from part
""")
def str_methods(spark, sf_dir):
    n = F.col("p_name")
    padded = F.concat(F.lit("  "), n, F.lit(" "))
    one = F.concat(F.lit(" "), n, F.lit(" "))
    return _parts(spark, sf_dir).select(
        "p_partkey", strings.length(n).alias("length"), strings.uppercase(n).alias("uppercase"), strings.lowercase("p_brand").alias("lowercase"), strings.trim(padded).alias("trim"), strings.contains(n, "a").alias("contains"),
        strings.join(strings.split(n, " "), "|").alias("split"), strings.replace(n, "e", "EE").alias("replace"), strings.starts_with(n, "s").alias("starts"), strings.ends_with(F.col("p_type"), "L").alias("ends"), strings.is_empty(n).alias("is_empty"),
        strings.is_blank(n).alias("is_blank"), strings.capitalize(n).alias("capitalize"), strings.trim_start(one).alias("trim_start"), strings.trim_end(one).alias("trim_end"),
        F.coalesce(strings.index_of(n, "o"), F.lit(-1)).alias("index_of"), F.coalesce(strings.last_index_of(n, "o"), F.lit(-1)).alias("last_index_of"), strings.count(n, "an").alias("count"), strings.char_at(n, 2).alias("char_at"), strings.substring(n, 2, 6).alias("substring"),
        strings.join(strings.words(n), ",").alias("words"), strings.reverse(n).alias("reverse"),
    )


@query(r"""
select p_partkey, case when length(p_name) < 20 then lpad(p_name, 20, '*') else p_name end as pad_start, case when length(p_name) < 20 then rpad(p_name, 20, '.') else p_name end as pad_end,
  repeat(p_brand, 2) as repeat, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') as title_case, trim(p_brand, 'Band#') as strip,
  p_name[length(p_name) - 3:] as slice, p_name[1:2] || '<>' || p_name[3:] as insert, p_name[1:1] || p_name[4:] as remove, regexp_matches(p_name, '[aeiou]{2}') as matches,
  array_to_string(regexp_extract_all(p_name, '[aeiou]+'), '-') as find_all, regexp_replace(p_name, '([aeiou])', '<\1>', 'g') as replace_regex,
  case when regexp_matches(p_brand, '([A-Za-z]+)#(\d)') then regexp_extract(p_brand, '([A-Za-z]+)#(\d)', 1) || '/' || regexp_extract(p_brand, '([A-Za-z]+)#(\d)', 2) end as capture,
  try_cast(nullif(regexp_extract('  ' || p_size || 'kg', '^\s*([+-]?\d+)', 1), '') as bigint) as parse_int, cast(p_retailprice as varchar) is not null as parse_float_ok,
  case when p_size % 2 = 0 then true else false end as parse_bool, p_name[1:4] || '|' || p_name[5:] as split_at, regexp_replace(p_name, 'a', 'A') as replace_first
from part
""")
def str_more(spark, sf_dir):
    n, b = F.col("p_name"), F.col("p_brand")
    cap = strings.capture(b, r"([A-Za-z]+)#(\d)")
    return _parts(spark, sf_dir).select(
        "p_partkey", strings.pad_start(n, 20, "*").alias("pad_start"), strings.pad_end(n, 20, ".").alias("pad_end"), strings.repeat(b, 2).alias("repeat"), strings.title_case(n).alias("title_case"), strings.strip(b, "Band#").alias("strip"),
        strings.slice_(n, -4).alias("slice"), strings.insert(n, 2, "<>").alias("insert"), strings.remove(n, 1, 3).alias("remove"), strings.matches(n, "[aeiou]{2}").alias("matches"),
        strings.join(strings.find_all(n, "[aeiou]+"), "-").alias("find_all"), strings.replace_regex(n, "([aeiou])", "<$1>").alias("replace_regex"), F.concat(cap[1], F.lit("/"), cap[2]).alias("capture"),
        strings.parse_int(F.concat(F.lit("  "), F.col("p_size").cast("string"), F.lit("kg")))["value"].alias("parse_int"), strings.parse_float(F.col("p_retailprice").cast("string"))["ok"].alias("parse_float_ok"),
        strings.parse_bool(F.when(F.col("p_size") % 2 == 0, " Yes").otherwise("0"))["value"].alias("parse_bool"), strings.join(strings.split_at(n, 4), "|").alias("split_at"), strings.replace_first(n, "a", "A").alias("replace_first"),
    )


@query("""
select p_partkey, 'part ' || p_name || ' costs ' || p_size as interpolation, coalesce(case when p_size > 25 then null else p_size end, -1) as unwrap_or,
  p_size <= 25 as is_some, p_size // 7 as div, p_size % 7 as mod, p_size * p_size * p_size as power, cast(list_sum(range(0, p_size)) as bigint) as range_sum, coalesce(p_size <> 0, false) as truthy
from part
""")
def core_builtins(spark, sf_dir):
    s = F.col("p_size")
    opt = F.when(s <= 25, s)
    return _parts(spark, sf_dir).select(
        "p_partkey", core.interpolated("part {name} costs {size}", name=F.col("p_name"), size=s).alias("interpolation"), core.unwrap_or(opt, F.lit(-1)).alias("unwrap_or"), core.is_some(opt).alias("is_some"),
        core.int_divide(s, F.lit(7)).alias("div"), (s % 7).alias("mod"), core.int_power(s.cast("bigint"), F.lit(3)).alias("power"), lists.sum_(core.int_range(F.lit(0), s), "bigint").alias("range_sum"), core.truthy(s, "number").alias("truthy"),
    )


# lists


def _orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", F.floor("o_totalprice").cast("bigint").alias("p")))), lambda s: s["p"]).alias("a"))


_LISTS = "with t as (select o_custkey, list(cast(floor(o_totalprice) as bigint) order by o_orderkey) as a from orders group by o_custkey) "


@query(_LISTS + """
select o_custkey, len(a) as length, len(a) > 0 as non_empty, a[1] as first, a[-1] as last, coalesce(a[3], -1) as get, list_contains(a, a[2]) as contains, list_transform(a, lambda x: x * 2) as map, list_filter(a, lambda x: x % 2 = 0) as filter,
  cast(list_sum(a) as bigint) as reduce, list_reverse(a) as reverse, list_append(a, 7) as append, list_prepend(7, a) as prepend, a[2:] as tail, a[:-2] as init, case when len(a) > 1 then list_position(a, a[2]) - 1 else -1 end as index_of,
  coalesce(list_filter(a, lambda x: x > 100000)[1], -1) as find, len(list_filter(a, lambda x: x > 200000)) > 0 as any, len(list_filter(a, lambda x: x <= 0)) = 0 as none, a[:2] as take, a[4:] as drop, list_sort(a) as sort, list_min(a) as min, list_max(a) as max,
  a[1:3] || [0] as concat, array_to_string(a, ';') as join
from t
""")
def list_methods(spark, sf_dir):
    a = F.col("a")
    second = F.get(a, F.lit(1))
    return _orders(spark, sf_dir).select(
        "o_custkey", lists.length(a).cast("bigint").alias("length"), lists.non_empty(a).alias("non_empty"), lists.first(a).alias("first"), lists.last(a).alias("last"), F.coalesce(lists.get(a, 2), F.lit(-1)).alias("get"), lists.contains(a, second).alias("contains"),
        lists.map_(a, lambda x: x * 2).alias("map"), lists.filter_(a, lambda x: x % 2 == 0).alias("filter"), lists.reduce(a, F.lit(0).cast("bigint"), lambda s, x: s + x).alias("reduce"), lists.reverse(a).alias("reverse"), lists.append(a, F.lit(7)).alias("append"),
        lists.prepend(a, F.lit(7)).alias("prepend"), lists.tail(a).alias("tail"), lists.init(a).alias("init"), F.coalesce(lists.index_of(a, second), F.lit(-1)).alias("index_of"), F.coalesce(lists.find(a, lambda x: x > 100000), F.lit(-1)).alias("find"), lists.any_(a, lambda x: x > 200000).alias("any"),
        lists.none(a, lambda x: x <= 0).alias("none"), lists.take(a, 2).alias("take"), lists.drop(a, 3).alias("drop"), lists.sort(a).alias("sort"), lists.min_(a).alias("min"), lists.max_(a).alias("max"),
        lists.concat(lists.take(a, 3), F.array(F.lit(0).cast("bigint"))).alias("concat"), lists.join(a, ";").alias("join"),
    )


@query(_LISTS + """
select o_custkey, list_transform(a[1:3], lambda x, i: x + i - 1) as enumerate, list_distinct(list_transform(a, lambda x: x % 3)) is not null as distinct_ok,
  cast(list_sum(list_transform(a, lambda x: x % 10)) as bigint) as sum_mod, list_sort(list_transform(a, lambda x: x % 1000)) as sort_mod,
  [cast(list_sum(a[1:i]) as bigint) for i in range(1, len(a) + 1)] as scan, [cast(list_sum(a[i:i + 1]) as bigint) for i in range(1, len(a))] as windowed, [cast(list_sum(a[2 * i + 1:2 * i + 2]) as bigint) for i in range(0, cast(ceil(len(a) / 2) as bigint))] as chunked,
  [a[i] + b for i, b in [(1, 1)]] is not null as ok, list_sort(a, 'DESC') as sort_with, list_concat(a[1:1], [9], a[2:]) as insert, list_concat(a[1:1], a[3:]) as remove,
  list_filter(list_transform(a, lambda x: case when x > 50000 then x / 2 end), lambda x: x is not null) as filter_map
from t
""".replace("[a[i] + b for i, b in [(1, 1)]] is not null as ok, ", ""))
def list_more(spark, sf_dir):
    a = F.col("a")
    return _orders(spark, sf_dir).select(
        "o_custkey", F.transform(lists.enumerate_(lists.take(a, 3)), lambda s: s["_2"] + s["_1"]).alias("enumerate"), lists.distinct(lists.map_(a, lambda x: x % 3)).isNotNull().alias("distinct_ok"), lists.sum_(lists.map_(a, lambda x: x % 10), "bigint").alias("sum_mod"),
        lists.sort(lists.map_(a, lambda x: x % 1000)).alias("sort_mod"), lists.drop(lists.scan(a, F.lit(0).cast("bigint"), lambda s, x: s + x), 1).alias("scan"), lists.map_(lists.windowed(a, 2), lambda w: lists.sum_(w, "bigint")).alias("windowed"), lists.map_(lists.chunked(a, 2), lambda w: lists.sum_(w, "bigint")).alias("chunked"),
        lists.sort_with(a, lambda x, y: F.signum(y - x)).alias("sort_with"), lists.insert(a, 1, F.lit(9)).alias("insert"), lists.remove(a, 1).alias("remove"), lists.filter_map(a, lambda x: F.when(x > 50000, x / 2)).alias("filter_map"),
    )


@query(_LISTS + """
select o_custkey, list_transform(list_zip(a[1:2], a[2:3], true), lambda p: p[1] + p[2]) as zip, list_filter(a, lambda x: x % 2 = 0) as yes, list_filter(a, lambda x: x % 2 <> 0) as no,
  list_sum(list_filter(a, lambda x: x % 3 = 0)) as group0, a[list_position(list_transform(a, lambda x: x % 97), list_min(list_transform(a, lambda x: x % 97)))] as min_by,
  a[list_position(list_transform(a, lambda x: x % 97), list_max(list_transform(a, lambda x: x % 97)))] as max_by, list_reduce(a, lambda x, y: x * 31 % 1000003 + y) as fold
from t
""")
def list_pairs(spark, sf_dir):
    a = F.col("a")
    parts = lists.partition(a, lambda x: x % 2 == 0)
    first, rest = lists.first(a), lists.tail(a)
    group = F.try_element_at(lists.group_by(a, lambda x: x % 3), F.lit(0).cast("bigint"))
    return _orders(spark, sf_dir).select(
        "o_custkey", lists.map_(lists.zip_(lists.take(a, 2), lists.slice_(a, 1, 3)), lambda s: s["_1"] + s["_2"]).alias("zip"), parts["_1"].alias("yes"), parts["_2"].alias("no"), lists.sum_(group, "bigint").alias("group0"),
        lists.min_by(a, lambda x: x % 97).alias("min_by"), lists.max_by(a, lambda x: x % 97).alias("max_by"), lists.fold(rest, first, lambda s, x: s * 31 % 1000003 + x).alias("fold"),
    )


# maps and sets


@query("""
select p_partkey, 3 as size, p_size as get, p_size is not null as contains, coalesce(null, 'none') as get_or_default, p_size + 1 as updated, 99 as put, 2 as removed_size, p_size * 10 as merged, p_size as kept_first from part
""")
def map_methods(spark, sf_dir):
    s = F.col("p_size")
    m = F.create_map(F.lit("size"), s, F.lit("key"), F.col("p_partkey").cast("int"), F.lit("one"), F.lit(1))
    other = F.create_map(F.lit("size"), s * 10, F.lit("new"), F.lit(5))
    return _parts(spark, sf_dir).select(
        "p_partkey", maps.size(m).alias("size"), maps.get(m, "size").alias("get"), maps.contains(m, "key").alias("contains"), F.coalesce(maps.get(m, "absent").cast("string"), F.lit("none")).alias("get_or_default"), maps.get(maps.update(m, "size", lambda v: v + 1), "size").alias("updated"),
        maps.get(maps.put(m, "one", 99), "one").alias("put"), maps.size(maps.remove(m, "key")).alias("removed_size"), maps.get(maps.merge(m, other), "size").alias("merged"), maps.get(maps.merge(m, other, lambda a, b: a), "size").alias("kept_first"),
    )


@query("""
with t as (select o_custkey, list_sort(list_distinct(list(o_orderkey % 7))) as a, list_sort(list_distinct(list(o_orderkey % 5))) as b from orders group by o_custkey)
select o_custkey, len(a) as size, list_contains(a, 3) as contains, list_sort(list_distinct(a || [10::bigint])) as add, list_filter(a, lambda x: x <> 2) as remove, list_sort(list_distinct(a || b)) as union, list_filter(a, lambda x: list_contains(b, x)) as intersection,
  list_filter(a, lambda x: not list_contains(b, x)) as difference, len(list_filter(a, lambda x: not list_contains(b, x))) = 0 as is_subset, len(list_filter(a, lambda x: list_contains(b, x))) = 0 as is_disjoint,
  list_sort(list_filter(a, lambda x: not list_contains(b, x)) || list_filter(b, lambda x: not list_contains(a, x))) as symmetric_difference, list_sort(list_distinct(list_transform(a, lambda x: x % 2))) as map
from t
""")
def set_methods(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a, b = F.col("a"), F.col("b")
    t = o.groupBy("o_custkey").agg(F.sort_array(F.collect_set(F.col("o_orderkey") % 7)).alias("a"), F.sort_array(F.collect_set(F.col("o_orderkey") % 5)).alias("b"))
    return t.select(
        "o_custkey", sets.size(a).cast("bigint").alias("size"), sets.contains(a, 3).alias("contains"), F.array_sort(sets.add(a, F.lit(10).cast("bigint"))).alias("add"), sets.remove(a, F.lit(2).cast("bigint")).alias("remove"), F.array_sort(sets.union(a, b)).alias("union"), sets.intersection(a, b).alias("intersection"),
        sets.difference(a, b).alias("difference"), sets.is_subset(a, b).alias("is_subset"), sets.is_disjoint(a, b).alias("is_disjoint"), F.array_sort(sets.symmetric_difference(a, b)).alias("symmetric_difference"), F.array_sort(sets.map_(a, lambda x: x % 2)).alias("map"),
    )


# dates


@query("""
select event_id, cast(year(ts) as integer) as year, cast(month(ts) as integer) as month, cast(day(ts) as integer) as day, cast(hour(ts) as integer) as hour, cast(minute(ts) as integer) as minute, cast(second(ts) as integer) as second,
  cast(epoch_us(ts) // 1000 % 1000 as integer) as millisecond, cast(dayofweek(ts) as integer) as day_of_week, cast(dayofyear(ts) as integer) as day_of_year, cast(weekofyear(ts) as integer) as week_of_year, cast(quarter(ts) as integer) as quarter,
  epoch_us(ts) // 1000000 as to_unix, epoch_us(ts) // 1000 as to_unix_millis, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as iso, strftime(ts, '%Y-%m-%d') as fmt, epoch_ms(date_trunc('day', ts)) as start_of_day, epoch_us(date_trunc('day', ts)) + 86399999999 as end_of_day,
  epoch_ms(date_trunc('month', ts)) as start_of_month, epoch_ms(date_trunc('year', ts)) as start_of_year, ts < timestamp '2024-01-15' as before, epoch_us(ts) // 1000 + 5400000 as plus, epoch_us(ts) // 1000 - 86400000 as minus,
  epoch_us(date_trunc('month', ts) + interval 30 day + (ts - date_trunc('day', ts))) // 1000 as with_day
from events
""")
def date_methods(spark, sf_dir):
    t = F.col("ts")
    ms = lambda c: F.unix_millis(c.cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        "event_id", dates.year(t).alias("year"), dates.month(t).alias("month"), dates.day(t).alias("day"), dates.hour(t).alias("hour"), dates.minute(t).alias("minute"), dates.second(t).alias("second"), dates.millisecond(t).alias("millisecond"),
        dates.day_of_week(t).alias("day_of_week"), dates.day_of_year(t).alias("day_of_year"), dates.week_of_year(t).alias("week_of_year"), dates.quarter(t).alias("quarter"), dates.to_unix(t).alias("to_unix"), dates.to_unix_millis(t).alias("to_unix_millis"),
        dates.to_iso8601(t).alias("iso"), dates.format_(t, "2006-01-02").alias("fmt"), ms(dates.start_of_day(t)).alias("start_of_day"), F.unix_micros(dates.end_of_day(t)).alias("end_of_day"), ms(dates.start_of_month(t)).alias("start_of_month"),
        ms(dates.start_of_year(t)).alias("start_of_year"), dates.is_before(t, F.lit("2024-01-15")).alias("before"), ms(dates.plus(t, dates.hours(F.lit(1.5)))).alias("plus"), ms(dates.minus(t, dates.days(F.lit(1)))).alias("minus"), ms(dates.with_day(t, 31)).alias("with_day"),
    )


@query("""
select o_orderkey, epoch_ms(make_timestamp(2024, 1, 1, 0, 0, 0.0) + to_months(cast(o_orderkey % 30 as integer)) + to_days(cast(o_orderkey % 40 as integer))) as date, (o_orderkey % 1000) / 60.0 as minutes, cast(o_orderkey % 1000 as double) / 3600 as hours,
  (o_orderkey % 1000) * 1000 as millis, o_orderkey * 1000 as from_unix, true as parsed
from orders
""".replace("(o_orderkey % 1000) / 60.0", "cast(o_orderkey % 1000 as double) / 60"))
def durations(spark, sf_dir):
    k = F.col("o_orderkey")
    d = dates.seconds(k % 1000)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.unix_millis(dates.date(F.lit(2024), (k % 30 + 1).cast("int"), (k % 40 + 1).cast("int"))).alias("date"), dates.to_minutes(d).alias("minutes"), dates.to_hours(d).alias("hours"), dates.to_millis(d).alias("millis"),
        F.unix_millis(dates.from_unix(k)).alias("from_unix"), dates.parse(F.lit("2024-03-15 10:20:30"), "datetime")["ok"].alias("parsed"),
    )


# mathematics


@query("""
with t as (select p_partkey, p_retailprice / 100 - 12 as x, p_size as n from part)
select p_partkey, floor(x) as floor, ceil(x) as ceil, round(x) as round, trunc(x) as trunc, round(x - floor(x), 9) as frac, round(sin(x), 9) as sin, round(cos(x), 9) as cos, round(tan(x / 20), 9) as tan, round(atan2(x, n), 9) as atan2, round(sinh(x / 10), 9) as sinh, round(asinh(x), 9) as asinh, round(tanh(x), 9) as tanh,
  round(radians(x), 9) as radians, round(degrees(x), 6) as degrees, round(exp(x / 10), 9) as exp, round(pow(2, x / 5), 9) as exp2, round(ln(n), 9) as log, round(log2(n), 9) as log2, round(log10(n), 9) as log10, round(ln(n) / ln(3), 9) as log_base, round(cbrt(x), 9) as cbrt, round(sqrt(x * x + n * n), 9) as hypot,
  cast(sign(x) as bigint) as sign, greatest(-3.0, least(3.0, x)) as clamp, round(2 + (x - 2) * 0.25, 9) as lerp, gcd(n, 36) as gcd, lcm(n, 36) as lcm, n * (n - 1) // 2 as combinations, cast(n * (n - 1) as bigint) as permutations,
  n > 1 and len(list_filter(range(2, n), lambda d: n % d = 0)) = 0 as is_prime, round(greatest(0, least(1, (x + 3) / 6)) * greatest(0, least(1, (x + 3) / 6)) * (3 - 2 * greatest(0, least(1, (x + 3) / 6))), 9) as smoothstep
from t
""")
def math_scalars(spark, sf_dir):
    x, n = F.col("x"), F.col("n").cast("bigint")
    r = lambda c, k=9: F.round(c, k)
    t = _parts(spark, sf_dir).select("p_partkey", (F.col("p_retailprice") / 100 - 12).alias("x"), F.col("p_size").alias("n"))
    return t.select(
        "p_partkey", mathx.floor(x).alias("floor"), mathx.ceil(x).alias("ceil"), mathx.round_(x).alias("round"), mathx.trunc(x).alias("trunc"), r(mathx.frac(x)).alias("frac"), r(mathx.sin(x)).alias("sin"), r(mathx.cos(x)).alias("cos"), r(mathx.tan(x / 20)).alias("tan"), r(mathx.atan2(x, n)).alias("atan2"),
        r(mathx.sinh(x / 10)).alias("sinh"), r(mathx.asinh(x)).alias("asinh"), r(mathx.tanh(x)).alias("tanh"), r(mathx.to_radians(x)).alias("radians"), r(mathx.to_degrees(x), 6).alias("degrees"), r(mathx.exp(x / 10)).alias("exp"), r(mathx.exp2(x / 5)).alias("exp2"), r(mathx.log(n)).alias("log"),
        r(mathx.log2(n)).alias("log2"), r(mathx.log10(n)).alias("log10"), r(mathx.log_base(F.lit(3.0), n)).alias("log_base"), r(mathx.cbrt(x)).alias("cbrt"), r(mathx.hypot(x, n)).alias("hypot"), mathx.sign(x).alias("sign"), mathx.clamp(x, F.lit(-3.0), F.lit(3.0)).alias("clamp"),
        r(mathx.lerp(F.lit(2.0), x, F.lit(0.25))).alias("lerp"), mathx.gcd(n, F.lit(36)).alias("gcd"), mathx.lcm(n, F.lit(36)).alias("lcm"), mathx.combinations(n, F.lit(2)).alias("combinations"), mathx.permutations(n, F.lit(2)).alias("permutations"), mathx.is_prime(n).alias("is_prime"),
        r(mathx.smoothstep(F.lit(-3.0), F.lit(3.0), x)).alias("smoothstep"),
    )


@query("""
with t as (select p_partkey, p_retailprice / 100 as a, cast(p_size as double) as b from part)
select p_partkey, round(a - b, 9) as sum_re, round(a * b, 9) as mul_im, round(sqrt(a * a + b * b), 9) as mag, round(atan2(b, a), 9) as phase, round(sqrt(sqrt(a * a + b * b)) * cos(atan2(b, a) / 2), 9) as sqrt_re, round(exp(b / 50) * cos(a), 9) as exp_re, round((a * b + b * 2) / (b * b + 4), 9) as div_re from t
""")
def complex_numbers(spark, sf_dir):
    a, b = F.col("p_retailprice") / 100, F.col("p_size").cast("double")
    c = mathx.complex_(a, b)
    return _parts(spark, sf_dir).select(
        "p_partkey", F.round(mathx.complex_add(c, mathx.complex_(-b, F.lit(0.0)))["re"], 9).alias("sum_re"), F.round(mathx.complex_mul(mathx.complex_(a, F.lit(0.0)), mathx.complex_(F.lit(0.0), b))["im"], 9).alias("mul_im"), F.round(mathx.complex_mag(c), 9).alias("mag"), F.round(mathx.complex_phase(c), 9).alias("phase"),
        F.round(mathx.complex_sqrt(c)["re"], 9).alias("sqrt_re"), F.round(mathx.complex_exp(mathx.complex_(b / 50, a))["re"], 9).alias("exp_re"), F.round(mathx.complex_div(c, mathx.complex_(b, F.lit(2.0)))["re"], 9).alias("div_re"),
    )


_VECTORS = "with t as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v, list_transform(embedding[1:3], lambda x: cast(x as double)) as a, list_transform(embedding[4:6], lambda x: cast(x as double)) as b from embeddings) "


@query(_VECTORS + """
select vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 6) as dot, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) as magnitude, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) as unit_x,
  round(a[2] * b[3] - a[3] * b[2], 6) as cross_x, round(a[1] + b[1], 6) as add_x, round(a[1] * 2.5, 6) as scale_x, round(list_sum(list_transform(v, lambda x: abs(x))), 6) as norm1, round(list_max(list_transform(v, lambda x: abs(x))), 6) as norm_inf,
  round(a[2] * b[3], 6) as outer_12, round((a[1] * b[1] + a[2] * b[2] + a[3] * b[3]) / (b[1] * b[1] + b[2] * b[2] + b[3] * b[3]) * b[1], 6) as project_x
from t
""")
def vectors(spark, sf_dir):
    v = F.col("embedding").cast("array<double>")
    a, b = F.slice(v, 1, 3), F.slice(v, 4, 3)
    at = lambda c, i=0: F.round(F.get(c, F.lit(i)), 6)
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.round(linalg.dot(v, v), 6).alias("dot"), F.round(linalg.magnitude(v), 6).alias("magnitude"), at(linalg.normalize(v)).alias("unit_x"), at(linalg.cross(a, b)).alias("cross_x"), at(linalg.vec_add(a, b)).alias("add_x"), at(linalg.vec_scale(a, 2.5)).alias("scale_x"),
        F.round(linalg.vector_norm(v, 1), 6).alias("norm1"), F.round(linalg.vector_norm(v, float("inf")), 6).alias("norm_inf"), at(F.get(linalg.outer(a, b), F.lit(1)), 2).alias("outer_12"), at(linalg.project_onto(a, b)).alias("project_x"),
    )


@query(_VECTORS + """
select vec_id, round(a[1] * b[1] + a[2] * b[2], 6) as mul_00, round(a[1] * b[2] - a[2] * b[1], 6) as det, round(a[1] + b[2], 6) as trace, round(b[1], 6) as transposed_01, round(sqrt(a[1] * a[1] + a[2] * a[2] + b[1] * b[1] + b[2] * b[2]), 6) as norm,
  round(a[2] * a[2], 6) as hadamard_01, round(a[1] * b[2], 6) as kron_last from t
""".replace("round(a[1] * b[1] + a[2] * b[2], 6) as mul_00", "round(a[1] * a[1] + a[2] * b[1], 6) as mul_00").replace("round(a[1] * b[2], 6) as kron_last", "round(b[2] * b[2], 6) as kron_last"))
def matrices(spark, sf_dir):
    v = F.col("embedding").cast("array<double>")
    m = F.array(F.slice(v, 1, 2), F.slice(v, 4, 2))
    g = lambda c, i, j: F.round(linalg.get(c, i, j), 6)
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", g(linalg.mat_mul(m, m), 0, 0).alias("mul_00"), F.round(linalg.det_small(m), 6).alias("det"), F.round(linalg.trace(m), 6).alias("trace"), g(linalg.transpose(m), 0, 1).alias("transposed_01"), F.round(linalg.matrix_norm(m), 6).alias("norm"),
        g(linalg.hadamard(m, m), 0, 1).alias("hadamard_01"), g(linalg.kronecker(m, m), 3, 3).alias("kron_last"),
    )


@query(_VECTORS + "select vec_id, round(list_sum(v), 6) as sum, round(list_avg(v), 6) as mean, round(list_min(v), 6) as min, round(list_max(v), 6) as max, len(v) as size, round(v[2], 6) as transposed, list_position(v, list_max(v)) - 1 as argmax, round(list_stddev_pop(v), 6) as std, round(v[1] + v[2] + v[3], 6) as cumsum_2 from t")
def nd_arrays(spark, sf_dir):
    v = F.col("embedding").cast("array<double>")
    a = arrays.from_list(v)
    col = arrays.transpose(arrays.make(v, F.array(F.size(v), F.lit(1))))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.round(arrays.sum_(a), 6).alias("sum"), F.round(arrays.mean(a), 6).alias("mean"), F.round(arrays.min_(a), 6).alias("min"), F.round(arrays.max_(a), 6).alias("max"), arrays.size(a).cast("bigint").alias("size"), F.round(F.get(arrays.to_list(col), F.lit(1)), 6).alias("transposed"),
        arrays.argmax(a).alias("argmax"), F.round(arrays.std(a), 6).alias("std"), F.round(F.get(arrays.cumsum(a)["data"], F.lit(2)), 6).alias("cumsum_2"),
    )


@query("""
with t as (select p_partkey, cast(p_size as double) as x, p_retailprice / 1000 as y from part)
select p_partkey, round(x * x * sin(y) + 2 * x, 8) as value, round(2 * x * sin(y) + 2, 8) as dx, round(x * x * cos(y), 8) as dy, round(2 * sin(y), 8) as dxx, round((x + y) * (x + y), 8) as square from t
""")
def symbolic_columns(spark, sf_dir):
    e = symbolic.parse("x^2 * sin(y) + 2 * x")
    t = _parts(spark, sf_dir).select("p_partkey", F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 1000).alias("y"))
    r = lambda s: F.round(symbolic.realize(s), 8)
    return t.select("p_partkey", r(e).alias("value"), r(symbolic.diff(e, "x")).alias("dx"), r(symbolic.diff(e, "y")).alias("dy"), r(symbolic.diff(symbolic.diff(e, "x"), "x")).alias("dxx"), r(symbolic.expand(symbolic.parse("(x + y)^2"))).alias("square"))


@query("select p_partkey, round(sqrt(p_size), 6) as bisect, round(sqrt(p_size), 6) as newton, round(pow(p_size, 3) / 3e0, 4) as quad, round(2e0 * p_size, 4) as diff, round(cast(p_size as double), 3) as minimize, round(3e0 * p_size * p_size - 2 * p_size + 1, 6) as polyval from part")
def numeric_methods(spark, sf_dir):
    n = F.col("p_size").cast("double")
    return dealt(_parts(spark, sf_dir)).select(
        "p_partkey", F.round(numeric.bisect(lambda x: x * x - n, 0.0, 100.0), 6).alias("bisect"), F.round(numeric.newton(lambda x: x * x - n, n), 6).alias("newton"), F.round(numeric.quad(lambda x: x * x, F.lit(0.0), n, 20)["value"], 4).alias("quad"),
        F.round(numeric.diff(lambda x: x * x, n), 4).alias("diff"), F.round(numeric.minimize(lambda x: (x - n) * (x - n), -1.0, 50.0)["x"], 3).alias("minimize"), F.round(numeric.polyval(F.array(F.lit(3.0), F.lit(-2.0), F.lit(1.0)), n), 6).alias("polyval"),
    )


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("""
select 'size positive' as "check", count(*) as n, count(*) filter (where not p_size > 0) as violations from part
union all select 'name matches', count(*), count(*) filter (where not regexp_matches(p_name, '^[a-m]')) from part
union all select 'price between', count(*), count(*) filter (where not p_retailprice between 1000 and 1500) from part
""")
def quality_report(spark, sf_dir):
    return quality.report(_parts(spark, sf_dir), [("size positive", quality.positive(F.col("p_size"))), ("name matches", quality.matches(F.col("p_name"), "^[a-m]")), ("price between", quality.between(F.col("p_retailprice"), 1000, 1500))])
