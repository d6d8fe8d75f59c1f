"""Queries over the column functions that scalar_queries leaves out, a column each, against SQL of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from loxodrome.functions import arrays, core, dates, linalg, lists, maps, mathx, numeric, sets, strings, symbolic
from loxodrome.operators import functional, quality, stats
from loxodrome.plans.base import Registry, dealt, real, table

REGISTRY = Registry()
query = REGISTRY.query


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part")


def _round(c, k=6):
    return F.round(c, k)


def _near(c, k=6):
    """Rounded after a shift that parts exact halves, which floating-point errors would round either way."""
    return F.round(F.lit(1.3e-8) + (F.col(c) if isinstance(c, str) else c), k)


# values, options and results


@query("""
select p_partkey, 'string' as t_string, 'int' as t_int, 'float' as t_float, 'List' as t_list, 'nil' as t_nil, p_size as to_int, cast(regexp_extract(p_name, '^\\s*([+-]?\\d+)', 1) = '' as boolean) as no_int, p_retailprice as to_float,
  p_size % 256 as to_byte, p_size > 25 as is_none, case when p_size <= 25 then p_size else 0 end as unwrapped, p_size % 3 = 0 as is_ok, p_size % 3 <> 0 as is_err, case when p_size % 3 = 0 then p_size else -1 end as or_else,
  case when p_size % 3 <> 0 then 'not by three: ' || p_size end as message, cast(p_size as varchar) as text, coalesce(case when p_size > 25 then cast(p_size as varchar) end, 'nil') as nil_text, strlen(p_name) as bytes,
  p_name <> '' as truthy_text, p_size % 2 <> 0 as truthy_list, true as is_float, p_size as ok_value, 'bad ' || p_brand as err_message, case when p_size > 0 then p_size end as some
from part
""")
def values_and_results(spark, sf_dir):
    s, n = F.col("p_size"), F.col("p_name")
    opt = F.when(s <= 25, s)
    r = core.result_of(F.when(s % 3 == 0, s), F.concat(F.lit("not by three: "), s.cast("string")))
    return _parts(spark, sf_dir).select(
        "p_partkey", core.typeof(n).alias("t_string"), core.typeof(s).alias("t_int"), core.typeof(F.col("p_retailprice")).alias("t_float"), core.typeof(F.array(s)).alias("t_list"), core.typeof(F.lit(None)).alias("t_nil"), core.to_int(F.concat(F.lit(" "), s.cast("string"), F.lit("abc"))).alias("to_int"),
        core.to_int(n).isNull().alias("no_int"), core.to_float(F.concat(F.col("p_retailprice").cast("string"), F.lit(" eur"))).alias("to_float"), core.to_byte(s % 256).alias("to_byte"), core.is_none(opt).alias("is_none"), F.when(core.is_some(opt), core.unwrap(opt, "int")).otherwise(0).alias("unwrapped"),
        core.is_ok(r).alias("is_ok"), core.is_err(r).alias("is_err"), F.when(core.is_ok(r), core.unwrap_result(r, "int")).otherwise(-1).alias("or_else"), r["err"].alias("message"), core.to_text(s).alias("text"), core.to_text(F.when(s > 25, s)).alias("nil_text"), core.byte_length(n).alias("bytes"),
        core.truthy(n, "string").alias("truthy_text"), core.truthy(F.when(s % 2 != 0, F.array(s)).otherwise(F.array().cast("array<int>")), "list").alias("truthy_list"), core.instanceof(F.col("p_retailprice"), "float").alias("is_float"), core.unwrap_result(core.ok(s), "int").alias("ok_value"),
        core.err(F.concat(F.lit("bad "), F.col("p_brand")))["err"].alias("err_message"), core.some(s).alias("some"),
    )


# lists


_LISTS = "with t as (select o_custkey, list(cast(floor(o_totalprice) as bigint) order by o_orderkey) as a from orders group by o_custkey) "


def _orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", F.floor("o_totalprice").cast("bigint").alias("p")))), lambda s: s["p"]).alias("a"))


@query(_LISTS + """
select o_custkey, len(a) = 0 as is_empty, a[1] as head, coalesce(nullif(list_position(list_transform(a, lambda x: x > 150000), true), 0) - 1, -1) as find_index, flatten(list_transform(a, lambda x: [x, x + 1])) as flat_map,
  case when list_position(list_transform(a, lambda x: x > 50000), false) > 0 then a[1:list_position(list_transform(a, lambda x: x > 50000), false) - 1] else a end as take_while,
  case when list_position(list_transform(a, lambda x: x > 50000), false) > 0 then a[list_position(list_transform(a, lambda x: x > 50000), false):] else [] end as drop_while,
  list_transform(list_sort(list_transform(a, lambda x, i: {'k': x % 1000, 'i': i, 'x': x})), lambda s: s.x) as sort_by, list_product(list_transform(a[1:4], lambda x: x % 97)) as product,
  list_filter(a, lambda x, i: list_position(list_transform(a, lambda y: y % 7), x % 7) = i) as distinct_by, list_transform(range(1, len(a)), lambda i: a[i] + 2 * a[i + 1]) as zip_with, a[1:len(a) - 1] as unzip_1, a[2:] as unzip_2,
  (flatten(list_transform(a, lambda x: [x, 0])))[1:2 * len(a) - 1] as intersperse, flatten(list_transform(range(1, least(len(a), 3) + 1), lambda i: [a[i], i])) || list_transform(range(least(len(a), 3) + 1, 4), lambda i: i) || a[4:] as interleave,
  list_reduce(list_prepend(0::bigint, list_reverse(a)), lambda acc, x: x - acc) as fold_right, list_transform(range(0, 3), lambda i: a[1]) as repeat, [0, 1, 4, 9] as generate, list_transform(a, lambda x: x // 2)[1:2] as composed
from t
""")
def list_rest(spark, sf_dir):
    a = F.col("a")
    pairs = lists.unzip(lists.zip_(a, lists.tail(a)))
    counted = F.array(*[F.lit(i).cast("bigint") for i in (1, 2, 3)])
    return _orders(spark, sf_dir).select(
        "o_custkey", lists.is_empty(a).alias("is_empty"), lists.head(a).alias("head"), F.coalesce(lists.find_index(a, lambda x: x > 150000), F.lit(-1)).alias("find_index"), lists.flat_map(a, lambda x: F.array(x, x + 1)).alias("flat_map"), lists.take_while(a, lambda x: x > 50000).alias("take_while"),
        lists.drop_while(a, lambda x: x > 50000).alias("drop_while"), lists.sort_by(a, lambda x: x % 1000).alias("sort_by"), lists.product(lists.map_(lists.take(a, 4), lambda x: x % 97)).alias("product"), lists.distinct_by(a, lambda x: x % 7).alias("distinct_by"),
        lists.zip_with(a, lists.tail(a), lambda x, y: x + 2 * y).alias("zip_with"), pairs["_1"].alias("unzip_1"), pairs["_2"].alias("unzip_2"), lists.intersperse(a, F.lit(0).cast("bigint")).alias("intersperse"), lists.interleave(a, counted).alias("interleave"),
        lists.fold_right(a, F.lit(0).cast("bigint"), lambda x, acc: x - acc).alias("fold_right"), lists.repeat(lists.head(a), 3).alias("repeat"), lists.generate(4, lambda i: i * i).alias("generate"), functional.pipe(lambda c: lists.take(c, 2), lambda c: lists.map_(c, lambda x: F.floor(x / 2)))(a).alias("composed"),
    )


# maps and sets


@query("""
select p_partkey, false as is_empty, ['size', 'key', 'one'] as keys, [p_size, p_partkey, 1] as "values", list_transform(list_zip(['size', 'key', 'one'], [p_size, p_partkey, 1]), lambda e: e[1] || '=' || e[2]) as entries, p_size as got, -1 as got_default,
  [p_size * 2, p_partkey * 2, 2] as map_values, ['size!', 'key!', 'one!'] as map_keys, len(list_filter([p_size, p_partkey, 1], lambda v: v > 20)) as filtered, p_size * 10 as put_all, 4 as put_all_size, p_size + 1 as upserted, 7 as inserted, ['one'] as filter_keys,
  list_filter([p_size, p_partkey, 1], lambda v: v % 2 = 1) as filter_values
from part
""")
def map_rest(spark, sf_dir):
    s = F.col("p_size").cast("bigint")
    m = F.create_map(F.lit("size"), s, F.lit("key"), F.col("p_partkey"), F.lit("one"), F.lit(1).cast("bigint"))
    both = maps.put_all(m, F.create_map(F.lit("size"), s * 10, F.lit("new"), s))
    return _parts(spark, sf_dir).select(
        "p_partkey", maps.is_empty(m).alias("is_empty"), maps.keys(m).alias("keys"), maps.values(m).alias("values"), F.transform(maps.entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))).alias("entries"), maps.get_or_default(m, "size", F.lit(-1).cast("bigint")).alias("got"),
        maps.get_or_default(m, "none", F.lit(-1).cast("bigint")).alias("got_default"), F.map_values(maps.map_values(m, lambda v: v * 2)).alias("map_values"), F.map_keys(maps.map_keys(m, lambda k: F.concat(k, F.lit("!")))).alias("map_keys"), F.size(maps.filter_(m, lambda _, v: v > 20)).alias("filtered"),
        maps.get(both, "size").alias("put_all"), F.size(both).alias("put_all_size"), maps.get(maps.update_or_insert(m, "size", F.lit(7).cast("bigint"), lambda v: v + 1), "size").alias("upserted"), maps.get(maps.update_or_insert(m, "fresh", F.lit(7).cast("bigint"), lambda v: v + 1), "fresh").alias("inserted"),
        F.map_keys(maps.filter_keys(m, lambda k: k.contains("n"))).alias("filter_keys"), F.map_values(maps.filter_values(m, lambda v: v % 2 == 1)).alias("filter_values"),
    )


@query("""
with t as (select o_custkey, list_sort(list_distinct(list(o_orderkey % 12))) as a, list_sort(list_distinct(list(o_orderkey % 3))) as b from orders group by o_custkey)
select o_custkey, len(a) = 0 as is_empty, list_transform(list_sort(list_transform(a, lambda x: cast(x as varchar))), lambda x: cast(x as bigint)) as to_list, len(list_filter(b, lambda x: not list_contains(a, x))) = 0 as is_superset,
  list_sort(case when list_contains(a, 5) then list_filter(a, lambda x: x <> 5) else list_append(a, 5) end) as toggle, list_filter(a, lambda x: x > 4) as filter, list_sort(list_distinct(flatten(list_transform(a, lambda x: [x % 4, x % 5])))) as flat_map,
  0 as empty, list_sort(list_distinct([o_custkey % 3, o_custkey % 2, 1])) as of, list_sort(list_distinct(a || a)) as from_list
from t
""")
def set_rest(spark, sf_dir):
    a, b, k = F.col("a"), F.col("b"), F.col("o_custkey")
    t = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_set(F.col("o_orderkey") % 12)).alias("a"), F.sort_array(F.collect_set(F.col("o_orderkey") % 3)).alias("b"))
    return t.select(
        "o_custkey", sets.is_empty(a).alias("is_empty"), sets.to_list(a).alias("to_list"), sets.is_superset(a, b).alias("is_superset"), F.array_sort(sets.toggle(a, F.lit(5).cast("bigint"))).alias("toggle"), sets.filter_(a, lambda x: x > 4).alias("filter"),
        F.array_sort(sets.flat_map(a, lambda x: F.array(x % 4, x % 5))).alias("flat_map"), F.size(sets.empty("bigint")).alias("empty"), F.array_sort(sets.of(k % 3, k % 2, F.lit(1).cast("bigint"))).alias("of"), F.array_sort(sets.from_list(F.concat(a, a))).alias("from_list"),
    )


# strings and dates


@query("""
select p_partkey, len(string_split(p_name || chr(10) || p_brand || chr(10), chr(10))) as lines, replace(p_name, 'e', '') as replace_all, printf('%s costs %d', p_name, p_size) as format, string_split(p_name, ' ')[1] as first_words,
  p_partkey // 7 as div, p_partkey ** 2 as power, -1 - p_size as negated, not p_size > 9 as not_, p_size > 9 and p_size < 20 or p_size = 3 as logic, case when p_size % 15 = 0 then 'both' when p_size % 5 = 0 then 'five' when p_size % 3 = 0 then 'three' else cast(p_size as varchar) end as match_
from part
""")
def strings_and_operators(spark, sf_dir):
    n, s = F.col("p_name"), F.col("p_size")
    return _parts(spark, sf_dir).select(
        "p_partkey", F.size(strings.lines(F.concat(n, F.lit("\n"), F.col("p_brand"), F.lit("\n")))).alias("lines"), strings.replace_all(n, "e", "").alias("replace_all"), strings.format_("%s costs %d", n, s).alias("format"), strings.first_words(n, 1).alias("first_words"),
        core.int_divide(F.col("p_partkey"), F.lit(7)).alias("div"), core.int_power(F.col("p_partkey"), F.lit(2)).alias("power"), (-(s + 1)).alias("negated"), (~(s > 9)).alias("not_"), (((s > 9) & (s < 20)) | (s == 3)).alias("logic"),
        core.matched(s, (lambda x: x % 15 == 0, F.lit("both")), (lambda x: x % 5 == 0, F.lit("five")), (lambda x: x % 3 == 0, F.lit("three")), default=s.cast("string")).alias("match_"),
    )


@query(real("""
select event_id, ts > timestamp '2024-01-15' as is_after, ts between timestamp '2024-01-05' and timestamp '2024-01-20' as is_between, epoch_us(make_timestamp(2023, cast(month(ts) as integer), cast(day(ts) as integer), 0, 0, 0.0) + (ts - date_trunc('day', ts))) as with_year,
  epoch_us(make_timestamp(cast(year(ts) as integer), 3, 1, 0, 0, 0.0) + to_days(cast(day(ts) - 1 as integer)) + (ts - date_trunc('day', ts))) as with_month, cast(event_id % 100 as double) / 24 as to_days, true as before_now, epoch_us(make_timestamp(2024, 2, 3, 0, 0, 0.0)) + (event_id % 24) * 3600000000 as datetime,
  (event_id % 90) * 60.0 as minutes, (event_id % 5000) / 1000.0 as millis, true as past, event_id * 1000 + 7 as from_unix_millis, (event_id % 50) * 3600 + 61.0 as seconds, epoch_ms(ts) - 60000 as minus
from events
"""))
def date_rest(spark, sf_dir):
    t, k = F.col("ts"), F.col("event_id")
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        "event_id", dates.is_after(t, F.lit("2024-01-15")).alias("is_after"), dates.is_between(t, F.lit("2024-01-05"), F.lit("2024-01-20")).alias("is_between"), us(dates.with_year(t, 2023)).alias("with_year"), us(dates.with_month(t, 3)).alias("with_month"), dates.to_days(dates.hours(k % 100)).alias("to_days"),
        (dates.is_before(t, dates.now()) & dates.is_before(t, dates.instant())).alias("before_now"), us(dates.datetime(F.lit(2024), F.lit(2), F.lit(3), (k % 24).cast("int"), F.lit(0), F.lit(0))).alias("datetime"), dates.to_seconds(dates.minutes(k % 90)).alias("minutes"), dates.to_seconds(dates.millis(k % 5000)).alias("millis"),
        ((dates.to_seconds(dates.since(t)) > 0) & (dates.to_seconds(dates.until(t)) < 0)).alias("past"), F.unix_millis(dates.from_unix_millis(k * 1000 + 7)).alias("from_unix_millis"), dates.to_seconds(dates.plus(dates.at(t), dates.hours(k % 50)) - dates.minus(dates.at(t), dates.seconds(F.lit(61)))).alias("seconds"),
        # to the nearest millisecond, halves away from zero, before the minute is taken off, as epoch_ms does
        F.unix_millis(dates.minus(F.timestamp_micros(F.round(us(t), -3)), dates.minutes(F.lit(1)))).alias("minus"),
    )


# mathematics


@query("""
with t as (select p_partkey, p_retailprice / 100 - 12 as x, p_size as n from part)
select p_partkey, round(pi() * x, 9) as pi, round(exp(1) * x, 9) as e, round(2 * pi() * x, 9) as tau, round((1 + sqrt(5)) / 2 * x, 9) as phi, round(case when x > -1 then ln(1 + x) else -99 end, 9) as log1p, x < -1 as log1p_nan, n % 2 = 0 as is_nan, n % 3 = 0 as is_infinite, n % 2 <> 0 and n % 3 <> 0 as is_finite,
  cast(factorial(n % 15) as double) as factorial, round(acos(sin(x)), 9) as acos, round(asin(cos(x)), 9) as asin, round(atan(x), 9) as atan, round(cosh(x / 10), 9) as cosh, round(acosh(1 + abs(x)), 9) as acosh, round(atanh(x / 100), 9) as atanh, round(exp(x / 100) - 1, 9) as expm1, abs(x) as abs, round(sqrt(abs(x)), 9) as sqrt, round(pow(abs(x), 1.5), 9) as pow,
  (cast(floor(x) as integer) % 7 + 7) % 7 as mod, floor(n / 7.0) as div_1, n % 7 as div_2, n * (n - 1) * (n - 2) // 6 as binomial, round((x + 3) / 6, 9) as inverse_lerp,
  list_sort(flatten(list_transform(list_filter(range(2, 51), lambda p: len(list_filter(range(2, p), lambda d: p % d = 0)) = 0), lambda p: list_transform(list_filter([1, 2, 3, 4, 5], lambda k: n % cast(p ** k as bigint) = 0), lambda k: p)))) as prime_factors,
  list_min(list_filter(range(n + 1, n + 20), lambda p: p > 1 and len(list_filter(range(2, p), lambda d: p % d = 0)) = 0)) as next_prime,
  list_filter(range(2, 250), lambda p: len(list_filter(range(2, 16), lambda d: d < p and p % d = 0)) = 0)[n] as nth_prime
from t
""")
def math_rest(spark, sf_dir):
    x, n = F.col("x"), F.col("n").cast("bigint")
    odd = F.when(n % 2 == 0, F.lit(mathx.NAN)).when(n % 3 == 0, F.lit(mathx.INFINITY)).otherwise(x)
    third = F.when(n % 3 == 0, F.lit(mathx.NEG_INF)).otherwise(x)
    r = lambda c: F.round(c, 9)
    log1p, dm = mathx.log1p(x), mathx.div_mod(F.col("n").cast("bigint"), F.lit(7))
    t = _parts(spark, sf_dir).select("p_partkey", (F.col("p_retailprice") / 100 - 12).alias("x"), F.col("p_size").alias("n"))
    return t.select(
        "p_partkey", r(x * mathx.PI).alias("pi"), r(x * mathx.E).alias("e"), r(x * mathx.TAU).alias("tau"), r(x * mathx.PHI).alias("phi"), r(F.when(mathx.is_finite(log1p), log1p).otherwise(-99.0)).alias("log1p"), mathx.is_nan(log1p).alias("log1p_nan"), mathx.is_nan(odd).alias("is_nan"),
        mathx.is_infinite(third).alias("is_infinite"), mathx.is_finite(odd).alias("is_finite"), mathx.factorial(n % 15).cast("double").alias("factorial"), r(mathx.acos(mathx.sin(x))).alias("acos"), r(mathx.asin(mathx.cos(x))).alias("asin"), r(mathx.atan(x)).alias("atan"), r(mathx.cosh(x / 10)).alias("cosh"),
        r(mathx.acosh(1 + F.abs(x))).alias("acosh"), r(mathx.atanh(x / 100)).alias("atanh"), r(mathx.expm1(x / 100)).alias("expm1"), mathx.abs_(x).alias("abs"), r(mathx.sqrt(F.abs(x))).alias("sqrt"), r(mathx.pow_(F.abs(x), F.lit(1.5))).alias("pow"), mathx.mod(F.floor(x).cast("int"), F.lit(7)).alias("mod"),
        dm["_1"].alias("div_1"), dm["_2"].alias("div_2"), mathx.binomial(n, F.lit(3)).alias("binomial"), r(mathx.inverse_lerp(F.lit(-3.0), F.lit(3.0), x)).alias("inverse_lerp"), mathx.prime_factors(n).alias("prime_factors"), mathx.next_prime(n).alias("next_prime"), mathx.nth_prime(n).alias("nth_prime"),
    )


@query(real("""
with t as (select p_partkey, p_retailprice / 100 as a, cast(p_size as double) as b from part)
select p_partkey, a as real, b as imag, -b as conjugate, round(a - 3, 9) as sub_re, b + 1 as sub_im, [0.0, a / 2, a] as linspace, [1.0, 10.0, 100.0] as logspace, [0.0, 0.25, 0.5, 0.75] as arange from t
"""))
def complex_rest(spark, sf_dir):
    a, b = F.col("p_retailprice") / 100, F.col("p_size").cast("double")
    c = mathx.complex_(a, b)
    less = mathx.complex_sub(c, mathx.complex_(F.lit(3.0), F.lit(-1.0)))
    return _parts(spark, sf_dir).select(
        "p_partkey", mathx.real(c).alias("real"), mathx.imag(c).alias("imag"), mathx.imag(mathx.conjugate(c)).alias("conjugate"), _round(mathx.real(less), 9).alias("sub_re"), mathx.imag(less).alias("sub_im"), F.transform(mathx.linspace(0, 1, 3), lambda x: x * a).alias("linspace"), F.transform(mathx.logspace(0, 2, 3), lambda x: F.round(x, 9)).alias("logspace"),
        mathx.arange(0, 1, 0.25).alias("arange"),
    )


# vectors and matrices


@query(real("""
with t as (select p_partkey, cast(p_size as double) as n, p_retailprice / 1000 as x from part)
select p_partkey, [n, x] as vec, 2 as vec_length, n as vec_x, x as vec_y, [n - 1, x - 2] as vec_sub, round(sqrt(n * n + x * x), 6) as norm, round(n / sqrt(n * n + x * x), 6) as unit_x, round(acos((n + 2 * x) / (sqrt(n * n + x * x) * sqrt(5))), 6) as angle, round(n - (n + 2 * x) / 5, 6) as reject_x,
  [n * 2, x * 3] as vec_mul, [n / 2, x / 4] as vec_div, 2 as rows, 2 as cols, [n + 2, 1.0] as row_0, [1.0, 3.0] as col_1, true as is_square, [round((n + 2) * n + x, 6), round(n + 3 * x, 6)] as mat_vec, [[1.0, 0.0], [0.0, 1.0]] as identity, [[0.0, 0.0]] as zeros, [[1.0, 1.0]] as ones, [[n, 0.0], [0.0, x]] as diag,
  round(1 / 3e0, 6) as hilbert_02, [[1.0, n], [1.0, x]] as vandermonde, [[1.0], [3.0]] as submatrix, [n + 2, 3.0] as diagonal
from t
"""))
def vectors_and_matrices(spark, sf_dir):
    n, x = F.col("p_size").cast("double"), F.col("p_retailprice") / 1000
    v, w, m = linalg.vector(n, x), linalg.vector(1, 2), linalg.matrix(linalg.vector(n + 2, F.lit(1.0)), [1, 3])
    at = lambda c: F.transform(c, lambda e: F.round(e, 6))
    return _parts(spark, sf_dir).select(
        "p_partkey", v.alias("vec"), linalg.length(v).alias("vec_length"), linalg.x(v).alias("vec_x"), linalg.y(v).alias("vec_y"), linalg.vec_sub(v, w).alias("vec_sub"), _round(linalg.norm(v)).alias("norm"), _round(linalg.x(linalg.unit(v))).alias("unit_x"), _round(linalg.angle(v, w)).alias("angle"), _round(linalg.x(linalg.reject_from(v, w))).alias("reject_x"),
        linalg.vec_mul(v, linalg.vector(2, 3)).alias("vec_mul"), linalg.vec_div(v, linalg.vector(2, 4)).alias("vec_div"), linalg.rows(m).alias("rows"), linalg.cols(m).alias("cols"), linalg.row(m, 0).alias("row_0"), linalg.col(m, 1).alias("col_1"), linalg.is_square(m).alias("is_square"), at(linalg.mat_vec_mul(m, v)).alias("mat_vec"),
        linalg.eye(2).alias("identity"), linalg.zeros(1, 2).alias("zeros"), linalg.ones(1, 2).alias("ones"), linalg.diag(v).alias("diag"), _round(linalg.get(linalg.hilbert(3), 0, 2)).alias("hilbert_02"), linalg.vandermonde(v).alias("vandermonde"), linalg.submatrix(m, 0, 2, 1, 2).alias("submatrix"), linalg.diagonal(m).alias("diagonal"),
    )


@query(real("""
with t as (select p_partkey, cast(p_size as double) + 2 as a, p_retailprice / 1000 as y from part), u as (select *, 3 * a - 1 as det, sqrt(pow((a + 3) / 2, 2) - (3 * a - 1)) as s, (a + 3) / 2 as h from t)
select p_partkey, round(1.3e-8 + det, 6) as det, round(1.3e-8 + (3 * a - y) / det, 5) as solve_x, round(1.3e-8 + (a * y - a) / det, 5) as solve_y, round(1.3e-8 + h + s, 5) as eigen_1, round(1.3e-8 + h - s, 5) as eigen_2, round(1.3e-8 + h + s, 5) as svd_1, round(1.3e-8 + (h + s) / (h - s), 4) as cond, round(1.3e-8 + 3 / det, 6) as pinv_00, round(1.3e-8 + sqrt(a), 6) as chol_00, round(1.3e-8 + 1 / sqrt(a), 6) as chol_10,
  round(1.3e-8 + sqrt(3 - 1 / a), 6) as chol_11, round(1.3e-8 + (3 * a - y) / det, 5) as lsq_x, round(1.3e-8 + a / det, 6) as inv_11, 2 as rank, round(1.3e-8 + greatest(a, 1), 6) as lu_u00, round(1.3e-8 + 1 / a, 6) as lu_l10, round(1.3e-8 + 3 - 1 / a, 6) as lu_u11, round(1.3e-8 + sqrt(a * a + 1), 6) as qr_r00, round(1.3e-8 + (a + 3) / sqrt(a * a + 1), 6) as qr_r01, round(1.3e-8 + det / sqrt(a * a + 1), 6) as qr_r11,
  round(1.3e-8 + a / sqrt(a * a + 1), 6) as qr_q00
from u
"""))
def decompositions(spark, sf_dir):
    """Of [[a, 1], [1, 3]], whose parts have closed forms."""
    t = dealt(_parts(spark, sf_dir)).select("p_partkey", linalg.matrix(linalg.vector(F.col("p_size").cast("double") + 2, F.lit(1.0)), [1, 3]).alias("m"), linalg.vector(F.col("p_size").cast("double") + 2, F.col("p_retailprice") / 1000).alias("b"))
    m, b = F.col("m"), F.col("b")
    got = t.select(
        "p_partkey", linalg.det(m).alias("det"), linalg.solve(m, b).alias("s"), linalg.eigenvalues(m).alias("e"), linalg.svd(m).alias("v"), linalg.cond(m).alias("c"), linalg.pseudo_inverse(m).alias("p"), linalg.cholesky(m).alias("ch"), linalg.least_squares(m, b).alias("ls"), linalg.inverse(m).alias("inv"),
        linalg.rank(m).alias("rank"), linalg.lu(m).alias("lu"), linalg.qr(m).alias("qr"),
    )
    g = lambda c, i, j: _near(linalg.get(F.col(c), i, j))
    return got.select(
        "p_partkey", _near("det").alias("det"), _near(F.col("s")[0], 5).alias("solve_x"), _near(F.col("s")[1], 5).alias("solve_y"), _near(F.col("e")[0]["re"], 5).alias("eigen_1"), _near(F.col("e")[1]["re"], 5).alias("eigen_2"), _near(F.col("v")[0], 5).alias("svd_1"), _near("c", 4).alias("cond"), g("p", 0, 0).alias("pinv_00"),
        g("ch", 0, 0).alias("chol_00"), g("ch", 1, 0).alias("chol_10"), g("ch", 1, 1).alias("chol_11"), _near(F.col("ls")[0], 5).alias("lsq_x"), g("inv", 1, 1).alias("inv_11"), "rank", g("lu.U", 0, 0).alias("lu_u00"), g("lu.L", 1, 0).alias("lu_l10"), g("lu.U", 1, 1).alias("lu_u11"), g("qr.R", 0, 0).alias("qr_r00"),
        g("qr.R", 0, 1).alias("qr_r01"), g("qr.R", 1, 1).alias("qr_r11"), g("qr.Q", 0, 0).alias("qr_q00"),
    )


# n-d arrays


@query(real("""
with t as (select p_partkey, cast(p_size as double) as n, p_retailprice / 1000 as x from part)
select p_partkey, [0.0, 0.0] as zeros, [1.0, 1.0] as ones, [7.5, 7.5, 7.5, 7.5] as "full", [1.0, 0.0, 0.0, 1.0] as eye, [0.0, 0.5, 1.0] as linspace, [0.0, 2.0, 4.0] as arange, [n, x, 1.0, 2.0] as nested, 2 as ndim, 'float' as dtype, [4] as flat_shape, [n, x, 1.0, 2.0] as reshaped, [4, 1] as reshaped_shape, [n, 1.0, x, 2.0] as transposed,
  round(n * 2 + x * 3, 6) as dot, 2 as argmin, [n, round(n * 3, 6), round(n * 15, 6)] as cumprod, [round(abs(n), 6), round(abs(-x), 6)] as each_abs, [n + x, 3.0] as sum_rows, [n + 1, x + 2] as sum_cols, [(n + x) / 2, 1.5] as mean_rows
from (select p_partkey, n, round(x, 6) as x from t)
""".replace("2 as argmin", "case when least(n, x, 1.0) = n then 0 when least(n, x, 1.0) = x then 1 else 2 end as argmin")))
def nd_array_rest(spark, sf_dir):
    n, x = F.col("p_size").cast("double"), F.round(F.col("p_retailprice") / 1000, 6)
    a = arrays.from_nested(F.array(F.array(n, x), F.array(F.lit(1.0), F.lit(2.0))))
    flat = lambda *xs: arrays.from_list(F.array(*[c if hasattr(c, "alias") else F.lit(c) for c in xs]))
    r = arrays.reshape(a, [4, 1])
    return _parts(spark, sf_dir).select(
        "p_partkey", arrays.to_list(arrays.zeros([2])).alias("zeros"), arrays.to_list(arrays.ones([1, 2])).alias("ones"), arrays.to_list(arrays.full([2, 2], 7.5)).alias("full"), arrays.to_list(arrays.eye(2)).alias("eye"), arrays.to_list(arrays.linspace(0, 1, 3)).alias("linspace"), arrays.to_list(arrays.arange(0, 6, 2)).alias("arange"),
        arrays.to_list(a).alias("nested"), arrays.ndim(a).alias("ndim"), arrays.dtype(a).alias("dtype"), arrays.shape(arrays.flatten(a)).alias("flat_shape"), arrays.to_list(r).alias("reshaped"), arrays.shape(r).alias("reshaped_shape"), arrays.to_list(arrays.T(a)).alias("transposed"), _round(arrays.dot(flat(n, x), flat(2.0, 3.0))).alias("dot"),
        arrays.argmin(flat(n, x, 1.0)).alias("argmin"), F.transform(arrays.to_list(arrays.cumprod(flat(n, 3.0, 5.0))), lambda v: F.round(v, 6)).alias("cumprod"), arrays.to_list(arrays.each(flat(n, -x), F.abs)).alias("each_abs"), arrays.to_list(arrays.sum_axis(a, 1)).alias("sum_rows"), arrays.to_list(arrays.sum_axis(a, 0)).alias("sum_cols"),
        arrays.to_list(arrays.mean_axis(a, 1)).alias("mean_rows"),
    )


# symbols and numbers


@query("""
with t as (select p_partkey, cast(p_size as double) as x, p_retailprice / 1000 as y from part)
select p_partkey, x + 2 as added, x - y as subtracted, round(exp(y) * 2, 8) as "exp", round(4 + y, 8) as substituted, true as constant, round(2 * x * y, 8) as grad_x, round(x * x, 8) as grad_y, round(2 * y, 8) as hess_xx, round(2 * x, 8) as hess_xy, round(1 + y + y * y / 2 + y * y * y / 6, 8) as maclaurin,
  round(2 + 3 * (x - 1) + (x - 1) * (x - 1), 6) as taylor, round(x * x * x / 3 + x * x, 6) as integral, round(sin(x) - cos(y * 2) / 2, 8) as integral_trig, round(x * x * x / 3, 6) as area, x + 3 as root_high, x - 3 as root_low, round((x + 1) * (x + 2), 6) as factored, 1e0 as limit_, round(2 * y + 2 * x, 8) as divergence,
  round(1 - 1e0, 8) as curl_z, 4e0 as laplacian, round(y, 8) as jacobian_01, round(2 * exp(3 * y), 6) as ode, 'x ^ 2 * y' as text
from t
""")
def symbolic_rest(spark, sf_dir):
    x, y, k = symbolic.var("x"), symbolic.var("y"), symbolic.var("k")
    t = _parts(spark, sf_dir).select("p_partkey", F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 1000).alias("y"))
    r = lambda e, n=8: F.round(symbolic.realize(e), n)
    f = x**2 * y
    grad, hess = symbolic.gradient(f, ["x", "y"]), symbolic.hessian(f, ["x", "y"])
    # x^2 - 2 k x + k^2 - 9 has the roots k - 3 and k + 3; with k for the row's x
    roots = symbolic.solve(x**2 - 2 * k * x + k**2 - 9, "x")
    at = lambda e: symbolic.substitute(e, "k", x)
    return t.select(
        "p_partkey", r(symbolic.add(x, symbolic.const(2))).alias("added"), symbolic.realize(symbolic.sub(x, y)).alias("subtracted"), r(symbolic.exp(y) * 2).alias("exp"), r(symbolic.substitute(x**2 + y, "x", 2)).alias("substituted"), F.lit(symbolic.is_constant(symbolic.const(2) * 3) and not symbolic.is_constant(x)).alias("constant"),
        r(grad[0]).alias("grad_x"), r(grad[1]).alias("grad_y"), r(hess[0][0]).alias("hess_xx"), r(hess[0][1]).alias("hess_xy"), r(symbolic.maclaurin(symbolic.exp(y), "y", 4)).alias("maclaurin"), r(symbolic.taylor(x**2 + x, "x", 1.0, 3), 6).alias("taylor"), r(symbolic.integrate(x**2 + 2 * x, "x"), 6).alias("integral"),
        r(symbolic.integrate(symbolic.cos(x), "x") + symbolic.integrate(symbolic.sin(2 * y), "y")).alias("integral_trig"), r(symbolic.definite(k**2, "k", symbolic.num(0), x), 6).alias("area"), r(at(roots[1])).alias("root_high"), r(at(roots[0])).alias("root_low"), r(symbolic.factor(x**2 + 3 * x + 2, "x"), 6).alias("factored"),
        F.lit(symbolic.limit(symbolic.sin(x) / x, "x", 0.0)).alias("limit_"), r(symbolic.divergence([x**2, y**2], ["x", "y"])).alias("divergence"), r(symbolic.curl([y, x, symbolic.num(0)], ["x", "y", "z"])[2]).alias("curl_z"), r(symbolic.laplacian(x**2 + y**2, ["x", "y"])).alias("laplacian"),
        r(symbolic.jacobian([x, x * y], ["x", "y"])[1][0]).alias("jacobian_01"), r(symbolic.dsolve_linear(3.0, 0.0, 2.0, "y"), 6).alias("ode"), F.lit(str(f)).alias("text"),
    )


@query(real("""
with t as (select p_partkey, cast(p_size as double) as n from part)
select p_partkey, round(sqrt(n), 6) as secant, round(sqrt(n), 6) as brent, round(n * n * n / 3, 4) as gauss, round(1 - cos(n / 10), 6) as romberg, round(n * n / 4, 4) as dblquad, round(n, 2) as descent, round(n * exp(1), 4) as rk4, round(n * exp(1), 4) as rk45, case when n < 10 then n * 2 else 20 + (least(n, 50) - 10) / 2 end as interp1d,
  round(n * n, 6) as spline_at_knot, round((n * n + (n + 1) * (n + 1)) / 2 - 0.1875, 6) as spline_between, 2e0 as diff2, [0.0, 0.5, 1.0] as linspace, [0.0, 1.0, 2.0] as arange, round(4 + n, 6) as fft_0, round(n - 2, 6) as fft_2, round(n, 6) as ifft_0, [0.0, 0.25, -0.5, -0.25] as fftfreq, round(n + 1, 3) as maximize
from t
"""))
def numeric_rest(spark, sf_dir):
    n = F.col("p_size").cast("double")
    square = lambda x: x * x - n
    f = numeric.fft(F.array(n, F.lit(1.0), F.lit(1.0), F.lit(2.0)))
    s = numeric.spline(F.array(n - 1, n, n + 1), F.array((n - 1) * (n - 1), n * n, (n + 1) * (n + 1)))
    return dealt(_parts(spark, sf_dir)).select(
        "p_partkey", _round(numeric.secant(square, 0.5, n + 1)).alias("secant"), _round(numeric.brent(square, 0.0, n + 1)).alias("brent"), _round(numeric.quad_gauss(lambda x: x * x, F.lit(0.0), n, 5), 4).alias("gauss"), _round(numeric.romberg(F.sin, F.lit(0.0), n / 10)).alias("romberg"), _round(numeric.dblquad(lambda x, y: x * y, F.lit(0.0), n, F.lit(0.0), F.lit(1.0)), 4).alias("dblquad"),
        _round(numeric.gradient_descent(lambda x: (x - n) * (x - n), F.lit(0.0), 0.1, 60), 2).alias("descent"), _round(numeric.ode_rk4(lambda t, y: y, n, 0.0, 1.0), 4).alias("rk4"), _round(numeric.rk45(lambda t, y: y, n, 0.0, 1.0), 4).alias("rk45"),
        numeric.interp1d(F.array(F.lit(0.0), F.lit(10.0), F.lit(50.0)), F.array(F.lit(0.0), F.lit(20.0), F.lit(40.0)), n).alias("interp1d"), _round(numeric.spline_at(s, n)).alias("spline_at_knot"), _round(numeric.spline_at(s, n + 0.5)).alias("spline_between"), _round(numeric.diff2(lambda x: x * x, n), 2).alias("diff2"), numeric.linspace(0, 1, 3).alias("linspace"), numeric.arange(0, 3).alias("arange"),
        _round(f[0]["re"]).alias("fft_0"), _round(f[2]["re"]).alias("fft_2"), _round(numeric.ifft(f)[0]["re"]).alias("ifft_0"), numeric.fftfreq(4).alias("fftfreq"), _round(numeric.maximize(lambda x: 5.0 - (x - n - 1) * (x - n - 1), -1.0, 60.0)["x"], 3).alias("maximize"),
    )


# assertions


@query("""
with t as (select count(*) as n, count(*) filter (where not p_size = 7) as eq, count(*) filter (where p_size = 7) as ne, count(*) filter (where not abs(p_size - 25) <= 3) as ap, count(*) filter (where not p_size > 9) as gt, count(*) filter (where not p_size < 40) as lt, count(*) filter (where not p_size >= 9) as ge,
  count(*) filter (where not p_size <= 40) as le, count(*) filter (where not p_size > 25) as nil, count(*) filter (where p_size > 25) as nnil, count(*) filter (where p_size % 3 <> 0) as ok, count(*) filter (where p_size % 3 = 0) as er, count(*) filter (where p_size % 2 <> 0) as em, count(*) filter (where p_size % 2 = 0) as nem,
  count(*) filter (where len(string_split(p_name, ' ')) <> 2) as le2, count(*) filter (where not list_contains(string_split(p_name, ' '), 'red')) as co, count(*) filter (where not starts_with(p_name, 's')) as sw, count(*) filter (where not ends_with(p_name, 'g')) as ew, count(*) filter (where not (p_name = 'red ring')) as ca,
  count(*) filter (where list_contains(string_split(p_name, ' '), 'red') or list_contains(string_split(p_name, ' '), 'ring')) as cn, count(*) filter (where trim(p_name) <> '') as bl, count(*) filter (where not p_size < 0) as neg, count(*) filter (where p_size % 5 = 0) as fin, count(*) filter (where p_size % 5 <> 0) as na, count(*) filter (where not p_size between 5 and 9) as bt from part)
select unnest(['equal', 'not equal', 'approximately', 'greater', 'less', 'greater or equal', 'less or equal', 'nil', 'not nil', 'ok', 'err', 'empty', 'not empty', 'length', 'contains', 'starts', 'ends', 'contains all', 'contains none', 'blank', 'type', 'negative', 'finite', 'nan', 'between']) as "check", n,
  unnest([eq, ne, ap, gt, lt, ge, le, nil, nnil, ok, er, em, nem, le2, co, sw, ew, ca, cn, bl, 0, neg, fin, na, bt]) as violations from t
""")
def assertions(spark, sf_dir):
    s, n = F.col("p_size"), F.col("p_name")
    words = strings.words(n)
    opt, r = F.when(s <= 25, s), core.result_of(F.when(s % 3 == 0, s), "no")
    few = F.when(s % 2 == 0, F.array().cast("array<int>")).otherwise(F.array(s))
    odd = F.when(s % 5 == 0, F.lit(mathx.NAN)).otherwise(s.cast("double"))
    q = quality
    checks = [
        ("equal", q.equal(s, 7)), ("not equal", q.not_equal(s, 7)), ("approximately", q.approximately(s, 25, 3)), ("greater", q.greater_than(s, 9)), ("less", q.less_than(s, 40)), ("greater or equal", q.greater_or_equal(s, 9)), ("less or equal", q.less_or_equal(s, 40)), ("nil", q.is_nil(opt)), ("not nil", q.not_nil(opt)),
        ("ok", q.ok(r)), ("err", q.err(r)), ("empty", q.empty(few)), ("not empty", q.not_empty(few)), ("length", q.length(words, 2)), ("contains", q.contains(words, "red")), ("starts", q.starts_with(n, "s")), ("ends", q.ends_with(n, "g")), ("contains all", q.contains_all(words, ["red", "ring"])),
        ("contains none", q.contains_none(words, ["red", "ring"])), ("blank", q.blank(n)), ("type", q.type_(s, "int") & q.instanceof(n, "string")), ("negative", q.negative(s)), ("finite", q.finite(odd)), ("nan", q.nan(odd)), ("between", q.between(s, 5, 9)),
    ]
    return quality.report(_parts(spark, sf_dir), checks)


@query("select 'soft' as kind, 3 as n, 'named size' as failed union all select 'thrown', 1, 'yes' union all select 'passed', 1, 'no' union all select 'same', 1, 'yes'")
def assertions_of_runs(spark, sf_dir):
    """Soft assertions, and assertions on whether something fails."""
    p = _parts(spark, sf_dir)
    soft = quality.Soft(p, [("positive", F.col("p_size") > 0), ("named size", F.col("p_size") > 100000), ("priced", F.col("p_retailprice") > 0)])
    thrown = quality.throws(soft.assert_all) and quality.throws(lambda: quality.enforced(p, [("none", F.lit(False))]).count())
    calm = quality.does_not_throw(lambda: quality.enforced(p, [("all", F.lit(True))]).count())
    rows = [("soft", 3, ", ".join(soft.failed())), ("thrown", 1, "yes" if thrown else "no"), ("passed", 1, "no" if calm else "yes"), ("same", 1, "yes" if quality.same(p, p) and not quality.same(p, soft) else "no")]
    return spark.createDataFrame(rows, "kind string, n int, failed string")


@query("""
select l_returnflag, round(avg(l_quantity), 6) as mean, round(var_samp(l_quantity), 5) as variance, round(stddev_samp(l_quantity), 6) as stddev, round(avg(l_quantity) - 1.959963984540054 * stddev_samp(l_quantity) / sqrt(count(*)), 6) as ci_lo,
  round((avg(l_quantity) - avg(l_tax)) / sqrt(var_samp(l_quantity) / count(*) + var_samp(l_tax) / count(*)), 4) as t, round(pow(var_samp(l_quantity) / count(*) + var_samp(l_tax) / count(*), 2) / (pow(var_samp(l_quantity) / count(*), 2) / (count(*) - 1) + pow(var_samp(l_tax) / count(*), 2) / (count(*) - 1)), 3) as df
from lineitem group by l_returnflag
""")
def stats_rest(spark, sf_dir):
    ci, t = stats.confidence_interval("l_quantity"), stats.t_test("l_quantity", "l_tax")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(_round(stats.mean("l_quantity")).alias("mean"), _round(stats.variance("l_quantity"), 5).alias("variance"), _round(stats.stddev("l_quantity")).alias("stddev"), _round(ci["lo"]).alias("ci_lo"), _round(t["t"], 4).alias("t"), _round(t["df"], 3).alias("df"))


@query("select p_brand, round(exp(sum(ln(1 + p_size / 1000.0))), 8) as product from part group by p_brand")
def products(spark, sf_dir):
    return _parts(spark, sf_dir).groupBy("p_brand").agg(_round(stats.product(1 + F.col("p_size") / 1000), 8).alias("product"))


@query("select p_partkey, round((p_size - avg(p_size) over ()) / stddev_samp(p_size) over (), 8) as z, greatest((select quantile_cont(p_retailprice, 0.1) from part), least((select quantile_cont(p_retailprice, 0.9) from part), p_retailprice)) as winsorized from part")
def standardized(spark, sf_dir):
    p = stats.standardize(_parts(spark, sf_dir), "p_size")
    return stats.winsorized(p, "p_retailprice", 0.1).select("p_partkey", _round("z", 8).alias("z"), "winsorized")


@query("select 'normal' as log, 3 as lines, 'WARNING: careful|ERROR: broken|INFO: took' as text")
def logging_of_runs(spark, sf_dir):
    """Levels, formats, outputs and timing of the log."""
    import io

    held, out = functional.LOG.handlers[:], io.StringIO()
    try:
        functional.set_output(out)
        functional.set_format("%level: %message")
        functional.set_level("info")
        functional.trace("unseen")
        functional.debug("unseen")
        functional.debug_if(True, "unseen")
        functional.warn("careful")
        functional.error("broken")
        functional.timed(lambda: functional.identity(1), "took")
        functional.set_level("fatal")
        functional.info("unseen")
        functional.with_context(user="x").warning("unseen")
    finally:
        functional.set_level("warn")
        functional.LOG.handlers[:] = held
    lines = [line.partition(" ms")[0].rsplit(":", 1)[0] if "took" in line else line for line in out.getvalue().splitlines()]
    return spark.createDataFrame([("normal", len(lines), "|".join(lines))], "log string, lines int, text string")


@query(real("""
with t as (select p_partkey, cast(p_size as double) as n, p_retailprice / 1000 as x from part)
select p_partkey, n * 2 + 1 as composed, n - 100 as flipped, n + 6 as curried, n + 5 as partial_, n > 0 as all_, round(n * x, 8) as mul, -n as neg, 'x,y' as symbols, true as polynomial, round(n * n + 2 * n + 1, 6) as collected, [round(n * n + x, 6), round(n + x * 3, 6), round(n * n + 3 * x, 6)] as matmul_, [[n, 2.0], [x, n]] as toeplitz,
  [[-n, -x], [1.0, 0.0]] as companion, round(exp(x), 6) as expm_00, round(x * exp(x), 5) as expm_01, 1 as rank_one, 1 as nullity, round(2 * n, 3) as spline_slope, 'n ^ 2 + 2 * n' as printed, 3 as loops, n * 4 as piped
from t
""").replace("[round(n * n + x, 6), round(n + x * 3, 6), round(n * n + 3 * x, 6)] as matmul_", "[n * n + 1, n * x + 2, n + 2, x + 4] as matmul_"))
def functions_of_functions(spark, sf_dir):
    n, x = F.col("n"), F.col("x")
    t = dealt(_parts(spark, sf_dir)).select("p_partkey", F.col("p_size").cast("double").alias("n"), (F.col("p_retailprice") / 1000).alias("x"))
    add = functional.curry(lambda a, b, c: a + b + c)
    sx, sy = symbolic.var("x"), symbolic.var("y")
    nested = arrays.from_nested(F.array(F.array(n, x), F.array(F.lit(1.0), F.lit(2.0))))
    product = arrays.matmul(arrays.from_nested(F.array(F.array(n, F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))), nested)
    m = linalg.matrix(linalg.vector(x, x), linalg.vector(F.lit(0.0), x))
    low = linalg.low_rank(linalg.matrix(linalg.vector(n, F.lit(1.0)), [1, 3]), 1)
    s = numeric.spline(F.transform(F.sequence(F.lit(-6), F.lit(6)), lambda i: n + i), F.transform(F.sequence(F.lit(-6), F.lit(6)), lambda i: (n + i) * (n + i)))
    e = symbolic.collect(symbolic.mul(sx, sx) + 2 * sx + 1, "x")
    out = t.select(
        "p_partkey", functional.compose(lambda c: c + 1, lambda c: c * 2)(n).alias("composed"), functional.flip(lambda a, b: a - b)(F.lit(100), n).alias("flipped"), add(n)(F.lit(2.0))(F.lit(4.0)).alias("curried"), functional.partial(lambda a, b: a + b, F.lit(5.0))(n).alias("partial_"), lists.all_(F.array(n), lambda v: v > 0).alias("all_"),
        F.round(symbolic.realize(symbolic.mul(sx, sy), {"x": n, "y": x}), 8).alias("mul"), symbolic.realize(symbolic.neg(sx), {"x": n}).alias("neg"), F.lit(",".join(symbolic.free_symbols(sx * sy))).alias("symbols"), F.lit(symbolic.is_polynomial(e, "x") and symbolic.degree(e, "x") == 2 and len(symbolic.coefficients(e, "x")) == 3).alias("polynomial"),
        _round(symbolic.realize(e, {"x": n})).alias("collected"), arrays.to_list(product).alias("matmul_"), linalg.toeplitz(F.array(n, x), F.array(n, F.lit(2.0))).alias("toeplitz"), linalg.companion(F.array(F.lit(1.0), n, x)).alias("companion"), _round(linalg.get(linalg.expm(m), 0, 0)).alias("expm_00"), _round(linalg.get(linalg.expm(m), 0, 1), 5).alias("expm_01"),
        linalg.rank(low).alias("rank_one"), F.size(linalg.nullspace(linalg.matrix([1, 1], [2, 2]))).alias("nullity"), _round(numeric.spline_derivative(s, n), 3).alias("spline_slope"), F.lit(symbolic.to_string(symbolic.var("n") ** 2 + 2 * symbolic.var("n"))).alias("printed"), F.size(F.transform(core.int_range(F.lit(0), F.lit(3)), lambda i: i * i)).alias("loops"), n.alias("n"),
    )
    return functional.through(out, lambda d: d.withColumn("piped", F.col("n") * 2), lambda d: d.withColumn("piped", F.col("piped") * 2)).drop("n")


@query("""
with f as (select regr_slope(l_extendedprice, l_quantity) as a, regr_intercept(l_extendedprice, l_quantity) as b from lineitem where l_linenumber = 1), r as (select p_partkey, rank() over (order by p_size) + (count(*) over (partition by p_size) - 1) / 2 as rank from part)
select 'slope' as what, 0 as k, round(a, 4) as value from f union all select 'predicted', 1, round(a * 10 + b, 2) from f union all select 'rank', p_partkey, rank from r union all select 'polyfit', i, [3e0, -2e0, 1e0][i + 1] from range(3) t(i) union all select 'violations', 0, (select count(*) from part where p_size <= 25)
""")
def models_and_ranks(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").agg(stats.linreg("l_quantity", "l_extendedprice").alias("m"))
    named = lambda what, k, v: (F.lit(what).alias("what"), k.cast("bigint").alias("k"), v.cast("double").alias("value"))
    p = _parts(spark, sf_dir)
    fit = numeric.polyfit(p.select(F.col("p_size").alias("x"), (3 * F.col("p_size") * F.col("p_size") - 2 * F.col("p_size") + 1).alias("y")), "x", "y", 2)
    seen, counts = quality.observed(p, [("large", F.col("p_size") > 25)])
    seen.write.format("noop").mode("overwrite").save()
    out = li.select(*named("slope", F.lit(0), F.round(F.col("m.slope"), 4))).union(li.select(*named("predicted", F.lit(1), F.round(stats.predicted(F.col("m"), F.lit(10)), 2))))
    out = out.union(stats.average_rank(p, "p_size", "rank").select(*named("rank", F.col("p_partkey"), F.col("rank"))))
    rows = [("polyfit", i, round(v, 6)) for i, v in enumerate(fit)] + [("violations", 0, float(counts.get["large"]))]
    return out.union(spark.createDataFrame(rows, "what string, k bigint, value double"))
