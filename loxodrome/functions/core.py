"""Core builtins over single values: casts with prefix scans, ranges, options, results.

An option is a nullable column; a result is a struct<ok, value, err>.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of Spark's types as scripts see them.
TYPE_NAMES = {"bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "double": "float", "float": "float", "boolean": "bool", "string": "string", "void": "nil", "timestamp": "DateTime", "timestamp_ntz": "DateTime"}


def let(value: Column, use) -> Column:
    """use(value), with value computed once a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def typeof(x: Column) -> Column:
    """int, float, bool, string, nil, DateTime, List, Map or Struct."""
    t = F.typeof(x)
    out = F.when(t.startswith("array"), "List").when(t.startswith("map"), "Map").when(t.startswith("struct"), "Struct").when(t.startswith("interval"), "Duration")
    for name, shown in TYPE_NAMES.items():
        out = out.when(t == name, shown)
    return out.otherwise(t)


def instanceof(x: Column, name: str) -> Column:
    return typeof(x) == F.lit(name)


def byte_length(s: Column) -> Column:
    """len() of a string: its UTF-8 bytes."""
    return F.octet_length(s)


def to_text(x: Column) -> Column:
    """The printed form; nil for null."""
    return F.coalesce(x.cast("string"), F.lit("nil"))


def to_int(x: Column, kind: str = "string") -> Column:
    """int(): numbers are truncated; of strings the leading digits count ("12abc" is 12)."""
    if kind == "string":
        return F.regexp_extract(x, r"^\s*([+-]?\d+)", 1).try_cast("bigint")
    return x.cast("bigint")


def to_float(x: Column, kind: str = "string") -> Column:
    if kind == "string":
        return F.regexp_extract(x, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")
    return x.cast("double")


def to_byte(x: Column) -> Column:
    """0 to 255, an error otherwise."""
    return F.when((x >= 0) & (x <= 255), x.cast("smallint")).otherwise(F.raise_error(F.concat(F.lit("byte out of range: "), x.cast("string"))).cast("smallint"))


def int_range(start: Column, stop: Column, step: int = 1) -> Column:
    """start, start + step, ... before stop; empty if there are none."""
    one = start.cast("bigint")
    last = stop.cast("bigint") - F.lit(1 if step > 0 else -1)
    some = (one <= last) if step > 0 else (one >= last)
    return F.when(some, F.sequence(one, F.when(some, last).otherwise(one), F.lit(step).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def some(x: Column) -> Column:
    """An option is a nullable column: Some of a value is the value, None a null."""
    return x


def println(*values) -> None:
    """The printed values on the driver's output, a blank between; for columns, their names."""
    print(*values)


print_ = lambda *values: print(*values, end="")


def matched(x: Column, *cases: tuple, default: Column | None = None) -> Column:
    """match: the result of the first case (predicate on x, result) that holds, else the default."""
    out = default if default is not None else F.lit(None)
    for test, result in reversed(cases):
        out = F.when(F.coalesce(test(x), F.lit(False)), result).otherwise(out)
    return out


def ok(value: Column) -> Column:
    return F.struct(F.lit(True).alias("ok"), value.alias("value"), F.lit(None).cast("string").alias("err"))


def err(message: Column | str, kind: str = "string") -> Column:
    return F.struct(F.lit(False).alias("ok"), F.lit(None).cast(kind).alias("value"), (F.lit(message) if isinstance(message, str) else message).alias("err"))


def result_of(value: Column, message: Column | str) -> Column:
    """Ok of the value, Err of the message where it is null."""
    text = F.lit(message) if isinstance(message, str) else message
    return F.struct(value.isNotNull().alias("ok"), value.alias("value"), F.when(value.isNull(), text).alias("err"))


def is_some(x: Column) -> Column:
    return x.isNotNull()


def is_none(x: Column) -> Column:
    return x.isNull()


def unwrap(x: Column, kind: str = "string") -> Column:
    """The value of an option, an error where there is none."""
    return F.coalesce(x, F.raise_error(F.lit("unwrap of None")).cast(kind))


def unwrap_or(x: Column, other: Column) -> Column:
    return F.coalesce(x, other)


def is_ok(r: Column) -> Column:
    return r["ok"]


def is_err(r: Column) -> Column:
    return ~r["ok"]


def unwrap_result(r: Column, kind: str = "string") -> Column:
    return F.when(r["ok"], r["value"]).otherwise(F.raise_error(r["err"]).cast(kind))


def truthy(x: Column, kind: str = "bool") -> Column:
    """Null, false, 0 and empty strings and lists are false."""
    if kind == "bool":
        return F.coalesce(x, F.lit(False))
    if kind == "number":
        return F.coalesce(x != 0, F.lit(False))
    if kind == "string":
        return F.coalesce(x != "", F.lit(False))
    return F.coalesce(F.size(x) > 0, F.lit(False))


def int_divide(a: Column, b: Column) -> Column:
    """Truncates towards zero; division by zero is an error."""
    return F.call_function("div", a.cast("bigint"), b.cast("bigint"))


def int_power(a: Column, b: Column) -> Column:
    """Of whole numbers; a negative exponent gives 0."""
    return F.when(b < 0, F.lit(0).cast("bigint")).otherwise(F.aggregate(F.when(b > 0, F.sequence(F.lit(1), F.greatest(b, F.lit(1)).cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(1).cast("bigint"), lambda acc, _: acc * a))


def index_of(a: Column, i: Column) -> Column:
    """a[i]: negative from the end, null out of range."""
    return F.get(a, F.when(i < 0, F.size(a) + i).otherwise(i).cast("int"))


def interpolated(template: str, **values: Column) -> Column:
    """"{name}" in the template stands for the printed value."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[to_text(values[p]) if k % 2 else F.lit(p) for k, p in enumerate(parts)])
