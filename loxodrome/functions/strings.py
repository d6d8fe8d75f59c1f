"""String methods. Lengths and positions of substrings are in bytes, slices in code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loxodrome.functions.core import let, result_of, to_float, to_int

BLANKS = "\\u0009-\\u000D\\u0020\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


length = F.octet_length
uppercase = F.upper
lowercase = F.lower
reverse = F.reverse
repeat = F.repeat


def trim(s: Column) -> Column:
    return F.regexp_replace(s, f"^[{BLANKS}]+|[{BLANKS}]+$", "")


def contains(s: Column, sub) -> Column:
    return F.contains(s, _lit(sub))


def split(s: Column, sep: str) -> Column:
    """At every literal occurrence; "" parts the code points."""
    if sep == "":
        return F.when(F.char_length(s) == 0, F.array().cast("array<string>")).otherwise(F.split(s, ""))
    return F.split(s, r"\Q" + sep.replace(r"\E", r"\E\\E\Q") + r"\E", -1)


def replace(s: Column, old, new) -> Column:
    return F.replace(s, _lit(old), _lit(new))


replace_all = replace


def replace_first(s: Column, old: str, new: str) -> Column:
    at = F.instr(s, old)
    return F.when(at > 0, F.concat(F.substring(s, F.lit(1), at - 1), F.lit(new), F.substring(s, at + len(old), F.char_length(s)))).otherwise(s)


def starts_with(s: Column, p) -> Column:
    return F.startswith(s, _lit(p))


def ends_with(s: Column, p) -> Column:
    return F.endswith(s, _lit(p))


def is_empty(s: Column) -> Column:
    return F.octet_length(s) == 0


def is_blank(s: Column) -> Column:
    return F.octet_length(trim(s)) == 0


def capitalize(s: Column) -> Column:
    """The first code point in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, F.lit(2), F.char_length(s)))


def trim_start(s: Column) -> Column:
    return F.regexp_replace(s, "^[ \\t\\n\\r]+", "")


def trim_end(s: Column) -> Column:
    return F.regexp_replace(s, "[ \\t\\n\\r]+$", "")


def strip(s: Column, chars: str) -> Column:
    return F.btrim(s, F.lit(chars))


def index_of(s: Column, sub: str) -> Column:
    """Bytes before the first occurrence, or null."""
    at = F.instr(s, sub)
    return F.when(at > 0, F.octet_length(F.substring(s, F.lit(1), at - 1)))


def last_index_of(s: Column, sub: str) -> Column:
    at = F.instr(F.reverse(s), sub[::-1])
    return F.when(at > 0, F.octet_length(F.substring(s, F.lit(1), F.char_length(s) - len(sub) - (at - 1)))) if sub else F.octet_length(s)


def count(s: Column, sub: str) -> Column:
    """Occurrences that don't overlap; of "" one more than there are code points."""
    if sub == "":
        return F.char_length(s) + 1
    return F.call_function("div", F.char_length(s) - F.char_length(F.replace(s, F.lit(sub), F.lit(""))), F.lit(len(sub))).cast("int")


def char_at(s: Column, i: int) -> Column:
    return F.nullif(F.substring(s, i + 1, 1), F.lit("")) if i >= 0 else F.lit(None).cast("string")


def substring(s: Column, start, stop) -> Column:
    """Code points from start to before stop, both clamped."""
    n = F.char_length(s)
    a, b = F.least(F.greatest(_lit(start), F.lit(0)), n), F.least(F.greatest(_lit(stop), F.lit(0)), n)
    return F.substring(s, a + 1, F.greatest(b - a, F.lit(0)))


def slice_(s: Column, start: int, stop: int | None = None) -> Column:
    """As substring, with negative positions from the end."""
    n = F.char_length(s)
    a = n + start if start < 0 else F.lit(start)
    b = n if stop is None else n + stop if stop < 0 else F.lit(stop)
    return substring(s, a, b)


def lines(s: Column) -> Column:
    return F.split(s, "\n", -1)


def words(s: Column) -> Column:
    return F.filter(F.split(s, f"[{BLANKS}]+", -1), lambda w: w != "")


def pad_start(s: Column, n: int, ch: str = " ") -> Column:
    """Never cuts; padding of several characters is repeated whole."""
    need = F.lit(n) - F.char_length(s)
    return F.when(need > 0, F.concat(F.repeat(F.lit(ch), F.ceil(need / len(ch)).cast("int")), s)).otherwise(s)


def pad_end(s: Column, n: int, ch: str = " ") -> Column:
    need = F.lit(n) - F.char_length(s)
    return F.when(need > 0, F.concat(s, F.repeat(F.lit(ch), F.ceil(need / len(ch)).cast("int")))).otherwise(s)


def title_case(s: Column) -> Column:
    return F.array_join(F.transform(words(s), capitalize), " ")


def insert(s: Column, i: int, other: str) -> Column:
    at = F.least(F.lit(max(i, 0)), F.char_length(s))
    return F.concat(F.substring(s, F.lit(1), at), F.lit(other), F.substring(s, at + 1, F.char_length(s)))


def remove(s: Column, start: int, stop: int) -> Column:
    n = F.char_length(s)
    a = F.least(F.lit(max(start, 0)), n)
    b = F.greatest(F.least(F.lit(max(stop, 0)), n), a)
    return F.concat(F.substring(s, F.lit(1), a), F.substring(s, b + 1, n))


def matches(s: Column, pattern: str) -> Column:
    """Whether the pattern occurs anywhere."""
    return F.rlike(s, F.lit(pattern))


def find_all(s: Column, pattern: str) -> Column:
    return F.regexp_extract_all(s, F.lit(pattern), 0)


def replace_regex(s: Column, pattern: str, new: str) -> Column:
    return F.regexp_replace(s, pattern, new)


def capture(s: Column, pattern: str) -> Column:
    """The first match and its groups, or null."""
    import re

    groups = re.compile(pattern.replace("(?i:", "(?:")).groups
    return F.when(matches(s, pattern), F.array(*[F.regexp_extract(s, pattern, k) for k in range(groups + 1)]))


def parse_int(s: Column) -> Column:
    return result_of(to_int(trim(s)), F.concat(F.lit("cannot parse int: "), s))


def parse_float(s: Column) -> Column:
    return result_of(to_float(trim(s)), F.concat(F.lit("cannot parse float: "), s))


def parse_bool(s: Column) -> Column:
    t = F.lower(trim(s))
    return result_of(F.when(t.isin("true", "1", "yes"), True).when(t.isin("false", "0", "no"), False), F.concat(F.lit("cannot parse bool: "), s))


to_int_result, to_float_result = parse_int, parse_float


def join(a: Column, sep: str = "") -> Column:
    return F.array_join(F.transform(a, lambda x: F.coalesce(x.cast("string"), F.lit("nil"))), sep)


def split_at(s: Column, i: int) -> Column:
    """The code points before i and those from i on."""
    return F.array(substring(s, 0, i), substring(s, i, F.char_length(s)))


def format_(template: str, *values: Column) -> Column:
    return F.format_string(template, *values)


def first_words(s: Column, n: int) -> Column:
    return let(words(s), lambda w: F.array_join(F.slice(w, 1, n), " "))
