"""Symbolic expressions: trees that are differentiated and simplified on the driver and compiled to columns.

Literals are parsed from infix text; ``realize`` gives a column (whole-stage code) or a number.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from loxodrome.functions import mathx

FUNCTIONS = {
    "sin": (F.sin, math.sin), "cos": (F.cos, math.cos), "tan": (F.tan, math.tan), "asin": (F.asin, math.asin), "acos": (F.acos, math.acos), "atan": (F.atan, math.atan),
    "exp": (F.exp, math.exp), "log": (mathx.log, math.log), "ln": (mathx.log, math.log), "sqrt": (F.sqrt, math.sqrt), "abs": (F.abs, abs),
}
RANK = {"+": 1, "-": 1, "*": 2, "/": 2, "neg": 3, "^": 4}


@dataclass(frozen=True)
class Expr:
    """op: num, var, + - * / ^ neg or a function's name; args: operands, or the value or name."""

    op: str
    args: tuple

    def __add__(self, o):
        return Expr("+", (self, lift(o)))

    def __radd__(self, o):
        return Expr("+", (lift(o), self))

    def __sub__(self, o):
        return Expr("-", (self, lift(o)))

    def __rsub__(self, o):
        return Expr("-", (lift(o), self))

    def __mul__(self, o):
        return Expr("*", (self, lift(o)))

    def __rmul__(self, o):
        return Expr("*", (lift(o), self))

    def __truediv__(self, o):
        return div(self, o)

    def __rtruediv__(self, o):
        return div(o, self)

    def __pow__(self, o):
        return Expr("^", (self, lift(o)))

    def __neg__(self):
        return Expr("neg", (self,))

    def __str__(self):
        return to_string(self)


def lift(x) -> Expr:
    return x if isinstance(x, Expr) else num(x)


def var(name: str) -> Expr:
    return Expr("var", (name,))


def num(v) -> Expr:
    return Expr("num", (float(v),))


const = num


def add(a, b) -> Expr:
    return lift(a) + b


def sub(a, b) -> Expr:
    return lift(a) - b


def mul(a, b) -> Expr:
    return lift(a) * b


def div(a, b) -> Expr:
    if lift(b) == num(0):
        raise ZeroDivisionError("division by zero")
    return Expr("/", (lift(a), lift(b)))


def pow_(a, b) -> Expr:
    return lift(a) ** b


def neg(a) -> Expr:
    return -lift(a)


def call(name: str, a) -> Expr:
    return Expr(name, (lift(a),))


def sin(a) -> Expr:
    return call("sin", a)


def cos(a) -> Expr:
    return call("cos", a)


def exp(a) -> Expr:
    return call("exp", a)


def log(a) -> Expr:
    return call("log", a)


def sqrt(a) -> Expr:
    return call("sqrt", a)


def parse(text: str) -> Expr:
    """Infix with + - * / ^ (right to left), unary minus, calls and parentheses."""
    tokens = re.findall(r"\d+\.?\d*(?:[eE][-+]?\d+)?|\.\d+|[A-Za-z_]\w*|[-+*/^()]", text)
    at = 0

    def peek() -> str:
        return tokens[at] if at < len(tokens) else ""

    def take() -> str:
        nonlocal at
        at += 1
        return tokens[at - 1]

    def atom() -> Expr:
        t = take()
        if t == "(":
            e = climb(1)
            take()
            return e
        if t == "-":
            return neg(climb(3))
        if t[0].isdigit() or t[0] == ".":
            return num(t)
        if peek() == "(":
            take()
            e = call(t, climb(1))
            take()
            return e
        return {"pi": num(math.pi), "e": num(math.e)}.get(t, var(t))

    def climb(least: int) -> Expr:
        left = atom()
        while peek() in RANK and RANK[peek()] >= least:
            op = take()
            left = Expr(op, (left, climb(RANK[op] + (op != "^"))))
        return left

    return climb(1)


def is_num(e: Expr, v: float | None = None) -> bool:
    return e.op == "num" and (v is None or e.args[0] == v)


def _simple(e: Expr) -> Expr:
    """One node whose operands are simple."""
    if e.op in ("num", "var"):
        return e
    if all(is_num(a) for a in e.args):
        try:
            return num(value(e, {}))
        except (ValueError, ZeroDivisionError, OverflowError):
            return e
    a, b = e.args[0], e.args[-1]
    zero, one = num(0), num(1)
    if e.op == "+":
        return b if is_num(a, 0) else a if is_num(b, 0) else mul(2, a) if a == b else e
    if e.op == "-":
        return a if is_num(b, 0) else neg(b) if is_num(a, 0) else zero if a == b else e
    if e.op == "*":
        if is_num(a, 0) or is_num(b, 0):
            return zero
        return b if is_num(a, 1) else a if is_num(b, 1) else neg(b) if is_num(a, -1) else pow_(a, 2) if a == b else e
    if e.op == "/":
        return zero if is_num(a, 0) else a if is_num(b, 1) else one if a == b else e
    if e.op == "^":
        return one if is_num(b, 0) else a if is_num(b, 1) else zero if is_num(a, 0) else one if is_num(a, 1) else e
    if e.op == "neg" and a.op == "neg":
        return a.args[0]
    if e.op in ("log", "ln") and a.op == "exp" or e.op == "exp" and a.op in ("log", "ln"):
        return a.args[0]
    return e


def simplify(e: Expr) -> Expr:
    """Identities and constants, from the leaves up."""
    return e if e.op in ("num", "var") else _simple(Expr(e.op, tuple(simplify(a) for a in e.args)))


def _slope(e: Expr, x: str) -> Expr:
    if e.op == "num":
        return num(0)
    if e.op == "var":
        return num(1 if e.args[0] == x else 0)
    a, d = e.args[0], [_slope(v, x) for v in e.args]
    b = e.args[-1]
    if e.op in ("+", "-"):
        return Expr(e.op, (d[0], d[1]))
    if e.op == "*":
        return d[0] * b + a * d[1]
    if e.op == "/":
        return (d[0] * b - a * d[1]) / pow_(b, 2)
    if e.op == "neg":
        return -d[0]
    if e.op == "^":
        if x not in free_symbols(b):
            return b * pow_(a, b - 1) * d[0]
        if x not in free_symbols(a):
            return e * log(a) * d[1]
        return e * (d[1] * log(a) + b * d[0] / a)
    outer = {
        "sin": lambda: cos(a), "cos": lambda: -sin(a), "tan": lambda: num(1) / pow_(cos(a), 2), "exp": lambda: e, "log": lambda: num(1) / a, "ln": lambda: num(1) / a,
        "sqrt": lambda: num(1) / (2 * e), "abs": lambda: a / e, "asin": lambda: num(1) / sqrt(1 - pow_(a, 2)), "acos": lambda: -(num(1) / sqrt(1 - pow_(a, 2))), "atan": lambda: num(1) / (1 + pow_(a, 2)),
    }.get(e.op)
    return outer() * d[0] if outer else num(0)


def diff(e: Expr, x: str) -> Expr:
    """The derivative, simplified; functions that aren't known count as constant."""
    return simplify(_slope(e, x))


def gradient(e: Expr, names: list[str]) -> list[Expr]:
    return [diff(e, n) for n in names]


def hessian(e: Expr, names: list[str]) -> list[list[Expr]]:
    return [[diff(diff(e, a), b) for b in names] for a in names]


def expand(e: Expr) -> Expr:
    """Products over sums and whole powers of sums multiplied out."""
    if e.op in ("num", "var"):
        return e
    args = [expand(a) for a in e.args]
    if e.op == "^" and is_num(args[1]) and args[1].args[0] in (2.0, 3.0, 4.0, 5.0) and args[0].op in ("+", "-"):
        out = args[0]
        for _ in range(int(args[1].args[0]) - 1):
            out = expand(out * args[0])
        return out
    if e.op == "*":
        a, b = args
        for s, o, first in ((a, b, True), (b, a, False)):
            if s.op in ("+", "-"):
                l, r = ((v * o) if first else (o * v) for v in s.args)
                return simplify(Expr(s.op, (expand(l), expand(r))))
    return simplify(Expr(e.op, tuple(args)))


def substitute(e: Expr, name: str, v, simple: bool = True) -> Expr:
    def walk(t: Expr) -> Expr:
        if t.op == "var":
            return lift(v) if t.args[0] == name else t
        return t if t.op == "num" else Expr(t.op, tuple(walk(a) for a in t.args))

    out = walk(e)
    return simplify(out) if simple else out


def free_symbols(e: Expr) -> list[str]:
    """Sorted; also the columns that a compiled expression reads."""
    if e.op == "var":
        return [e.args[0]]
    return [] if e.op == "num" else sorted({n for a in e.args for n in free_symbols(a)})


def is_constant(e: Expr) -> bool:
    return not free_symbols(e)


def value(e: Expr, values: dict[str, float]) -> float:
    if e.op == "num":
        return e.args[0]
    if e.op == "var":
        return float(values[e.args[0]])
    a = [value(v, values) for v in e.args]
    two = {"+": lambda: a[0] + a[1], "-": lambda: a[0] - a[1], "*": lambda: a[0] * a[1], "/": lambda: a[0] / a[1], "^": lambda: a[0] ** a[1], "neg": lambda: -a[0]}
    return two[e.op]() if e.op in two else FUNCTIONS[e.op][1](a[0])


def realize(e: Expr, columns: dict[str, Column] | None = None) -> Column:
    """The expression as a column; variables are the columns given, or those of their names."""
    if e.op == "num":
        return F.lit(e.args[0])
    if e.op == "var":
        return ((columns or {}).get(e.args[0]) if columns and e.args[0] in columns else F.col(e.args[0])).cast("double")
    a = [realize(v, columns) for v in e.args]
    two = {"+": lambda: a[0] + a[1], "-": lambda: a[0] - a[1], "*": lambda: a[0] * a[1], "/": lambda: a[0] / a[1], "^": lambda: F.pow(a[0], a[1]), "neg": lambda: -a[0]}
    return two[e.op]() if e.op in two else FUNCTIONS[e.op][0](a[0])


def to_string(e: Expr, above: int = 0) -> str:
    if e.op == "num":
        return f"{e.args[0]:g}"
    if e.op == "var":
        return e.args[0]
    if e.op not in RANK:
        return f"{e.op}({to_string(e.args[0])})"
    rank = RANK[e.op]
    text = f"-{to_string(e.args[0], rank)}" if e.op == "neg" else f"{to_string(e.args[0], rank + (e.op == '^'))} {e.op} {to_string(e.args[1], rank + (e.op in '-/'))}"
    return f"({text})" if rank < above else text


def taylor(e: Expr, x: str, at: float, terms: int) -> Expr:
    """The sum of the first terms about a point."""
    out, d = num(0), e
    for k in range(terms):
        out = out + num(value(substitute(d, x, at), {}) / math.factorial(k)) * pow_(var(x) - at, k)
        d = diff(d, x)
    return simplify(out)


def maclaurin(e: Expr, x: str, terms: int) -> Expr:
    return taylor(e, x, 0.0, terms)


# vector analysis


def jacobian(es: list[Expr], names: list[str]) -> list[list[Expr]]:
    return [gradient(lift(e), names) for e in es]


def divergence(es: list[Expr], names: list[str]) -> Expr:
    out = num(0)
    for e, n in zip(es, names, strict=True):
        out = out + diff(lift(e), n)
    return simplify(out)


def curl(es: list[Expr], names: list[str]) -> list[Expr]:
    """Of three expressions of three variables."""
    d = lambda i, j: diff(lift(es[i]), names[j])
    return [simplify(d((k + 2) % 3, (k + 1) % 3) - d((k + 1) % 3, (k + 2) % 3)) for k in range(3)]


def laplacian(e: Expr, names: list[str]) -> Expr:
    return divergence(gradient(e, names), names)


# polynomials in one variable, whose coefficients are expressions of the others


def coefficients(e: Expr, x: str) -> list[Expr] | None:
    """From the constant term up; None if the expression is no polynomial in x."""
    if x not in free_symbols(e):
        return [e]
    if e.op == "var":
        return [num(0), num(1)]
    if e.op == "neg":
        inner = coefficients(e.args[0], x)
        return inner and [simplify(-c) for c in inner]
    if e.op not in ("+", "-", "*", "/", "^"):
        return None
    a, b = coefficients(e.args[0], x), coefficients(e.args[1], x)
    if a is None or b is None:
        return None
    if e.op in ("+", "-"):
        n = max(len(a), len(b))
        a, b = a + [num(0)] * (n - len(a)), b + [num(0)] * (n - len(b))
        return [simplify(Expr(e.op, (p, q))) for p, q in zip(a, b, strict=True)]
    if e.op == "/":
        return [simplify(c / b[0]) for c in a] if len(b) == 1 else None
    if e.op == "*":
        return _product(a, b)
    if len(b) > 1 or not is_num(b[0]) or b[0].args[0] != int(b[0].args[0]) or b[0].args[0] < 0:
        return None
    out = [num(1)]
    for _ in range(int(b[0].args[0])):
        out = _product(out, a)
    return out


def _product(a: list[Expr], b: list[Expr]) -> list[Expr]:
    out = [num(0)] * (len(a) + len(b) - 1)
    for i, p in enumerate(a):
        for j, q in enumerate(b):
            out[i + j] = simplify(out[i + j] + p * q)
    return out


def is_polynomial(e: Expr, x: str) -> bool:
    return coefficients(e, x) is not None


def degree(e: Expr, x: str) -> int | None:
    c = coefficients(e, x)
    return None if c is None else max((i for i, v in enumerate(c) if not is_num(v, 0)), default=0)


def collect(e: Expr, x: str) -> Expr:
    """The polynomial as a sum of powers of x."""
    c = coefficients(e, x)
    if c is None:
        return e
    out = num(0)
    for i, v in enumerate(c):
        out = out + v * pow_(var(x), i)
    return simplify(out)


def solve(e: Expr, x: str) -> list[Expr]:
    """The real roots in x, ascending where they are numbers: by formula up to the second degree, numerically for higher degrees with numbers for coefficients. A ValueError for other equations."""
    c = coefficients(e, x)
    n = degree(e, x)
    if c is None or n == 0 or n > 2 and not all(is_num(v) for v in c):
        raise ValueError(f"cannot solve {e} for {x}")
    if n == 1:
        return [simplify(-c[0] / c[1])]
    if n == 2:
        d = expand(simplify(pow_(c[1], 2) - 4 * c[2] * c[0]))
        if is_num(d) and d.args[0] < 0:
            return []
        return [simplify((-c[1] - sqrt(d)) / (2 * c[2])), simplify((-c[1] + sqrt(d)) / (2 * c[2]))]
    import numpy as np

    roots = np.roots([v.args[0] for v in c[: n + 1]][::-1])
    return [num(float(r)) for r in sorted(roots[np.abs(roots.imag) < 1e-9].real)]


def factor(e: Expr, x: str) -> Expr:
    """The leading coefficient times a factor for each root, where all roots are real numbers; else the expression."""
    c, n = coefficients(e, x), degree(e, x)
    if c is None or not n or not all(is_num(v) for v in c):
        return e
    roots = solve(e, x)
    if len(roots) < n:
        return e
    out = c[n]
    for r in roots:
        out = out * simplify(var(x) - num(round(r.args[0], 12)))
    return simplify(out)


def cancelled(e: Expr, x: str) -> Expr:
    """A quotient of polynomials without their common real roots."""
    if e.op != "/" or degree(e.args[0], x) is None or degree(e.args[1], x) is None:
        return e
    tops, downs = ([round(r.args[0], 9) for r in solve(a, x)] if degree(a, x) else [] for a in e.args)
    lead = [coefficients(a, x)[degree(a, x)] for a in e.args]
    for r in list(tops):
        if r in downs:
            tops.remove(r)
            downs.remove(r)
    sides = []
    for first, roots in zip(lead, (tops, downs), strict=True):
        for r in roots:
            first = first * simplify(var(x) - num(r))
        sides.append(simplify(first))
    return simplify(Expr("/", tuple(sides)))


# integrals and limits


def integrate(e: Expr, x: str) -> Expr:
    """An antiderivative: of sums, multiples, powers, and of sin, cos, exp, 1/x and square roots of linear arguments. A ValueError for others."""
    e = simplify(e)
    if x not in free_symbols(e):
        return simplify(e * var(x))
    c = coefficients(e, x)
    if c is not None:
        out = num(0)
        for i, v in enumerate(c):
            out = out + v * pow_(var(x), i + 1) / num(i + 1)
        return simplify(out)
    if e.op in ("+", "-"):
        return simplify(Expr(e.op, (integrate(e.args[0], x), integrate(e.args[1], x))))
    if e.op == "neg":
        return simplify(-integrate(e.args[0], x))
    if e.op == "*":
        for a, b in (e.args, e.args[::-1]):
            if x not in free_symbols(a):
                return simplify(a * integrate(b, x))
    if e.op == "/" and x not in free_symbols(e.args[1]):
        return simplify(integrate(e.args[0], x) / e.args[1])
    if e.op == "/" and x not in free_symbols(e.args[0]) and degree(e.args[1], x) == 1:
        return simplify(e.args[0] * log(call("abs", e.args[1])) / coefficients(e.args[1], x)[1])
    inner = e.args[0]
    if degree(inner, x) == 1:
        slope = coefficients(inner, x)[1]
        of = {"sin": lambda: -cos(inner), "cos": lambda: sin(inner), "exp": lambda: e, "sqrt": lambda: num(2 / 3) * pow_(inner, 1.5)}.get(e.op)
        if of:
            return simplify(of() / slope)
        if e.op == "^" and is_num(e.args[1]) and e.args[1].args[0] != -1:
            return simplify(pow_(inner, e.args[1].args[0] + 1) / (num(e.args[1].args[0] + 1) * slope))
    raise ValueError(f"cannot integrate {e}")


def definite(e: Expr, x: str, a, b) -> Expr:
    """The integral from a to b."""
    f = integrate(e, x)
    return simplify(substitute(f, x, b) - substitute(f, x, a))


def limit(e: Expr, x: str, at: float) -> float:
    """The value that both sides come to; by differentiating numerator and denominator while both vanish. NaN if the sides differ."""
    for _ in range(6):
        try:
            return value(e, {x: at})
        except (ZeroDivisionError, ValueError, OverflowError):
            pass
        if e.op != "/":
            break
        try:
            top, down = (value(a, {x: at}) for a in e.args)
        except (ZeroDivisionError, ValueError, OverflowError):
            break
        if abs(top) > 1e-12 or abs(down) > 1e-12:
            break
        e = simplify(Expr("/", (diff(e.args[0], x), diff(e.args[1], x))))
    left, right = (value(e, {x: at + s * 1e-7}) for s in (-1, 1))
    return (left + right) / 2 if abs(left - right) < 1e-4 * max(1, abs(left)) else math.nan


def dsolve_linear(a: float, b: float, y0: float, t: str = "t") -> Expr:
    """The solution of y' = a y + b with y = y0 at 0."""
    if a == 0:
        return simplify(num(y0) + num(b) * var(t))
    return simplify(num(y0 + b / a) * exp(num(a) * var(t)) - num(b / a))


def rationalize(e: Expr) -> Expr:
    """a / sqrt(b) as a sqrt(b) / b."""
    if e.op == "/" and e.args[1].op == "sqrt":
        return simplify(e.args[0] * e.args[1] / e.args[1].args[0])
    return e


def to_latex(e: Expr) -> str:
    if e.op == "/":
        return rf"\frac{{{to_latex(e.args[0])}}}{{{to_latex(e.args[1])}}}"
    if e.op == "sqrt":
        return rf"\sqrt{{{to_latex(e.args[0])}}}"
    if e.op == "^":
        base = to_latex(e.args[0])
        return f"{base if e.args[0].op in ('num', 'var') else f'({base})'}^{{{to_latex(e.args[1])}}}"
    if e.op in ("+", "-", "*"):
        side = lambda a: f"({to_latex(a)})" if e.op != "+" and a.op in ("+", "-") else to_latex(a)
        return f"{side(e.args[0])}{' ' if e.op == '*' else f' {e.op} '}{side(e.args[1])}"
    return to_string(e) if e.op in ("num", "var") else f"-{to_latex(e.args[0])}" if e.op == "neg" else rf"\{e.op}({to_latex(e.args[0])})"
