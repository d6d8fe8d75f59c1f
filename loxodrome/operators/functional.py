"""Functions on columns and frames: composition, partial application, pipelines, logging of runs."""

from __future__ import annotations

import functools
import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame

LOG = logging.getLogger("loxodrome")
partial = functools.partial


def identity(x):
    return x


def compose(*fs: Callable) -> Callable:
    """compose(f, g)(x) is f(g(x))."""
    return functools.reduce(lambda f, g: lambda *a: f(g(*a)), fs)


def pipe(*fs: Callable) -> Callable:
    """pipe(f, g)(x) is g(f(x))."""
    return compose(*reversed(fs))


def flip(f: Callable) -> Callable:
    return lambda a, b, *rest: f(b, a, *rest)


def curry(f: Callable, n: int | None = None) -> Callable:
    """Takes its arguments one or several at a time until it has n of them."""
    n = f.__code__.co_argcount if n is None else n

    def more(*got):
        return f(*got) if len(got) >= n else lambda *a: more(*got, *a)

    return more


def through(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """df |> step |> step."""
    for step in steps:
        df = df.transform(step)
    return df


def set_level(level: str) -> None:
    """trace debug info warn error fatal."""
    LOG.setLevel({"trace": 5, "warn": "WARNING", "fatal": "CRITICAL"}.get(level.lower(), level.upper()))


def set_format(template: str) -> None:
    """%level and %message stand for themselves."""
    form = logging.Formatter(template.replace("%level", "%(levelname)s").replace("%message", "%(message)s"))
    for handler in LOG.handlers or [add_output()]:
        handler.setFormatter(form)


def add_output(stream=None) -> logging.Handler:
    handler = logging.StreamHandler(stream)
    LOG.addHandler(handler)
    return handler


def set_output(stream=None) -> logging.Handler:
    LOG.handlers.clear()
    return add_output(stream)


def trace(*message) -> None:
    LOG.log(5, " ".join(map(str, message)))


def debug(*message) -> None:
    LOG.debug(" ".join(map(str, message)))


def debug_if(condition: bool, *message) -> None:
    if condition:
        debug(*message)


def info(*message) -> None:
    LOG.info(" ".join(map(str, message)))


def warn(*message) -> None:
    LOG.warning(" ".join(map(str, message)))


def error(*message) -> None:
    LOG.error(" ".join(map(str, message)))


def fatal(*message) -> None:
    LOG.critical(" ".join(map(str, message)))


def with_context(**values) -> logging.LoggerAdapter:
    return logging.LoggerAdapter(LOG, values)


def timed(f: Callable, label: str = "timed"):
    """f(), with its time logged."""
    began = time.perf_counter()
    try:
        return f()
    finally:
        info(f"{label}: {(time.perf_counter() - began) * 1000:.1f} ms")
