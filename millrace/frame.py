"""Frame: the operators as methods of one object, so that pipelines read from left to right."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.operators import apply, grouping, joins, predicates, projection, rows, sets, windows
from millrace.plans import sql as sql_

_MODULES = (apply, projection, predicates, joins, grouping, windows, rows, sets)


class Frame:
    """A DataFrame with the operators of this package as methods.

    Every function of the operator modules whose first argument is a table is a method here; one
    that returns a table gives a Frame. `df` is the DataFrame itself; nothing runs before an action.
    """

    def __init__(self, df: DataFrame):
        self.df = df

    @classmethod
    def open(cls, spark: SparkSession, *paths: str, **options) -> "Frame":
        from millrace.sources.files import open_

        return cls(open_(spark, *paths, **options))

    def query(self, text: str, **others: "Frame | DataFrame") -> "Frame":
        """SQL in which `df` is this frame."""
        return Frame(sql_.query(self.df, text, **{k: _plain(v) for k, v in others.items()}))

    def save(self, path: str, **options) -> None:
        from millrace.sources.files import save

        save(self.df, path, **options)

    def pipe(self, fn: Callable, *args, **options):
        """Apply any function of a DataFrame."""
        return _wrapped(fn(self.df, *map(_plain, args), **{k: _plain(v) for k, v in options.items()}))

    def __getattr__(self, name: str):
        fn = _METHODS.get(name)
        if fn is None:
            raise AttributeError(name)
        return lambda *args, **options: self.pipe(fn, *args, **options)

    def __dir__(self):
        return [*super().__dir__(), *_METHODS]


def _plain(x):
    return x.df if isinstance(x, Frame) else x


def _wrapped(x):
    return Frame(x) if isinstance(x, DataFrame) else x


def _methods() -> dict[str, Callable]:
    out = {}
    for module in _MODULES:
        for name, fn in vars(module).items():
            if name.startswith("_") or not inspect.isfunction(fn):
                continue
            first = next(iter(inspect.signature(fn).parameters.values()), None)
            if first is not None and first.annotation == "DataFrame":
                out[name] = fn
    return out


_METHODS = _methods()
