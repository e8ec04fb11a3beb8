"""Column selectors: functions of a schema that name columns; they combine with | & - ~."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

Test = Callable[[int, T.StructField, int], bool]


@dataclass(frozen=True)
class Selector:
    """Chooses columns by position, field and number of columns."""

    test: Test

    def names(self, df: DataFrame) -> list[str]:
        n = len(df.columns)
        return [f.name for k, f in enumerate(df.schema) if self.test(k, f, n)]

    def select(self, df: DataFrame) -> DataFrame:
        return df.select(*(f"`{c}`" for c in self.names(df)))

    def __or__(self, other: "Selector") -> "Selector":
        return Selector(lambda *a: self.test(*a) or other.test(*a))

    def __and__(self, other: "Selector") -> "Selector":
        return Selector(lambda *a: self.test(*a) and other.test(*a))

    def __sub__(self, other: "Selector") -> "Selector":
        return Selector(lambda *a: self.test(*a) and not other.test(*a))

    def __invert__(self) -> "Selector":
        return Selector(lambda *a: not self.test(*a))


def _kind(*types: type) -> Callable[[], Selector]:
    return lambda: Selector(lambda k, f, n: isinstance(f.dataType, types))


def _absent(what: str) -> Callable[[], Selector]:
    def none() -> Selector:
        raise TypeError(f"Spark has no {what}")

    return none


def _chars(test: Callable[[str], bool], ascii_only: bool, ignore_spaces: bool) -> Selector:
    def fits(k, f, n):
        name = f.name.replace(" ", "") if ignore_spaces else f.name
        return bool(name) and all(test(c) and (not ascii_only or c.isascii()) for c in name)

    return Selector(fits)


def all_() -> Selector:
    return Selector(lambda *a: True)


def empty() -> Selector:
    return Selector(lambda *a: False)


def alpha(ascii_only: bool = False, ignore_spaces: bool = False) -> Selector:
    return _chars(str.isalpha, ascii_only, ignore_spaces)


def alphanumeric(ascii_only: bool = False, ignore_spaces: bool = False) -> Selector:
    return _chars(str.isalnum, ascii_only, ignore_spaces)


def digit(ascii_only: bool = False) -> Selector:
    return _chars(str.isdecimal, ascii_only, False)


def by_name(*names: str, strict: bool = True) -> Selector:
    return Selector(lambda k, f, n: f.name in names)


def exclude(*names: str) -> Selector:
    return ~by_name(*names)


def by_index(*positions: int) -> Selector:
    return Selector(lambda k, f, n: k in positions or k - n in positions)


def by_dtype(*names: str) -> Selector:
    from millrace.functions.convert import dtype

    kinds = [dtype(x) for x in names]
    return Selector(lambda k, f, n: f.dataType in kinds)


def contains(*parts: str) -> Selector:
    return Selector(lambda k, f, n: any(p in f.name for p in parts))


def starts_with(*parts: str) -> Selector:
    return Selector(lambda k, f, n: f.name.startswith(parts))


def ends_with(*parts: str) -> Selector:
    return Selector(lambda k, f, n: f.name.endswith(parts))


def matches(pattern: str) -> Selector:
    return Selector(lambda k, f, n: re.search(pattern, f.name) is not None)


def first(n: int = 1) -> Selector:
    return Selector(lambda k, f, size: k < n)


def last(n: int = 1) -> Selector:
    return Selector(lambda k, f, size: k >= size - n)


binary = _kind(T.BinaryType)
boolean = _kind(T.BooleanType)
date = _kind(T.DateType)
datetime = _kind(T.TimestampType, T.TimestampNTZType)
decimal = _kind(T.DecimalType)
duration = _kind(T.DayTimeIntervalType)
float_ = _kind(T.FloatType, T.DoubleType)
integer = _kind(T.ByteType, T.ShortType, T.IntegerType, T.LongType)
signed_integer = integer
unsigned_integer = _absent("unsigned integers")
list_ = _kind(T.ArrayType)
array = _kind(T.ArrayType)
struct = _kind(T.StructType)
nested = _kind(T.ArrayType, T.MapType, T.StructType)
numeric = _kind(T.NumericType)
string = _kind(T.StringType)
categorical = _absent("categories")
enum = _absent("enumerations")
object_ = _kind(T.VariantType)
temporal = _kind(T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType)
