"""Array and map helpers as Column expressions; positions count from 0."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def item(a: Column, i: int) -> Column:
    """The i-th value; an error beyond the end."""
    return F.element_at(a, i + 1)


def last(a: Column) -> Column:
    """The last value, null if there is none."""
    return F.try_element_at(a, F.lit(-1))


def count(a: Column, condition: Callable[[Column], Column] | None = None) -> Column:
    return F.size(a if condition is None else F.filter(a, condition))


def any_of(a: Column, condition: Callable[[Column], Column] | None = None) -> Column:
    return F.size(a) > 0 if condition is None else F.exists(a, condition)


def contains(a: Column, value: Column) -> Column:
    return F.array_contains(a, value)


def add(a: Column, value: Column) -> Column:
    return F.array_append(a, value)


def add_range(a: Column, values: Column) -> Column:
    return F.concat(a, values)


def insert(a: Column, values: Column, at: int) -> Column:
    """values (an array) before position at."""
    return F.concat(F.slice(a, 1, at), values, F.slice(a, F.lit(at + 1), F.greatest(F.size(a) - at, F.lit(0))))


def remove_first(a: Column, value: Column) -> Column:
    """Without the first occurrence of the value."""
    at = F.array_position(a, value).cast("int")
    return F.when(at == 0, a).otherwise(F.concat(F.slice(a, F.lit(1), at - 1), F.slice(a, at + 1, F.size(a) - at)))


def remove_where(a: Column, condition: Callable[[Column], Column]) -> Column:
    return F.filter(a, lambda x: ~condition(x))


def remove_range(a: Column, at: int, n: int = 1) -> Column:
    return F.concat(F.slice(a, 1, at), F.slice(a, F.lit(at + n + 1), F.greatest(F.size(a) - at - n, F.lit(0))))


def remove_last(a: Column) -> Column:
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))


def sort(a: Column, key: Callable[[Column], Column] | None = None) -> Column:
    """Ascending by a key; equal keys keep their order."""
    if key is None:
        return F.array_sort(a)
    pairs = F.array_sort(F.transform(a, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("v"))))
    return F.transform(pairs, lambda x: x["v"])


def without_nulls(a: Column) -> Column:
    return F.array_compact(a)


def checked(a: Column, condition: Callable[[Column], Column], message: str = "invalid value") -> Column:
    """The array, if every value meets the condition; else an error."""
    return F.when(F.forall(a, condition), a).otherwise(F.raise_error(F.lit(message)))


def map_get(m: Column, key: Column) -> Column:
    return F.element_at(m, key)


def map_has(m: Column, key: Column) -> Column:
    return F.map_contains_key(m, key)


def map_put(m: Column, key: Column, value: Column) -> Column:
    """The map with a key set to a value, whether it is there or not."""
    return F.map_concat(F.map_filter(m, lambda k, _: k != key), F.create_map(key, value))


def map_remove(m: Column, key: Column) -> Column:
    return F.map_filter(m, lambda k, _: k != key)
