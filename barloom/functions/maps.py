"""Map functions without side effects; a function that changes a map gives struct(map, value) with the old value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def new() -> Column: return F.create_map()  # noqa: E704
def size(m: Column) -> Column: return F.size(m)  # noqa: E704
def keys(m: Column) -> Column: return F.map_keys(m)  # noqa: E704
def values(m: Column) -> Column: return F.map_values(m)  # noqa: E704
def copy(m: Column) -> Column: return m  # noqa: E704
def clear(m: Column) -> Column: return F.map_filter(m, lambda k, v: F.lit(False))  # noqa: E704
def contains(m: Column, key: Column) -> Column: return F.map_contains_key(m, key)  # noqa: E704
def get(m: Column, key: Column) -> Column: return F.try_element_at(m, key)  # noqa: E704


def put(m: Column, key: Column, value: Column) -> Column:
    """An existing key keeps its place."""
    there = F.map_contains_key(m, key)
    changed = F.when(there, F.transform_values(m, lambda k, v: F.when(k == key, value).otherwise(v))).otherwise(F.map_concat(F.map_filter(m, lambda k, v: k != key), F.create_map(key, value)))
    return F.struct(changed.alias("map"), get(m, key).alias("value"))


def put_all(m: Column, other: Column) -> Column:
    kept = F.transform_values(m, lambda k, v: F.when(F.map_contains_key(other, k), F.try_element_at(other, k)).otherwise(v))
    return F.map_concat(kept, F.map_filter(other, lambda k, v: ~F.map_contains_key(m, k)))


def remove(m: Column, key: Column) -> Column:
    return F.struct(F.map_filter(m, lambda k, v: k != key).alias("map"), get(m, key).alias("value"))
