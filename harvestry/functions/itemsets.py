"""Itemsets as sorted arrays of strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(items: Column) -> Column:
    """Items in alphabetical order, a space between."""
    return F.array_join(F.sort_array(items), " ")


def union(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_union(a, b))


def difference(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_except(a, b))


def intersection_size(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def equal(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_distinct(a)) == F.sort_array(F.array_distinct(b))


def contains(items: Column, item: Column) -> Column:
    return F.array_contains(items, item)


def order_keys(items: Column) -> list[Column]:
    """By size, then item by item."""
    return [F.size(items), F.sort_array(items)]


def subsets_without_one(items: Column) -> Column:
    """All subsets with one item less."""
    return F.transform(items, lambda x: F.array_remove(items, x))


def parse(text_: Column) -> Column:
    """Items of text such as 'a,b c'."""
    return F.sort_array(F.array_distinct(F.filter(F.split(text_, "[, ]+"), lambda x: x != "")))
