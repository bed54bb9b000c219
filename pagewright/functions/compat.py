"""Number and text rules that differ between engines, pinned once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trunc_int(c: Column) -> Column:
    """Truncation toward zero."""
    return c.cast("int")


def half_up(c: Column) -> Column:
    """floor(x + 0.5), also below zero."""
    return F.floor(c + F.lit(0.5)).cast("int")


def utrim(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank(c: Column) -> Column:
    return F.coalesce(utrim(c), F.lit("")) == ""


def all_digits(c: Column) -> Column:
    """Decimal digits of any script, at least one."""
    return c.rlike(r"^\p{Nd}+$")


def upper_median(values: Column) -> Column:
    """v[n / 2] of the sorted array; null for an empty one."""
    return F.get(F.array_sort(values), (F.size(values) / 2).cast("int"))


def ordered_text(order: list[Column], text: Column, joiner: str) -> Column:
    """Aggregate: texts joined in the given order."""
    keys = [o.alias(f"o{i}") for i, o in enumerate(order)]
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*keys, text.alias("t")))), lambda x: x["t"]), joiner)
