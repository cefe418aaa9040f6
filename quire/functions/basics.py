"""Small building blocks of column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` evaluated once, also inside lambdas."""
    return F.get(F.transform(F.array(value), then), 0)


def let_both(a: Column, b: Column, then: Callable[[Column, Column], Column]) -> Column:
    """``then(a, b)`` with each evaluated once."""
    return let(a, lambda x: let(b, lambda y: then(x, y)))


def blank(value: Column) -> Column:
    """Null as empty text."""
    return F.coalesce(value.cast("string"), F.lit(""))


def is_empty(value: Column) -> Column:
    """Null and the empty text are both empty."""
    return blank(value) == ""


def digit_sum(text: Column, n: int, weight: Callable[[Column], Column]) -> Column:
    """The sum of the first ``n`` digits, the i-th (from 1) times ``weight(i)``; X is 10, others 0."""

    total = F.lit(0)
    for i in range(1, n + 1):
        place = F.position(F.substring(text, i, 1), F.lit("0123456789X"))
        total = total + F.greatest(place - 1, F.lit(0)) * weight(F.lit(i))
    return total


def half_up(value: Column) -> Column:
    """The nearest whole number, halves upward."""
    return F.floor(value + F.lit(0.5))
