"""Arithmetic on dense vectors held as array columns, computed in double."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(vec: Column) -> Column:
    return vec.cast("array<double>")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also where ``use`` loops over elements.

    A column put into a lambda body would be evaluated again for every element.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def dot(left: Column, right: Column) -> Column:
    """Plain dot product; no division by norms."""
    products = F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def scale(vec: Column, factor: Column) -> Column:
    return bind(factor, lambda f: F.transform(vec, lambda x: x * f))


def l2_normalize(vec: Column) -> Column:
    """v / |v|; a zero vector stays as it is."""

    def divide(v: Column) -> Column:
        return bind(norm(v), lambda size: F.when(size > 0, F.transform(v, lambda x: x / size)).otherwise(v))

    return bind(vec, divide)


def add(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda x, y: x + y)


def subtract(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda x, y: x - y)


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def rounded(value: Column, places: int = 6) -> Column:
    """Rounded double without a negative zero."""
    return F.round(value.cast("double"), places) + F.lit(0.0)


def rounded_vector(vec: Column, places: int = 6) -> Column:
    return F.transform(vec, lambda x: F.round(x, places) + F.lit(0.0))
