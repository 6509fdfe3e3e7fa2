"""Products of a row's vector with itself as one array, and moments from their sums.

Where a fit needs many products, an array a row keeps the plan small whatever their number. Vectors begin
with 1, so that their sums hold counts and totals too. Sums are plain: use it for values, such
as returns, whose mean is not large beside their spread.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def products(vector: Column) -> Column:
    """Upper triangle of the products of a vector with itself, row by row."""
    rows = F.transform(vector, lambda a, i: F.transform(F.slice(vector, i + 1, F.size(vector) - i), lambda b: a * b))
    return F.flatten(rows)


def means(grouped: Column, width: int) -> Column:
    """Means from the summed triangle of vectors that begin with 1."""
    return F.transform(F.sequence(F.lit(1), F.lit(width)), lambda a: F.get(grouped, a) / F.get(grouped, F.lit(0)))


def centred(grouped: Column, mean: Column, width: int) -> Column:
    """Flat centred products from the summed triangle."""

    def cell(c: Column) -> Column:
        a, b = F.floor(c / width).cast("int"), F.pmod(c, F.lit(width))
        low, high = F.least(a, b) + 1, F.greatest(a, b) + 1
        at = low * (width + 1) - F.floor(low * (low - 1) / 2) + high - low
        return F.get(grouped, at.cast("int")) - F.get(grouped, F.lit(0)) * F.get(mean, a) * F.get(mean, b)

    return F.transform(F.sequence(F.lit(0), F.lit(width * width - 1)), cell)
