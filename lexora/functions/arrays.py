"""Column functions on arrays that stay nearly linear, however long an array is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of a chunk.  A fold copies its state in each step, so that only short arrays are gathered in one.
CHUNK = 256


def once(value: Column, like: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), of the type of `like`, with value computed once however often it is read."""
    return F.aggregate(F.array(value), like, lambda _, v: use(v))


def starts(lengths: Column) -> Column:
    """The sums of the elements before each element: where parts of these lengths begin."""
    none = F.array().cast("array<int>")
    grown = lambda a, x: F.struct((a["at"] + x).alias("at"), F.array_append(a["out"], a["at"]).alias("out"))
    summed = lambda x, at: F.aggregate(x, F.struct(at.alias("at"), none.alias("out")), grown, lambda a: a["out"])
    chunks = F.transform(F.sequence(F.lit(1), F.size(lengths), F.lit(CHUNK)), lambda k: F.slice(lengths, k, F.lit(CHUNK)))
    totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x))
    return F.when(F.size(lengths) > 0, F.flatten(F.zip_with(chunks, summed(totals, F.lit(0)), summed))).otherwise(none)
