"""Array expressions that the native operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_totals(values: Column) -> Column:
    """Of an int array: before each element, the sum of those before it. Goes by chunks, so that no step copies a long array."""
    zero = F.lit(0)

    def sums(part: Column, start: Column) -> Column:
        empty = F.struct(F.array().cast("array<int>").alias("out"), start.alias("at"))
        return F.aggregate(part, empty, lambda acc, x: F.struct(F.concat(acc["out"], F.array(acc["at"])).alias("out"), (acc["at"] + x).alias("at")), lambda acc: acc["out"])

    def chunked(v: Column) -> Column:
        chunks = F.transform(F.sequence(zero, F.floor((F.size(v) - 1) / CHUNK).cast("int")), lambda c: F.slice(v, c * CHUNK + 1, CHUNK))
        totals = lambda c: F.transform(c, lambda part: F.aggregate(part, zero, lambda a, x: a + x))
        return let(chunks, lambda c: let(sums(totals(c), zero), lambda begin: F.flatten(F.transform(c, lambda part, k: sums(part, F.get(begin, k))))))

    return let(values, lambda v: F.when(F.size(v) > 0, chunked(v)).otherwise(F.array().cast("array<int>")))
