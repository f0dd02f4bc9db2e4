"""Column expressions that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, though ``body`` names it many times or in a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def prefix_sums(values: Column, block: int = 256) -> Column:
    """Inclusive running sums of an array of longs, in blocks so that long arrays stay cheap."""
    zero = F.lit(0).cast("long")

    def push(acc: Column, x: Column) -> Column:
        return F.concat(acc, F.array(F.element_at(acc, -1) + x))

    def blocks(v: Column) -> Column:
        numbers = F.sequence(zero, F.floor((F.size(v) - 1) / block))
        part = lambda b: F.slice(v, (b * block + 1).cast("int"), block)
        totals = F.transform(numbers, lambda b: F.aggregate(part(b), zero, lambda a, x: a + x))
        return let(
            F.aggregate(totals, F.array(zero), push),
            lambda starts: F.flatten(
                F.transform(
                    numbers,
                    lambda b: let(
                        F.aggregate(part(b), F.array(F.element_at(starts, (b + 1).cast("int"))), push),
                        lambda sums: F.slice(sums, 2, block),
                    ),
                )
            ),
        )

    return let(values, lambda v: F.when(F.size(v) > 0, blocks(v)).otherwise(F.array().cast("array<bigint>")))
