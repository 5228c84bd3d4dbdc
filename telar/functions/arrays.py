"""Column functions on arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_sums(numbers: Column) -> Column:
    """array<bigint> of the sums of all numbers up to and with each, without a shuffle.

    A plain fold copies its output at every step. Here blocks of about the root of the array's size are folded on
    their own and then raised by what stands before them, so the work grows with size ** 1.5.
    """
    def of(x: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(x))).cast("int"), F.lit(1))
        zero = F.lit(0).cast("bigint")

        def fold(block: Column) -> Column:
            grow = lambda acc, n: F.struct((acc["sum"] + n).alias("sum"), F.concat(acc["out"], F.array(acc["sum"] + n)).alias("out"))
            return F.aggregate(block, F.struct(zero.alias("sum"), F.array().cast("array<bigint>").alias("out")), grow)

        blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(x), F.lit(1)), width), lambda a: fold(F.slice(x, a, width)))
        lift = lambda b: F.transform(b, lambda s, i: let(F.aggregate(F.slice(b, F.lit(1), i), zero, lambda acc, t: acc + t["sum"]), lambda base: F.transform(s["out"], lambda n: n + base)))
        return F.flatten(let(blocks, lift))

    return let(numbers, of)
