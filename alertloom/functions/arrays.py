"""Array rules that Spark has no function for."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def prefix_sums(values: Column, block: int = 256) -> Column:
    """Running sums of an array of longs, in blocks, so that a long array doesn't cost its square."""
    zero = F.array().cast("array<long>")

    def running(part: Column) -> Column:
        return F.aggregate(part, zero, lambda acc, v: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + v)))

    count = F.ceil(F.size(values) / block).cast("int")
    blocks = F.transform(F.filter(F.sequence(F.lit(0), count), lambda b: b < count), lambda b: running(F.slice(values, b * block + 1, block)))
    ends = running(F.transform(blocks, lambda x: F.element_at(x, -1)))
    before = F.concat(F.array(F.lit(0).cast("long")), ends)
    return F.flatten(F.zip_with(blocks, F.slice(before, 1, F.size(blocks)), lambda x, o: F.transform(x, lambda v: v + o)))
