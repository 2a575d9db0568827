"""Ordered per-key computations that survive one very hot key.

A plain window sorts all rows of a key in one task. Here each key is cut into
chunks of its order (a time or sequence bucket); windows run inside chunks, and
only one small summary row per chunk is carried across. Results are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BEFORE = (Window.unboundedPreceding, -1)
UP_TO = (Window.unboundedPreceding, 0)


def time_chunks(df: DataFrame, time: str, rows: int = 1_000_000) -> Column:
    """A chunk number that grows with ``time`` and cuts the table into stretches
    of about ``rows`` rows, however they are spread over days and keys."""
    n = df.count()
    seconds = F.col(time).cast("double")
    cuts = -(-n // rows)
    if cuts < 2:
        return F.lit(0)
    edges = df.select(seconds.alias("t")).approxQuantile("t", [i / cuts for i in range(1, cuts)], 0.2 / cuts)
    passed = F.filter(F.array(*[F.lit(e) for e in sorted(set(edges))]), lambda e: e <= seconds)
    return F.coalesce(F.size(passed), F.lit(0))


def carry_forward(df: DataFrame, keys: list[str], order: list[str], chunk: Column | None,
                  values: dict[str, Column]) -> DataFrame:
    """Adds, per name, the last non-null value strictly before each row.

    Wrap a value in a struct to carry nulls too, which makes it a ``lag``.
    Without chunks a key is one window, for tables known to have no hot key.
    """
    names = list(values)
    if chunk is None:
        before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*BEFORE)
        return df.withColumns({n: F.last(values[n], ignorenulls=True).over(before) for n in names})
    held = df.withColumns({"__chunk": chunk, **{f"__v_{n}": values[n] for n in names}})
    inside = Window.partitionBy(*keys, "__chunk").orderBy(*order).rowsBetween(*BEFORE)
    local = held.withColumns({f"__l_{n}": F.last(f"__v_{n}", ignorenulls=True).over(inside) for n in names})

    at = F.struct(*order)
    tails = held.groupBy(*keys, "__chunk").agg(
        *[F.max_by(F.col(f"__v_{n}"), F.when(F.col(f"__v_{n}").isNotNull(), at)).alias(f"__t_{n}") for n in names])
    across = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(*BEFORE)
    carried = tails.select(
        *keys, "__chunk", *[F.last(f"__t_{n}", ignorenulls=True).over(across).alias(f"__c_{n}") for n in names])

    joined = local.join(carried, [*keys, "__chunk"], "left")
    return joined.select(*df.columns, *[F.coalesce(f"__l_{n}", f"__c_{n}").alias(n) for n in names])


def running_sum(df: DataFrame, keys: list[str], order: list[str], chunk: Column, value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` up to and including each row."""
    held = df.withColumns({"__chunk": chunk, "__v": value})
    inside = Window.partitionBy(*keys, "__chunk").orderBy(*order).rowsBetween(*UP_TO)
    across = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(*BEFORE)
    carried = held.groupBy(*keys, "__chunk").agg(F.sum("__v").alias("__t")).select(
        *keys, "__chunk", F.sum("__t").over(across).alias("__c"))
    local = held.withColumn("__l", F.sum("__v").over(inside))
    return local.join(carried, [*keys, "__chunk"], "left").select(
        *df.columns, (F.col("__l") + F.coalesce("__c", F.lit(0))).alias(name))


def number_rows(df: DataFrame, keys: list[str], order: list[str], chunk: Column, name: str) -> DataFrame:
    """``row_number`` per key; ``chunk`` must not decrease along ``order``."""
    return running_sum(df, keys, order, chunk, F.lit(1), name)
