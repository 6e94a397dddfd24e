"""Splitting a table by its key: ranges, exact equal-count boundaries, pages, and updates chunk by chunk."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import Refused


def bounds(df: DataFrame, key: str) -> tuple | None:
    """The smallest and largest key, or None of an empty table."""
    row = df.agg(F.min(key).alias("low"), F.max(key).alias("high")).first()
    return None if row["low"] is None else (row["low"], row["high"])


def ranges(low: int, high: int, n: int) -> list[tuple[int, int]]:
    """At most n half-open ranges [a, b) that cover low to high."""
    if n < 1 or high < low:
        raise Refused("no such ranges")
    n = min(n, high - low + 1)
    edges = [low + (high - low + 1) * k // n for k in range(n + 1)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def keyset_boundaries(df: DataFrame, key: list[str], n: int) -> DataFrame:
    """(k, key...): the keys of rank ceil(total * k / n) for k from 1 to n - 1, exactly, without a window over everything.

    Rows are range-partitioned and sorted, partitions counted, and each rank is found as a place in its partition; the counts are
    one row per partition.
    """
    sort = [F.col(k) for k in key]
    placed = df.select(*key).repartitionByRange(*sort).withColumn("_part", F.spark_partition_id())
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).select("_part", F.coalesce("_before", F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    ranked = placed.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(*sort)))
    numbered = ranked.join(F.broadcast(before), "_part").withColumn("_rank", F.col("_rank") + F.col("_before"))
    # k of the boundary at this rank, if there is one: the smallest k with ceil(total * k / n) = rank
    k = F.floor(F.col("_rank") * n / F.col("_total"))
    hit = (k >= 1) & (k <= n - 1) & (F.ceil(F.col("_total") * k / n) == F.col("_rank"))
    return numbered.filter(hit).select(k.cast("int").alias("k"), *key)


def keyset_chunks(df: DataFrame, key: str, edges: list) -> DataFrame:
    """df with chunk: the number of the half-open range (edge[k-1], edge[k]] that a row lies in; every row has exactly one."""
    chunk = F.lit(0)
    for e in edges:
        chunk = chunk + F.when(F.col(key) > F.lit(e), 1).otherwise(0)
    return df.withColumn("chunk", chunk.cast("int"))


def page(df: DataFrame, key: list[str], after: tuple | None, n: int, up_to: tuple | None = None) -> DataFrame:
    """The next n rows behind a key, in its order, up to another."""
    out = df
    if after is not None:
        out = out.filter(_beyond(key, after))
    if up_to is not None:
        out = out.filter(~_beyond(key, up_to))
    return out.orderBy(*key).limit(n)


def _beyond(key: list[str], values: tuple) -> Column:
    """Row comparison (k1, k2, ...) > (v1, v2, ...), with the first part alone in front so that files can be skipped by it."""
    out = F.lit(False)
    for i in reversed(range(len(key))):
        out = (F.col(key[i]) > F.lit(values[i])) | ((F.col(key[i]) == F.lit(values[i])) & out) if i < len(key) - 1 else F.col(key[i]) > F.lit(values[i])
    return (F.col(key[0]) >= F.lit(values[0])) & out if len(key) > 1 else out


def next_bound(df: DataFrame, key: str, after, n: int):
    """The n-th key behind the cursor, or the last one; None at the end."""
    some = df if after is None else df.filter(F.col(key) > F.lit(after))
    return some.select(key).orderBy(key).limit(n).agg(F.max(key)).first()[0]


def pages(df: DataFrame, key: str, n: int) -> Iterator[DataFrame]:
    """The table in chunks of n rows by key, for writing with a checkpoint behind each."""
    cursor = None
    while (bound := next_bound(df, key, cursor, n)) is not None:
        part = df if cursor is None else df.filter(F.col(key) > F.lit(cursor))
        yield part.filter(F.col(key) <= F.lit(bound))
        cursor = bound


def backfill(df: DataFrame, sets: dict[str, Column], predicate: Column) -> DataFrame:
    """The table with columns set where the predicate is true."""
    if missing := [c for c in sets if c not in df.columns]:
        raise Refused(f"no columns {missing}")
    return df.select(*[F.when(predicate, sets[c]).otherwise(F.col(c)).cast(df.schema[c].dataType).alias(c) if c in sets else F.col(c) for c in df.columns])


def remaining(df: DataFrame, predicate: Column) -> int:
    return df.filter(predicate).count()


def fan_out(df: DataFrame, key: list[str], n: int) -> DataFrame:
    """The same key always goes to the same of n partitions."""
    return df.repartition(n, *key)
