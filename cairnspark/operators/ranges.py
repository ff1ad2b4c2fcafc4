"""Exact ranks and percentiles over whole tables: value counts in ranges, so that no task holds all values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnspark.sources.tables import new_path


#: Rows of a group whose values one task may hold.
SMALL_GROUP = 1 << 17
#: Rows that a task gets, about, where tables are joined by a key of one or a few rows.
TASK_ROWS = 1 << 19


def cut(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it back: computed once, lineage cut, columns pruned by what follows."""
    path = new_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` by a hash of the keys, in as many parts as leave a task about TASK_ROWS of ``rows``, one for each core at least: what a task
    holds doesn't grow with the table. Tables that are joined take the same ``rows``."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), *keys)


def _group(groups: Sequence[str]) -> Column:
    return F.struct(*[F.col(g) for g in groups]) if groups else F.struct(F.lit(0))


def ordered_counts(df: DataFrame, groups: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """(__g, value, n, before, total) for each distinct non-null value of a group: its rows, the rows of the group below it, all its rows.
    With a ``weight``, a column of whole numbers, a row counts as often as that says.

    Counts are ranged over (group, value); a range adds up its own counts and is offset by the totals of the
    group's earlier ranges, of which there is one row for each range and group in it.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.where(F.col(value).isNotNull()).groupBy(_group(groups).alias("__g"), F.col(value).alias("value")).agg((F.sum(weight) if weight else F.count("*")).alias("n")).where("n > 0")
    ranged = cut(counts.repartitionByRange(parts, "__g", "value").withColumn("__part", F.spark_partition_id()))
    totals = ranged.groupBy("__g", "__part").agg(F.sum("n").alias("__s"))
    mine = Window.partitionBy("__g")
    earlier = mine.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__g", "__part", F.coalesce(F.sum("__s").over(earlier), F.lit(0)).alias("__start"), F.sum("__s").over(mine).alias("total"))
    within = F.sum("n").over(Window.partitionBy("__part", "__g").orderBy("value")) - F.col("n")
    placed = ranged.withColumn("__in", within).join(offsets.hint("merge"), ["__part", "__g"])  # the counts' files look small; they must not be broadcast
    return placed.select("__g", "value", "n", (F.col("__start") + F.col("__in")).alias("before"), "total")


def percentiles(df: DataFrame, groups: Sequence[str], value: str, shares: Sequence[float], name: str = "quantiles", weight: str | None = None) -> DataFrame:
    """One row per group (one in all without groups, none for an empty table): exact interpolated percentiles of the non-null values as an array.

    Where no group has more than SMALL_GROUP rows, which one count tells, each is one aggregate; else values are counted and ranked in ranges.
    """
    known = df.where(F.col(value).isNotNull())
    rows = (F.sum(weight) if weight else F.count("*")).alias("n")
    largest = known.groupBy(*groups).agg(rows).agg(F.max("n")).first()[0] or 0
    if largest <= SMALL_GROUP:
        exact = F.percentile(F.col(value).cast("double"), F.array(*[F.lit(float(s)) for s in shares]), F.col(weight) if weight else F.lit(1))
        return (known.where(F.col(weight) > 0) if weight else known).groupBy(*groups).agg(exact.alias(name)).where(F.col(name).isNotNull())
    found = []
    for share in shares:
        at = F.lit(float(share)) * (F.col("total") - 1)

        def pick(rank: Column) -> Column:
            return F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("n")), F.col("value").cast("double")))

        low, high, rest = pick(F.floor(at)), pick(F.ceil(at)), F.max(at - F.floor(at))
        found.append(low + (high - low) * rest)
    rows = ordered_counts(df, groups, value, weight).groupBy("__g").agg(F.array(*found).alias(name))
    return rows.select(*[F.col("__g")[g].alias(g) for g in groups], name)


def medians(df: DataFrame, groups: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    """One row per group with the exact median of each of ``values``: all of them in one pass over ranges of (group, which value, value). One row without groups, also for an empty table."""
    names = list(values)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("__which"), values[n].cast("double").alias("__value")) for i, n in enumerate(names)]))
    long = df.select(*groups, each.alias("__e")).select(*groups, "__e.*")
    found = percentiles(long, [*groups, "__which"], "__value", [0.5])
    return found.groupBy(*groups).agg(*[F.max(F.when(F.col("__which") == i, F.col("quantiles")[0])).alias(n) for i, n in enumerate(names)])


def average_ranks(df: DataFrame, value: str) -> DataFrame:
    """(value, rank) for each distinct non-null value: ranks over all rows, ties sharing their average."""
    return ordered_counts(df, (), value).select("value", (F.col("before") + (F.col("n") + 1) / F.lit(2.0)).alias("rank"))
