"""Leakage-safe encodings of all folds at once, and pools of entities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.operators.joins import nearest, neighbour_stats
from cairnspark.operators.ranges import cut, medians
from cairnspark.operators.stats import _with_groups, leave_fold_out, leave_fold_out_median


def fold_encodings(df: DataFrame, key: str, category: str, target: str, attribute: str, fold: str, strength: float, k: int, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Adds what the other folds say of each row, and its products with the attribute: ``encoded`` (smoothed mean of the category),
    ``median`` and ``n_rest`` of the category, ``near`` (mean target of the k nearest rows of other folds).

    No row of a fold moves that fold's values. Means come from totals less the fold's, medians from value counts less the fold's, and neighbours
    from one join in which the fold is what must differ; so the table is encoded once, not once for each fold. Rows without a target encode but
    aren't encoded from; rows without a place have no neighbours (``near`` is null).
    """
    df = cut(df)
    out = leave_fold_out_median(leave_fold_out(df, category, target, fold, strength), category, target, fold)
    known = df.where(F.col(target).isNotNull())
    ranked = nearest(df.select(key, lat, lon, fold), known.select(key, lat, lon, fold, target), k, key, exclude=(fold, fold))
    near = neighbour_stats(ranked, key, target, [k]).select(key, F.col(f"mean_k{k}").alias("near"))
    out = out.join(near.hint("merge"), key, "left")  # a row for each key: never broadcast
    return out.withColumns({f"{c}_by_{attribute}": F.col(c) * F.col(attribute) for c in ("encoded", "median", "near")})


def one_per_entity(df: DataFrame, entity: str, numeric: Sequence[str], categorical: Sequence[str], order: str) -> DataFrame:
    """One row per entity: means of numbers, and the first non-null category by ``order``."""
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in categorical]
    return df.groupBy(entity).agg(*[F.avg(c).alias(c) for c in numeric], *firsts)


def attribute_pool(df: DataFrame, entity: str, attribute: str, value: str, firsts: Sequence[str], order: str) -> DataFrame:
    """One row per (entity, attribute): the exact median value, how many rows have one, and the first non-null of other columns (its place, say) by ``order``."""
    columns = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in firsts]
    pool = df.groupBy(entity, attribute).agg(F.count(value).alias("n"), *columns)
    return _with_groups(pool, medians(df, [entity, attribute], {f"{value}_median": F.col(value)}), [entity, attribute])
