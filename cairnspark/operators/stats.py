"""Group statistics, windows, pivots, encodings, folds, metrics and segments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnspark.operators import ranges
from cairnspark.operators.ranges import average_ranks, cut, medians, ordered_counts, percentiles


def _with_groups(df: DataFrame, table: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Left join on groups of which null is one."""
    named = table.withColumnsRenamed({g: f"__by_{g}" for g in groups})
    same = F.lit(True)
    for g in groups:
        same &= F.col(g).eqNullSafe(F.col(f"__by_{g}"))
    return df.join(named, same, "left").drop(*[f"__by_{g}" for g in groups])


def structure(df: DataFrame, group: str, size: str, kind: str, row: str) -> DataFrame:
    """Size, distinct values, extremes, median and first (by row key) of each group, its spread and typology score.

    Where no group has more than SMALL_GROUP rows, which one count tells, all of them are one aggregate and the rows are shuffled once; else
    distinct values and medians are counted apart.
    """
    plain = [F.count("*").alias("n"), F.min(size).alias("size_min"), F.max(size).alias("size_max"), F.min_by(kind, row).alias("first_kind")]
    largest = df.groupBy(group).count().agg(F.max("count")).first()[0] or 0
    if largest <= ranges.SMALL_GROUP:
        different = [F.size(F.collect_set(c)).cast("long").alias(n) for c, n in ((size, "n_sizes"), (kind, "n_kinds"))]
        g = df.groupBy(group).agg(*plain, *different, F.percentile(F.col(size).cast("double"), F.lit(0.5)).alias("size_median"))
    else:
        g = df.groupBy(group).agg(*plain, F.countDistinct(size).alias("n_sizes"), F.countDistinct(kind).alias("n_kinds"))
        g = _with_groups(g, medians(df, [group], {"size_median": F.col(size)}), [group])
    g = g.select(group, "n", "n_sizes", "n_kinds", "size_min", "size_max", "first_kind", "size_median")
    spread = (F.col("size_max") - F.col("size_min")) / F.when(F.col("size_median") > 0, F.col("size_median"))
    tests = [F.col("n") >= 3, F.col("n_sizes") >= 2, F.col("n_kinds") >= 2, F.coalesce(F.col("spread") > 0.5, F.lit(False))]
    score = sum((t.cast("int") for t in tests[1:]), tests[0].cast("int"))
    return g.withColumn("spread", spread).withColumn("score", score).withColumn("is_mixed", (F.col("score") == 4).cast("int"))


def level_stats(df: DataFrame, entity: str, level: str, values: Sequence[str]) -> DataFrame:
    """Statistics of entity means for each level: one aggregate for entities and one for the level."""
    entities = df.groupBy(entity, level).agg(*[F.avg(v).alias(v) for v in values])
    columns = [f(v).alias(f"{v}_{name}") for v in values for name, f in (("mean", F.avg), ("std", F.stddev_samp), ("count", F.count))]
    return _with_groups(entities.groupBy(level).agg(*columns), medians(entities, [level], {f"{v}_median": F.col(v) for v in values}), [level])


def first_per_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key: the one that is least by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def lag_pivot(panel: DataFrame, keys: Sequence[str], month: str, value: str, anchor: str, lags: Sequence[int]) -> DataFrame:
    """Long to wide: the value of each month that lies ``lag`` months before the anchor; the months are filtered first."""
    at = {k: F.add_months(F.lit(anchor).cast("date"), -k) for k in lags}
    wanted = panel.where(F.col(month).isin(*at.values()))
    return wanted.groupBy(*keys).agg(*[F.min(F.when(F.col(month) == d, F.col(value))).alias(f"lag_{k}") for k, d in at.items()])


def z_scores(df: DataFrame, group: str, value: str) -> DataFrame:
    """Mean, deviation, extremes, median of the group on each row, and the z-score (0 without spread)."""
    w = Window.partitionBy(group)
    df = df.withColumns({"g_mean": F.avg(value).over(w), "g_std": F.stddev_samp(value).over(w), "g_min": F.min(value).over(w), "g_max": F.max(value).over(w)})
    df = _with_groups(df, medians(df, [group], {"g_median": F.col(value)}), [group])
    return df.withColumn("z", F.coalesce((F.col(value) - F.col("g_mean")) / F.when(F.col("g_std") > 1e-9, F.col("g_std")), F.lit(0.0)))


def average_rank(group: Sequence[str], value: str) -> Column:
    """Percent rank with the average rank of ties; null values are unranked and get 0.5."""
    own = Window.partitionBy(*group)
    rank = F.rank().over(own.orderBy(F.asc_nulls_last(value)))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*group, value))
    return F.when(F.col(value).isNull(), 0.5).otherwise((rank + (ties - 1) / F.lit(2.0)) / F.count(value).over(own))


def dominance(df: DataFrame, group: str, value: str) -> DataFrame:
    """Log count, capped share of the group's total, share of its largest, flags of the largest and the smallest."""
    w = Window.partitionBy(group)
    total, largest, least = F.sum(value).over(w), F.max(value).over(w), F.min(value).over(w)
    share = F.least(F.greatest(F.coalesce(F.col(value) / F.when(total > 0, total), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return df.withColumns({
        "log_value": F.log1p(F.greatest(F.coalesce(F.col(value), F.lit(0.0)), F.lit(0.0))), "share": share,
        "of_max": F.coalesce(F.col(value) / F.when(largest > 0, largest), F.lit(1.0)),
        "is_max": F.coalesce((F.col(value) >= largest - 1e-9).cast("int"), F.lit(0)), "is_min": F.coalesce((F.col(value) <= least + 1e-9).cast("int"), F.lit(0)),
    })


def quantile_class(df: DataFrame, value: str, labels: Sequence[str]) -> DataFrame:
    """Classes of equal share by interpolated, right-closed edges; one row of edges is joined to all. Null values have no class."""
    k = len(labels)
    edges = percentiles(df, (), value, [i / k for i in range(1, k)], "__edges")
    named = F.when(F.col(value).isNull(), None)
    for i, label in enumerate(labels[:-1]):
        named = named.when(F.col(value) <= F.col("__edges")[i], label)
    return df.join(F.broadcast(edges), how="left").withColumn("class", named.otherwise(labels[-1])).drop("__edges")  # one row


def standardised(df: DataFrame, values: Sequence[str], clip: float = 8.0) -> DataFrame:
    """Median for nulls, then (x - mean) / population deviation (1 if none), clipped; fitted on all rows of ``df``. A column without any value stays null."""
    middle = medians(df, (), {f"__m_{v}": F.col(v) for v in values})
    filled = df.join(F.broadcast(middle), how="cross").withColumns({v: F.coalesce(F.col(v), F.col(f"__m_{v}")) for v in values})  # one row
    moments = filled.agg(*[f(v).alias(f"__{n}_{v}") for v in values for n, f in (("a", F.avg), ("s", F.stddev_pop))])
    scaled = {v: F.when(F.col(v).isNotNull(), F.greatest(F.least((F.col(v) - F.col(f"__a_{v}")) / F.when(F.col(f"__s_{v}") > 1e-8, F.col(f"__s_{v}")).otherwise(1.0), F.lit(clip)), F.lit(-clip))) for v in values}
    return filled.join(F.broadcast(moments), how="cross").withColumns(scaled).select(*df.columns)


def group_folds(df: DataFrame, key: str, k: int) -> DataFrame:
    """A fold for each row: all rows of a group share it. Integer arithmetic, so that other engines can repeat it."""
    return df.withColumn("fold", (F.expr(f"(({key} * 2654435761) % 4294967296) div 65536 % {k}")).cast("int"))


def balanced_folds(df: DataFrame, group: str, k: int) -> DataFrame:
    """Groups by size (largest first, then by key) dealt to and fro over the folds; ranked in ranges, also where all sizes are equal."""
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    keyed = sizes.select(group, F.struct((-F.col("n")).alias("size"), F.col(group).alias("group")).alias("__order"))
    turn = F.col("before") % (2 * k)
    dealt = ordered_counts(keyed, (), "__order").select(F.col("value.group").alias("__k"), F.when(turn < k, turn).otherwise(2 * k - 1 - turn).cast("int").alias("fold"))
    return df.join(dealt, F.col(group).eqNullSafe(F.col("__k"))).drop("__k")


def smoothed_means(df: DataFrame, category: str, target: str, strength: float) -> DataFrame:
    """Empirical-Bayes mean of every non-null category: (n * mean + s * global) / (n + s); the global mean where a category has no target."""
    overall = df.agg(F.avg(target).alias("__g"))
    sums = df.where(F.col(category).isNotNull()).groupBy(category).agg(F.sum(target).alias("s"), F.count(target).alias("n"))
    return sums.join(F.broadcast(overall), how="cross").select(category, F.coalesce((F.col("s") + strength * F.col("__g")) / F.nullif(F.col("n") + strength, F.lit(0.0)), F.col("__g")).alias("encoded"), "n")


def leave_fold_out(df: DataFrame, category: str, target: str, fold: str, strength: float) -> DataFrame:
    """Each row's category mean from the other folds, smoothed to the other folds' mean: totals minus the fold's own.
    A null category, and one that the other folds lack, gets the other folds' mean."""
    by_fold = df.groupBy(category, fold).agg(F.sum(target).alias("s"), F.count(target).alias("n"))
    cells = by_fold.withColumns({"rest_s": F.sum("s").over(Window.partitionBy(category)) - F.col("s"), "rest_n": F.sum("n").over(Window.partitionBy(category)) - F.col("n")})
    folds = df.groupBy(fold).agg(F.sum(target).alias("fs"), F.count(target).alias("fn"))
    total = folds.agg(F.sum("fs").alias("ts"), F.sum("fn").alias("tn"))
    prior = folds.join(F.broadcast(total), how="cross").select(fold, ((F.col("ts") - F.col("fs")) / F.nullif(F.col("tn") - F.col("fn"), F.lit(0))).alias("prior"))
    smoothed = (F.coalesce("rest_s", F.lit(0.0)) + strength * F.col("prior")) / F.nullif(F.col("rest_n") + strength, F.lit(0.0))
    encoded = cells.where(F.col(category).isNotNull()).join(F.broadcast(prior), fold).select(category, fold, smoothed.alias("encoded"))
    joined = df.join(encoded, [category, fold], "left").join(F.broadcast(prior), fold, "left")
    return joined.withColumn("encoded", F.coalesce("encoded", "prior")).drop("prior")


def leave_fold_out_median(df: DataFrame, category: str, target: str, fold: str) -> DataFrame:
    """Adds ``median`` and ``n_rest``: the exact median target of each row's category over the other folds, and how many rows that has.

    Value counts of (category, value) less those of the fold give the counts that the fold may see, so a median costs
    as many rows as there are distinct values, once for each fold. A null category, and one that the other folds lack, gets the
    median of the other folds' rows.
    """
    folds = F.broadcast(df.select(F.col(fold).alias("__f")).distinct().agg(F.collect_set("__f").alias("__folds")))  # one row of fold numbers

    def without_fold(by: Sequence[str]) -> DataFrame:
        own = df.where(F.col(target).isNotNull()).groupBy(*by, F.col(target).alias("__y"), F.col(fold).alias("__f")).agg(F.count("*").alias("__n"))
        both = own.groupBy(*by, "__y").agg(F.sum("__n").alias("__all"), F.map_from_entries(F.collect_list(F.struct("__f", "__n"))).alias("__own"))
        rest = both.join(folds, how="cross").select(*by, "__y", F.explode("__folds").alias(fold), "__all", "__own")
        counted = cut(rest.select(*by, fold, "__y", (F.col("__all") - F.coalesce(F.col("__own")[F.col(fold)], F.lit(0))).alias("__n")))
        sizes = counted.groupBy(*by, fold).agg(F.sum("__n").alias("n_rest"))
        return percentiles(counted, [*by, fold], "__y", [0.5], weight="__n").select(*by, fold, F.col("quantiles")[0].alias("median")).join(sizes, [*by, fold])

    overall = without_fold([]).select(fold, F.col("median").alias("__overall"))
    table = without_fold([category])
    out = df.join(table, [category, fold], "left").join(F.broadcast(overall), fold, "left")
    return out.withColumns({"median": F.coalesce("median", "__overall"), "n_rest": F.coalesce("n_rest", F.lit(0))}).drop("__overall")


def leave_group_out(df: DataFrame, cell: Sequence[str], group: str, target: str, strength: float) -> DataFrame:
    """Each (cell, group): smoothed mean of the cell without the group's own rows; null if nothing is left."""
    own = df.groupBy(*cell, group).agg(F.sum(target).alias("s"), F.count(target).alias("n"))
    cells = Window.partitionBy(*cell)
    rest = own.withColumns({"rs": F.sum("s").over(cells) - F.col("s"), "rn": F.sum("n").over(cells) - F.col("n")})
    overall = df.agg(F.avg(target).alias("__g"))
    value = F.when(F.col("rn") > 0, (F.col("rs") + strength * F.col("__g")) / (F.col("rn") + strength))
    return rest.join(F.broadcast(overall), how="cross").select(*cell, group, value.alias("encoded"), F.col("rn").alias("n_rest"))


def rollup_means(df: DataFrame, levels: Sequence[str], target: str) -> DataFrame:
    """Mean and count at every prefix of ``levels`` in one aggregate; ``depth`` says how many levels hold."""
    keyed = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("__missing__")).alias(c) for c in levels], target)
    depth = F.lit(len(levels)) - F.bit_count(F.grouping_id())
    return keyed.rollup(*levels).agg(F.avg(target).alias("mean"), F.count(target).alias("n"), depth.cast("int").alias("depth"))


def fallback(df: DataFrame, levels: Sequence[str], target: str, least: int) -> DataFrame:
    """The mean of the finest level that has at least ``least`` rows, else the overall mean, and that level's depth."""
    table = rollup_means(df, levels, target)
    out = df.withColumns({f"__{c}": F.coalesce(F.col(c).cast("string"), F.lit("__missing__")) for c in levels})
    tries, depths = [], []
    for k in range(len(levels), -1, -1):
        part = table.where((F.col("depth") == k) & ((F.col("n") >= least) | (F.col("depth") == 0)))
        part = part.select(*[F.col(c).alias(f"__{c}") for c in levels[:k]], F.col("mean").alias(f"__v{k}"))
        out = out.join(part, [f"__{c}" for c in levels[:k]], "left") if k else out.join(F.broadcast(part), how="cross")
        tries.append(F.col(f"__v{k}"))
        depths.append(F.when(F.col(f"__v{k}").isNotNull(), k))
    return out.withColumns({"fallback": F.coalesce(*tries), "depth": F.coalesce(*depths)}).drop(*[f"__{c}" for c in levels], *[f"__v{k}" for k in range(len(levels) + 1)])


def _middles(df: DataFrame, by: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    """Exact medians of several expressions for each group, in one pass."""
    return medians(df, by, values)


def metrics(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """n, MAE, MAPE, median APE, RMSE, median AE, R2, bias; one row for each (non-null) group, or one in all. Rows without both values don't count."""
    df = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    e, pct = F.abs(F.col(y) - F.col(p)), F.abs(F.col(y) - F.col(p)) / F.greatest(F.abs(F.col(y)), F.lit(1e-9))
    squares = F.sum(F.pow(F.col(y) - F.col(p), F.lit(2)))
    moments = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(e).alias("mae"), F.avg(pct).alias("mape"), F.sqrt(F.avg(F.pow(F.col(y) - F.col(p), F.lit(2)))).alias("rmse"),
        (1 - squares / F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))).alias("r2"), F.avg(F.col(p) - F.col(y)).alias("bias"),
    )
    middles = _middles(df, by, {"median_ape": pct, "median_ae": e})
    return moments.join(middles, [*by], "left") if by else moments.join(F.broadcast(middles), how="left")


def segment_errors(df: DataFrame, y: str, p: str, segments: Sequence[str]) -> DataFrame:
    """n, mean, MAE, MAPE, median APE, bias and share of all absolute error, for many segment columns at once."""
    long = df.select(y, p, F.explode(F.create_map(*[x for s in segments for x in (F.lit(s), F.coalesce(F.col(s).cast("string"), F.lit("missing")))])).alias("segment", "value"))
    e = F.abs(F.col(y) - F.col(p))
    pct = F.when(F.col(y) > 0, e / F.when(F.col(y) > 0, F.col(y)))
    g = long.groupBy("segment", "value").agg(F.count("*").alias("n"), F.avg(y).alias("mean_actual"), F.avg(e).alias("mae"), F.avg(pct).alias("mape"), F.avg(F.col(p) - F.col(y)).alias("bias"), F.sum(e).alias("__e"))
    g = g.join(_middles(long, ["segment", "value"], {"median_ape": pct}), ["segment", "value"], "left")
    return g.withColumn("error_share", F.col("__e") / F.sum("__e").over(Window.partitionBy("segment"))).drop("__e")


def compare_models(df: DataFrame, y: str, predictions: Sequence[str]) -> DataFrame:
    """The metrics of each prediction column, a row for each."""
    return metrics(df.unpivot([y], list(predictions), "model", "p"), y, "p", ["model"])


def worst(df: DataFrame, y: str, p: str, key: str, n: int) -> DataFrame:
    return df.withColumn("abs_err", F.abs(F.col(y) - F.col(p))).orderBy(F.desc("abs_err"), key).limit(n)


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, nulls and distinct values of each column, in one aggregate."""
    row = df.agg(F.count("*").alias("n"), *[f(c).alias(f"{k}_{c}") for c in columns for k, f in (("d", F.countDistinct), ("x", lambda c: F.count_if(F.col(c).isNull())))])
    return row.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"d_{c}").alias("n_distinct"), F.col(f"x_{c}").alias("n_null")) for c in columns])).alias("c")).select("c.column", F.col("n").alias("n_rows"), "c.n_distinct", "c.n_null")


def importance(long: DataFrame, folds: int) -> DataFrame:
    """Average gain over folds; a feature that a fold lacks counts 0 there."""
    return long.groupBy("feature").agg((F.sum("gain") / folds).alias("gain"))


def nullified(df: DataFrame, columns: Sequence[str], key: str, fraction: float, seed: int = 0) -> DataFrame:
    """Nulls the columns together on a repeatable share of rows, by integer arithmetic on the key."""
    hit = F.expr(f"(({key} + {seed}) * 2654435761 % 4294967296) div 65536 % 10000") < int(fraction * 10_000)
    return df.withColumns({c: F.when(~hit, F.col(c)) for c in columns})


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation of two columns over the rows that have both; ranks from value counts in ranges, ties averaged."""
    ranked = df.select(a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    both = ranked
    for c in (a, b):
        both = both.join(average_ranks(ranked, c).select(F.col("value").alias(c), F.col("rank").alias(f"__r_{c}")), c)
    return both.agg(F.corr(f"__r_{a}", f"__r_{b}").alias("spearman"), F.count("*").alias("n"))


def unit_value(df: DataFrame, level: str, value: str, size: str, reference: Column | None = None) -> DataFrame:
    """Median value per unit of size of the row's level, else of all reference rows, times the row's size (null: 0).

    Both medians are those of the ``reference`` rows only (all rows where None), so other rows' values move nothing; sizes of 0 or less have no unit value.
    """
    units = df.withColumn("__u", F.col(value) / F.when(F.col(size) > 0, F.col(size)))
    known = units if reference is None else units.where(reference)
    level_middle = percentiles(known.where(F.col(level).isNotNull()), [level], "__u", [0.5]).select(level, F.col("quantiles")[0].alias("__m"))
    overall = percentiles(known, (), "__u", [0.5]).select(F.col("quantiles")[0].alias("__o"))
    joined = df.join(level_middle, level, "left").join(F.broadcast(overall), how="left")
    return joined.withColumn("unit_value", F.coalesce("__m", "__o") * F.coalesce(F.col(size), F.lit(0))).drop("__m", "__o")


def deviations(df: DataFrame, level_table: DataFrame, level: str, values: Sequence[str]) -> DataFrame:
    """Each value's z-score against its level's mean and deviation in a ``level_stats`` table; null without spread or level."""
    columns = [f"{v}_{m}" for v in values for m in ("mean", "std")]
    joined = df.join(level_table.select(level, *[F.col(c).alias(f"__{c}") for c in columns]), level, "left")
    scored = {f"{v}_z": (F.col(v) - F.col(f"__{v}_mean")) / F.when(F.col(f"__{v}_std") > 1e-9, F.col(f"__{v}_std")) for v in values}
    return joined.withColumns(scored).drop(*[f"__{c}" for c in columns])


def nested_means(df: DataFrame, levels: Sequence[str], target: str, strength: float) -> DataFrame:
    """Smoothed mean and count of each row's cell at every depth of ``levels``: one aggregate, rolled up from the finest cells.

    A null level counts as a level of its own, whatever texts there are. Columns ``mean_1`` .. and ``n_1`` .. follow the depth, coarsest first.
    """
    names = [f"__l{i}" for i in range(len(levels))]
    keyed = df.withColumns({n: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for n, c in zip(names, levels, strict=True)})
    cells = cut(keyed.groupBy(*names).agg(F.sum(target).alias("s"), F.count(target).alias("n")))
    overall = cells.agg((F.sum("s") / F.sum("n")).alias("__g"))
    out = keyed.join(F.broadcast(overall), how="left")
    for k in range(1, len(levels) + 1):
        part = cells.groupBy(*names[:k]).agg(F.sum("s").alias("__s"), F.sum("n").alias(f"n_{k}"))
        out = out.join(part, names[:k], "left").withColumn(f"mean_{k}", (F.coalesce("__s", F.lit(0.0)) + strength * F.col("__g")) / (F.col(f"n_{k}") + strength)).drop("__s")
    return out.drop(*names, "__g")


def target_profile(df: DataFrame, target: str) -> DataFrame:
    """One row: rows, nulls, mean, median, least and greatest value."""
    row = df.agg(F.count("*").alias("n_rows"), F.count_if(F.col(target).isNull()).alias("n_null"), F.avg(target).alias("mean"), F.min(target).alias("least"), F.max(target).alias("greatest"))
    return row.join(F.broadcast(percentiles(df, (), target, [0.5]).select(F.col("quantiles")[0].alias("median"))), how="left")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n, share) of a column, nulls included."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("__t"))), how="cross").select("value", "n", (F.col("n") / F.col("__t")).alias("share"))


def top(df: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """A report's n first rows by a column, greatest first, ties by key."""
    return df.orderBy(F.desc_nulls_last(by), key).limit(n)
