"""Base learners, out-of-fold predictions and a ridge on top, with pyspark.ml."""

from __future__ import annotations

import hashlib
import json
import math
import time
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.operators.boosting import MedianBoosting
from cairnspark.operators.joins import feature_knn
from cairnspark.operators.ranges import cut, dealt, ordered_counts, percentiles
from cairnspark.operators.stats import metrics
from cairnspark.sources.tables import is_complete, new_path

TRAINERS: dict[str, Callable[..., Estimator]] = {
    "boosted": lambda **p: GBTRegressor(**{"lossType": "absolute", "maxIter": 20, "maxDepth": 4, **p}),
    "boosted_shallow": lambda **p: GBTRegressor(**{"lossType": "absolute", "maxIter": 20, "maxDepth": 2, **p}),
    "boosted_median": lambda **p: MedianBoosting(**p),
    "forest": lambda **p: RandomForestRegressor(**{"numTrees": 20, "maxDepth": 6, **p}),
    "linear": lambda **p: LinearRegression(**{"regParam": 0.01, **p}),
}


def trainer(name: str, *layers: Mapping, seed: int = 0, fold: int = 0) -> Estimator:
    """A learner by name, with parameters layered from defaults to overrides; its seed depends on the fold."""
    if name not in TRAINERS:
        raise KeyError(f"unknown learner {name!r}; known: {sorted(TRAINERS)}")
    parameters = reduce(lambda a, b: {**a, **b}, layers, {})
    return TRAINERS[name](**({} if name == "linear" else {"seed": seed + fold}), **parameters)


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """(value, code) of each distinct non-null value: its place in order, from ranks in ranges. No label reaches the driver, whatever the number of categories."""
    values = df.select(column).distinct()
    return cut(ordered_counts(values, (), column).select("value", F.col("before").cast("long").alias("code")))


def encoded(df: DataFrame, column: str, codes: DataFrame, name: str) -> DataFrame:
    """Adds the code of each row's value as ``name``; nulls and values that the dictionary lacks share the code after its last."""
    size = codes.agg(F.count("*")).first()[0]
    joined = df.join(codes.select(F.col("value").alias("__value"), F.col("code").alias("__code")), F.col(column) == F.col("__value"), "left")
    return joined.withColumn(name, F.coalesce("__code", F.lit(size))).drop("__value", "__code")


def assembled(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = ()) -> DataFrame:
    """A features vector; categories are codes from dictionaries over all rows, nulls have one of their own; null numbers are kept as NaN."""
    for c in categorical:
        df = encoded(df, c, dictionary(df, c), f"{c}__i")
    return VectorAssembler(inputCols=[*numeric, *[f"{c}__i" for c in categorical]], outputCol="features", handleInvalid="keep").transform(df)


def fingerprint(df: DataFrame, columns: Sequence[str]) -> str:
    """A mark of the rows of some columns, in any order: their count and two sums of 64-bit hashes, from one aggregate."""
    hashes = [F.sum(F.xxhash64(F.lit(i), *columns).cast("decimal(20,0)")) for i in (0, 1)]
    return "/".join(map(str, df.agg(F.count("*"), *hashes).first()))


def part_path(path: str, mark: str, label: str, base: str, parameters: Mapping, seed: int, fold: int) -> str:
    """Where the predictions of one (base, fold) are stored: named by the data, the learner, its parameters and its seed."""
    made = json.dumps([mark, label, base, parameters, seed], sort_keys=True, default=str)
    return f"{path}/{base}-{hashlib.sha256(made.encode()).hexdigest()[:24]}/part={fold}"


def out_of_fold(df: DataFrame, label: str, fold: str, folds: int, bases: Mapping[str, Mapping], key: str, seed: int = 0, path: str | None = None, only: Sequence[int] | None = None, parallel: int = 4, timed: bool = False) -> DataFrame:
    """(key, fold, base, prediction): each row is predicted once by each base, by a model that did not see its fold.

    A base's parameters may name its learner (``learner``, else its own name), its columns of ``df`` (``features``, else the
    features column), and ``early_stop``: boosting then ends by its error on an eighth of the training rows. Each (fold, base) is written under
    ``path`` as soon as it is scored, in a folder named by a fingerprint of the data, the learner and its parameters; a run that finds it whole doesn't fit
    it again, and other data or parameters never take it. Without a path a new one is taken. ``parallel`` models are fitted at once, each in a
    scheduler pool of its own; ``only`` names the folds to predict (all where None); with ``timed`` there is a column ``seconds`` of the fit.
    """
    spark = df.sparkSession
    path = path or new_path(spark, "out-of-fold")
    data = cut(df)
    kind = df.schema[key].dataType.simpleString()
    wanted = list(range(folds)) if only is None else list(only)
    columns = {base: [key, fold, label, *p.get("features", ["features"])] for base, p in bases.items()}
    marks = {tuple(c): fingerprint(data, c) for c in {tuple(c): c for c in columns.values()}.values()}
    parts = {(base, f): part_path(path, marks[tuple(columns[base])], label, base, p, seed, f) for base, p in bases.items() for f in wanted}

    def fit(job: tuple[str, int]) -> None:
        base, f = job
        parameters = bases[base]
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"{base}-{f}")
        train, valid = data.where(F.col(fold) != f), data.where(F.col(fold) == f)
        rest = {k: v for k, v in parameters.items() if k not in ("learner", "features", "early_stop")}
        known, asked = train, valid
        if "features" in parameters:
            known, asked = (VectorAssembler(inputCols=list(parameters["features"]), outputCol="features").transform(d.drop("features")) for d in (train, valid))
        if parameters.get("early_stop"):
            known, rest = known.withColumn("__stop", F.pmod(F.xxhash64(key), F.lit(8)) == 0), {**rest, "validationIndicatorCol": "__stop"}
        began = time.monotonic()
        model = trainer(parameters.get("learner", base), {"featuresCol": "features"}, rest, {"labelCol": label}, seed=seed, fold=f).fit(known)
        seconds = time.monotonic() - began
        found = model.transform(asked).select(key, "prediction", F.lit(f).alias(fold), F.lit(base).alias("base"), F.lit(seconds).alias("seconds"))
        found.write.mode("overwrite").parquet(parts[job])

    todo = [job for job, part in parts.items() if not is_complete(spark, part)]
    if todo:
        with ThreadPoolExecutor(max(1, min(parallel, len(todo)))) as pool:
            list(pool.map(inheritable_thread_target(spark)(fit), todo))
    schema = f"{key} {kind}, prediction double, {fold} int, base string, seconds double"
    return spark.read.schema(schema).parquet(*parts.values()).select(key, fold, "base", "prediction", *(["seconds"] if timed else []))


def scored(predictions: DataFrame, df: DataFrame, label: str, key: str) -> DataFrame:
    """``predictions`` with their labels, in tasks of bounded rows."""
    rows = predictions.count()
    return dealt(predictions, rows, key).join(dealt(df.select(key, label), rows, key), key)


def fold_metrics(predictions: DataFrame, df: DataFrame, label: str, fold: str, key: str) -> DataFrame:
    """Metrics of each fold and base over the rows scored so far, with the seconds of its fit where ``predictions`` have them."""
    found = metrics(scored(predictions, df, label, key), label, "prediction", [fold, "base"])
    return found.join(predictions.groupBy(fold, "base").agg(F.max("seconds").alias("seconds")), [fold, "base"]) if "seconds" in predictions.columns else found


def importances(model, names: Sequence[str]) -> list[tuple[str, float]]:
    """A fitted tree model's features with their importances, greatest first."""
    return sorted(zip(names, map(float, model.featureImportances.toArray()), strict=True), key=lambda x: (-x[1], x[0]))


def knn_fold(train: DataFrame, valid: DataFrame, key: str, inputs: Sequence[str], target: str, k: int, clip: float = 8.0) -> DataFrame:
    """k-NN predictions of ``valid``: medians for nulls, means and deviations of ``train``, clipped, then block matrix products."""
    middles = {c: r[0] for c in inputs for r in percentiles(train, (), c, [0.5]).select(F.col("quantiles")[0]).collect()}
    filled = [d.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(middles.get(c, 0.0))) for c in inputs}) for d in (train, valid)]
    row = filled[0].agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(inputs) for n, f in (("a", F.avg), ("s", F.stddev_pop))]).first()
    scaled = F.array(*[F.greatest(F.least((F.col(c) - (row[f"a{i}"] or 0.0)) / F.lit(row[f"s{i}"] if (row[f"s{i}"] or 0) > 1e-8 else 1.0), F.lit(clip)), F.lit(-clip)) for i, c in enumerate(inputs)])
    t, v = (d.withColumn("__v", scaled) for d in filled)
    return feature_knn(v, t, key, "__v", target, k)


def wide(predictions: DataFrame, key: str, bases: Sequence[str]) -> DataFrame:
    """One row per key with every base's prediction; keys that lack one are left out. Tasks have bounded rows: a key has few, which adding up before the shuffle would not lessen."""
    return dealt(predictions, predictions.count(), key).groupBy(key).agg(*[F.min(F.when(F.col("base") == b, F.col("prediction"))).alias(f"pred_{b}") for b in bases]).dropna()


def ridge(df: DataFrame, label: str, inputs: Sequence[str], alpha: float = 1.0):
    """Closed-form ridge with penalty alpha * |w|^2: Spark scales the penalty by n and the label's deviation, so that is undone."""
    row = df.agg(F.stddev_pop(label), F.count("*")).first()
    vectors = VectorAssembler(inputCols=list(inputs), outputCol="__x").transform(df)
    return LinearRegression(featuresCol="__x", labelCol=label, elasticNetParam=0.0, standardization=False, solver="normal", regParam=alpha * row[0] / row[1]).fit(vectors)


def _sums(df: DataFrame, label: str, inputs: Sequence[str], fold: str, centred: bool) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Centres, and for each fold the matrix of sums of products of (1, inputs, label): one aggregate, a row for each fold."""
    names = [*inputs, label]
    centre = np.array(df.agg(*[F.avg(c) for c in names]).first() if centred else [0.0] * len(names), dtype=float)
    terms = [F.lit(1.0), *[F.col(c) - F.lit(float(m)) for c, m in zip(names, centre, strict=True)]]
    pairs = [(i, j) for i in range(len(terms)) for j in range(i, len(terms))]
    out = {}
    for r in df.groupBy(fold).agg(*[F.sum(terms[i] * terms[j]).alias(f"m{i}_{j}") for i, j in pairs]).collect():
        m = np.zeros((len(terms), len(terms)))
        for i, j in pairs:
            m[i, j] = m[j, i] = r[f"m{i}_{j}"]
        out[r[fold]] = m
    return centre, out


def _nonnegative(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least-squares weights with no negative one, from normal equations, by Lawson and Hanson's active sets."""
    w, free, tolerance = np.zeros(len(b)), np.zeros(len(b), dtype=bool), 1e-12 * (1 + np.abs(b).max(initial=0.0))
    while True:
        slope = np.where(free, -np.inf, b - a @ w)
        if not len(b) or slope.max() <= tolerance:
            return w
        free[slope.argmax()] = True
        while True:
            s = np.zeros(len(b))
            s[free] = np.linalg.lstsq(a[np.ix_(free, free)], b[free], rcond=None)[0]
            if (s[free] > 0).all():
                break
            short = free & (s <= 0)
            w = w + (w[short] / (w[short] - s[short])).min() * (s - w)
            free &= w > 1e-15
        w = s


def cross_fitted(df: DataFrame, label: str, inputs: Sequence[str], fold: str, alpha: float = 1.0, nonnegative: bool = False) -> dict[int, tuple[list[float], float]]:
    """For each fold the weights and intercept fitted on the others, from sums of products: ridge with a free intercept, or non-negative weights without one."""
    centre, sums = _sums(df, label, inputs, fold, not nonnegative)
    whole, out = sum(sums.values()), {}
    for f, own in sums.items():
        m = whole - own
        if nonnegative:
            out[f] = (_nonnegative(m[1:-1, 1:-1], m[1:-1, -1]).tolist(), 0.0)
            continue
        mean = m[0, 1:] / max(m[0, 0], 1.0)
        c = m[1:, 1:] - m[0, 0] * np.outer(mean, mean)
        w = np.linalg.lstsq(c[:-1, :-1] + alpha * np.eye(len(inputs)), c[:-1, -1], rcond=None)[0]
        out[f] = (w.tolist(), float(centre[-1] + mean[-1] - w @ (centre[:-1] + mean[:-1])))
    return out


def weighted(df: DataFrame, inputs: Sequence[str], fold: str, fitted: Mapping[int, tuple[Sequence[float], float]], name: str = "stacked") -> DataFrame:
    """Applies each fold's weights to its rows."""
    value = F.lit(None).cast("double")
    for f, (w, intercept) in fitted.items():
        value = F.when(F.col(fold) == f, reduce(lambda a, x: a + x, [F.col(c) * F.lit(float(v)) for c, v in zip(inputs, w, strict=True)], F.lit(float(intercept)))).otherwise(value)
    return df.withColumn(name, value)


def cross_fitted_ridge(df: DataFrame, label: str, inputs: Sequence[str], fold: str, alpha: float = 1.0) -> DataFrame:
    """Ridge predictions of each fold from the others; ``inputs`` may have context columns beside the predictions."""
    df = cut(df)
    return weighted(df, inputs, fold, cross_fitted(df, label, inputs, fold, alpha))


def search(df: DataFrame, label: str, fold: str, folds: int, base: str, grid: Sequence[Mapping], key: str, path: str | None = None) -> list[tuple[float, Mapping]]:
    """Mean absolute error of each parameter set over all folds, best first: the full grid."""
    return [(error, parameters) for error, parameters, _ in halving(df, label, fold, folds, base, grid, key, keep=1.0, path=path)]


def halving(df: DataFrame, label: str, fold: str, folds: int, base: str, grid: Sequence[Mapping], key: str, keep: float = 0.5, least: int = 2, path: str | None = None) -> list[tuple[float, Mapping, int]]:
    """(mean absolute error, parameters, folds used), best first: successive halving over folds.

    All sets are scored on one fold; the best ``keep`` of them (``least`` sets at least) go on to twice as many, until some have been scored on
    all. A set's earlier folds are read from its stored parts, so a round costs only the new ones, and a run with the same ``path`` goes on where it stopped.
    """
    data = cut(df)
    path = path or new_path(df.sparkSession, "search")
    left, out, used = list(enumerate(grid)), {}, folds if keep >= 1 else 1
    while True:
        bases = {f"{base}-{i}": {"learner": base, **p} for i, p in left}
        found = out_of_fold(data, label, fold, folds, bases, key, path=path, only=range(used))
        errors = {r["base"]: r["e"] for r in found.join(data.select(key, label), key).groupBy("base").agg(F.avg(F.abs(F.col(label) - F.col("prediction"))).alias("e")).collect()}  # a row for each set
        out |= {i: (errors[f"{base}-{i}"], p, used) for i, p in left}
        if used == folds:
            return sorted(out.values(), key=lambda x: (-x[2], x[0]))
        best = sorted(left, key=lambda x: (errors[f"{base}-{x[0]}"], x[0]))
        left, used = best[: max(min(least, len(best)), math.ceil(keep * len(best)))], min(folds, 2 * used)


def by_mode(df: DataFrame, y: str, predictions: Mapping[str, str]) -> DataFrame:
    """Metrics of several predictions of the same rows (with and without a signal, say), a row for each mode."""
    modes = [df.select(F.lit(m).alias("mode"), y, F.col(p).alias("p")) for m, p in predictions.items()]
    return metrics(reduce(DataFrame.unionByName, modes), y, "p", ["mode"])


def ablation(df: DataFrame, label: str, inputs: Sequence[str], fold: str, drops: Mapping[str, Sequence[str]], alpha: float = 1.0) -> DataFrame:
    """Metrics of cross-fitted ridge with all inputs (``none``) and without each named set of them."""
    df = cut(df)
    scored = df
    variants = {"none": (), **drops}
    for i, gone in enumerate(variants.values()):
        kept = [c for c in inputs if c not in gone]
        scored = weighted(scored, kept, fold, cross_fitted(df, label, kept, fold, alpha), f"__p{i}")
    return by_mode(scored, label, {v: f"__p{i}" for i, v in enumerate(variants)}).withColumnRenamed("mode", "dropped")


def routed(df: DataFrame, signal: str, with_signal: str, without: str):
    """The prediction to use: by whether the signal is there."""
    return df.withColumn("routed", F.when(F.col(signal).isNotNull(), F.col(with_signal)).otherwise(F.col(without)))
