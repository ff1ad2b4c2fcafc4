"""Boosting for the absolute error: trees on the signs of the residuals, leaf values from exact medians."""

from __future__ import annotations

from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnspark.operators.ranges import cut, medians


class MedianBoostingModel:
    """The median of the label, and for each round a tree and its leaves' values."""

    def __init__(self, centre: float, trees: list, leaves: list[dict[float, float]], rate: float, features: str):
        self.centre, self.trees, self.leaves, self.rate, self.features = centre, trees, leaves, rate, features

    def _value(self, i: int, leaf: Column) -> Column:
        table = F.create_map(*[F.lit(float(x)) for pair in self.leaves[i].items() for x in pair])
        return F.coalesce(F.element_at(table, leaf), F.lit(0.0)) * self.rate if self.leaves[i] else F.lit(0.0)

    def transform(self, df: DataFrame) -> DataFrame:
        total, names = F.lit(self.centre), []
        for i, tree in enumerate(self.trees):
            names += [f"__leaf{i}", f"__sign{i}"]
            df = tree.copy().setLeafCol(f"__leaf{i}").setPredictionCol(f"__sign{i}").transform(df)
            total = total + self._value(i, F.col(f"__leaf{i}"))
        return df.withColumn("prediction", total).drop(*names)


class MedianBoosting:
    """A learner with the shape of an estimator.

    Each round fits a tree of 2^maxDepth leaves at most to the signs of the residuals, which is the absolute error's gradient, and gives each leaf the exact
    median of its rows' residuals, all leaves in one pass over ranges. What the driver holds is a number for each leaf. With
    ``validationIndicatorCol`` rows marked by it aren't learned from, and rounds that follow their least mean absolute error are dropped once ``patience`` of them brought none.
    """

    def __init__(self, featuresCol: str = "features", labelCol: str = "label", seed: int = 0, maxIter: int = 20, maxDepth: int = 4, stepSize: float = 0.1, validationIndicatorCol: str | None = None, patience: int = 3):
        self.features, self.label, self.seed, self.rounds, self.depth, self.rate, self.held, self.patience = featuresCol, labelCol, seed, maxIter, maxDepth, stepSize, validationIndicatorCol, patience

    def fit(self, df: DataFrame) -> MedianBoostingModel:
        held = F.col(self.held) if self.held else F.lit(False)
        rows = cut(df.where(F.col(self.label).isNotNull()).select(self.features, F.col(self.label).cast("double").alias("__y"), held.alias("__held")))
        centre = medians(rows.where("not __held"), (), {"m": F.col("__y")}).first()[0] or 0.0
        model = MedianBoostingModel(float(centre), [], [], self.rate, self.features)
        rows = rows.withColumn("__r", F.col("__y") - F.lit(model.centre))
        best, kept = None, 0
        for i in range(self.rounds):
            train = rows.where("not __held").withColumn("__g", F.signum("__r"))
            tree = DecisionTreeRegressor(featuresCol=self.features, labelCol="__g", maxDepth=self.depth, seed=self.seed + i, predictionCol="__sign", leafCol="__leaf").fit(train)
            placed = cut(tree.transform(rows).drop("__sign"))
            found = medians(placed.where("not __held"), ["__leaf"], {"m": F.col("__r")}).collect()  # 2^depth rows at most
            model.trees.append(tree)
            model.leaves.append({r["__leaf"]: r["m"] for r in found})
            rows = placed.withColumn("__r", F.col("__r") - model._value(i, F.col("__leaf"))).drop("__leaf")
            if self.held:
                rows = cut(rows)
                error = rows.where("__held").agg(F.avg(F.abs("__r"))).first()[0]
                if best is None or (error is not None and error < best):
                    best, kept = error, i + 1
                elif i + 1 - kept >= self.patience:
                    break
        if self.held:
            model.trees, model.leaves = model.trees[:kept], model.leaves[:kept]
        return model

