"""Baseline models on anchor features (MLlib), scored with the engine's own metrics."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoward.operators import evaluation as ev

#: (depth, trees) of the boosted trees that are tried.
GRID = [(3, 10), (3, 20), (5, 10), (5, 20)]


def _assembled(df: DataFrame, features: list[str], label: str, part: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    data = VectorAssembler(inputCols=features, outputCol="features").transform(df).select(
        "features", F.col(label).cast("double").alias("label"), F.col(part).alias("part")
    )
    return tuple(data.filter(F.col("part") == p) for p in ("train", "val", "test"))


def classifier_report(df: DataFrame, features: list[str], label: str, part: str, grid: list[tuple[int, int]] | None = None) -> DataFrame:
    """``model, chosen, n_pos, n_neg, auroc, auprc, spec_at_sens`` on the test rows.

    ``part`` holds train, val or test; ``features`` are doubles without nulls. Of the
    boosted trees of ``grid`` the one of the greatest AUPRC on the validation rows
    counts; ``chosen`` names its depth and number of trees.
    """
    train, val, test = _assembled(df, features, label, part)
    train = train.persist()

    def scored(model, rows: DataFrame, name: str) -> DataFrame:
        return model.transform(rows).select(
            F.lit(name).alias("model"), F.col("label").cast("boolean").alias("y"), vector_to_array("probability")[1].alias("p")
        )

    def metrics(rows: DataFrame) -> DataFrame:
        return ev.ranking_metrics(ev.score_levels(rows, F.col("y"), F.col("p"), F.col("model"))).withColumnRenamed("g", "model")

    fitted = {
        f"depth {depth}, {trees} trees": GBTClassifier(maxIter=trees, maxDepth=depth, seed=5).fit(train) for depth, trees in grid or GRID
    }
    tried = None
    for name, model in fitted.items():
        part_ = scored(model, val, name)
        tried = part_ if tried is None else tried.unionByName(part_)
    best = metrics(tried).orderBy(F.desc_nulls_last("auprc"), "model").first()
    chosen = best["model"] if best else next(iter(fitted))
    logistic = LogisticRegression(maxIter=50, regParam=0.01).fit(train)
    out = metrics(scored(fitted[chosen], test, "gbt").unionByName(scored(logistic, test, "logistic")))
    train.unpersist()
    return out.withColumn("chosen", F.when(F.col("model") == "gbt", F.lit(chosen)))


def regressor_report(df: DataFrame, features: list[str], target: str, part: str, grid: list[tuple[int, int]] | None = None) -> DataFrame:
    """``model, chosen, n, mae, rmse, r2`` on the test rows; of the grid the least RMSE on the validation rows counts."""
    train, val, test = _assembled(df, features, target, part)
    train = train.persist()

    def report(model, rows: DataFrame, name: Column) -> DataFrame:
        sums = model.transform(rows).agg(*ev.regression_sums(F.col("label"), F.col("prediction")))
        return sums.filter("n > 0").select(name.alias("model"), "n", *ev.regression_metrics_from_sums())

    fitted = {
        f"depth {depth}, {trees} trees": GBTRegressor(maxIter=trees, maxDepth=depth, seed=5).fit(train) for depth, trees in grid or GRID
    }
    tried = None
    for name, model in fitted.items():
        row = report(model, val, F.lit(name))
        tried = row if tried is None else tried.unionByName(row)
    best = tried.orderBy("rmse", "model").first()
    chosen = best["model"] if best else next(iter(fitted))
    linear = LinearRegression(regParam=0.01).fit(train)
    out = report(fitted[chosen], test, F.lit("gbt")).unionByName(report(linear, test, F.lit("linear")))
    train.unpersist()
    return out.withColumn("chosen", F.when(F.col("model") == "gbt", F.lit(chosen)))
