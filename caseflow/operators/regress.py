"""Reproducible split, linear fit, scoring, evaluation and the gated run of all of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.functions.typing import money_amount
from caseflow.operators.positions import medians
from caseflow.operators.shaping import guard

RIDGE = 1e-8


def split_byte(key: Column, seed: int) -> Column:
    """First byte of the MD5 of ``key:seed``."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)))), 1, 2), 16, 10).cast("int")


def hash_split(df: DataFrame, key: str, ratio: float = 0.8, seed: int = 1337) -> DataFrame:
    """Add ``part`` (train or val) from a stable key; the same key always falls on the same side.

    When no row would validate, the row with the last key does.
    """
    on_train = split_byte(F.col(key), seed) / 255.0 < ratio
    whole = df.select(key).agg(F.count_if(~on_train).alias("__val"), F.count(F.lit(1)).alias("__n"), F.max(key).alias("__last"))
    lonely = (F.col("__val") == 0) & (F.col("__n") > 1) & (F.col(key) == F.col("__last"))
    split = df.crossJoin(F.broadcast(whole))  # one row
    return split.withColumn("part", F.when(on_train & ~lonely, "train").otherwise("val")).drop("__val", "__n", "__last")


def _feature(c: str) -> Column:
    return F.col(c).cast("string").try_cast("double")


def train_linear(df: DataFrame, target: str, features: list[str], impute: str = "mean") -> DataFrame:
    """Least squares with a tiny ridge: one row per term (term, coef, impute_value), coefficients to 12 decimals.

    Rows without a numeric target drop out, missing features take the column mean or median. One aggregate gives counts,
    means and covariances of every pair of columns over the rows that have both; the (features + 1)^2 normal equations
    are solved from that one row, to which exact medians are joined if asked for. Nothing runs before the result is used; without rows that use fails.
    """
    cols = ["__y", *[f"__x{i}" for i in range(len(features))]]
    rows = df.select(*[_feature(f).alias(c) for f, c in zip([target, *features], cols)]).filter("__y IS NOT NULL")
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    aggs = [F.avg("__y").alias("c0"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(cols) if i and impute == "mean"]]
    for i, j in pairs:
        a, b = F.col(cols[i]), F.col(cols[j])
        both = a.isNotNull() & b.isNotNull()
        aggs += [
            F.count_if(both).cast("double").alias(f"n{i}_{j}"), F.covar_pop(a, b).alias(f"v{i}_{j}"),
            F.avg(F.when(both, a)).alias(f"a{i}_{j}"), F.avg(F.when(both, b)).alias(f"b{i}_{j}"),
        ]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, r in batch.iterrows():
                n, k = r["n0_0"], len(features)
                if not n:
                    raise ValueError(f"no rows with a numeric {target!r} to train on")

                def product(i: int, j: int) -> float:
                    """Sum of (x_i - c_i)(x_j - c_j) over the rows that have both; filled cells add nothing."""
                    m = r[f"n{i}_{j}"]
                    return m * (r[f"v{i}_{j}"] + (r[f"a{i}_{j}"] - r[f"c{i}"]) * (r[f"b{i}_{j}"] - r[f"c{j}"])) if m else 0.0

                left, right = np.zeros((k + 1, k + 1)), np.zeros(k + 1)
                left[0, 0] = n
                for i in range(1, k + 1):
                    m = r[f"n{i}_{i}"]
                    left[0, i] = left[i, 0] = m * (r[f"a{i}_{i}"] - r[f"c{i}"]) if m else 0.0
                    right[i] = product(0, i)
                    for j in range(i, k + 1):
                        left[i, j] = left[j, i] = product(i, j)
                weights = np.linalg.solve(left + RIDGE * np.eye(k + 1), right)
                fills = [float(r[f"c{i}"]) for i in range(1, k + 1)]
                intercept = float(r["c0"]) + weights[0] - float(np.dot(weights[1:], fills))
                terms = [("(intercept)", round(float(intercept), 12), None)]
                terms += [(f, round(float(w), 12), round(v, 12)) for f, w, v in zip(features, weights[1:], fills)]
                yield pd.DataFrame(terms, columns=["term", "coef", "impute_value"])

    sums = rows.agg(*aggs)
    if impute != "mean" and features:
        middles = medians(rows, cols[1:]).select(*[F.coalesce(c, F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(cols) if i])
        sums = sums.crossJoin(F.broadcast(middles))  # one row each
    return sums.mapInPandas(solve, "term string, coef double, impute_value double")


def mean_predictor(df: DataFrame, target: str) -> DataFrame:
    """Model with an intercept only, the fallback when nothing else can be fitted."""
    return df.agg(F.lit("(intercept)").alias("term"), F.avg(_feature(target)).alias("coef"), F.lit(None).cast("double").alias("impute_value"))


def fit_one_feature(df: DataFrame, target: str, feature: str, by: list[str] | None = None) -> DataFrame:
    """Slope and intercept of one feature, per group if asked; Spark's regression aggregates in one pass."""
    grouped = df.groupBy(*by) if by else df
    y, x = _feature(target), _feature(feature)
    return grouped.agg(
        F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2")
    )


def score_linear(df: DataFrame, model: DataFrame, into: str = "prediction") -> DataFrame:
    """Intercept plus the weighted, imputed features; the model is a handful of terms, joined as one row.

    Terms that name no column of ``df`` do not count.
    """
    entry = F.struct(F.coalesce("coef", F.lit(0.0)).alias("coef"), F.coalesce("impute_value", F.lit(0.0)).alias("fill"))
    one = model.agg(F.map_from_entries(F.collect_list(F.struct("term", entry))).alias("__model"))
    out = F.coalesce(F.try_element_at("__model", F.lit("(intercept)"))["coef"], F.lit(0.0))
    for c in df.columns:
        term = F.try_element_at("__model", F.lit(c))
        out = out + F.when(term.isNotNull(), F.coalesce(money_amount(F.col(f"`{c}`")), term["fill"]) * term["coef"]).otherwise(0.0)
    return df.crossJoin(F.broadcast(one)).withColumn(into, out).drop("__model")


def regression_metrics(df: DataFrame, target: str, prediction: str) -> DataFrame:
    """One row MSE, MAE, R2 (0 without variance); targets may carry currency signs, unreadable ones are skipped."""
    y = money_amount(F.col(target))
    rows = df.select(y.alias("y"), F.col(prediction).cast("double").alias("p")).filter("y IS NOT NULL")
    error = F.col("y") - F.col("p")
    n = F.count(F.lit(1))
    spread = F.var_pop("y") * n
    return rows.agg(
        F.coalesce(F.avg(error * error), F.lit(0.0)).alias("MSE"),
        F.coalesce(F.avg(F.abs(error)), F.lit(0.0)).alias("MAE"),
        F.when(spread > 0, 1.0 - F.sum(error * error) / spread).otherwise(0.0).alias("R2"),
    )


def quality_gate(metrics: DataFrame, threshold: float = 0.6, fail: bool = False) -> DataFrame:
    return guard(metrics, "R2", ">=", threshold, fail)


def run_regression(df: DataFrame, key: str, target: str, features: list[str], ratio: float = 0.8, seed: int = 1337) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Split, fit on the training side, evaluate on the other: (model, metrics, gate)."""
    parts = hash_split(df, key, ratio, seed)
    model = train_linear(parts.filter("part = 'train'"), target, features)
    metrics = regression_metrics(score_linear(parts.filter("part = 'val'"), model), target, "prediction")
    return model, metrics, quality_gate(metrics)
