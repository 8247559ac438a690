"""Closed-form estimates by aggregation, and small fits on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ols(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Least squares with one regressor a group, from sums."""
    return df.groupBy(group).agg(F.round(F.covar_pop(x, y) / F.var_pop(x), 6).alias("slope"), F.round(F.avg(y) - F.covar_pop(x, y) / F.var_pop(x) * F.avg(x), 4).alias("intercept"), F.count(F.lit(1)).alias("n"))


def kaplan_meier(df: DataFrame, group: str, time: str, event: str) -> DataFrame:
    """Survival after each event time: the running product of 1 - d / n over risk sets."""
    at = df.groupBy(group, time).agg(F.sum(event).alias("d"), F.count(F.lit(1)).alias("leaving"))
    risk = F.sum("leaving").over(Window.partitionBy(group).orderBy(F.desc(time)).rowsBetween(Window.unboundedPreceding, 0))
    at = at.withColumn("n", risk).filter("d > 0 and d < n")
    log = F.sum(F.log(1 - F.col("d") / F.col("n"))).over(Window.partitionBy(group).orderBy(time).rowsBetween(Window.unboundedPreceding, 0))
    return at.select(group, time, "n", "d", F.round(F.exp(log), 6).alias("survival"))


def logit(x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None, steps: int = 30) -> np.ndarray:
    """Binary logistic coefficients by Newton steps; x holds a column of ones if an intercept is wanted."""
    w0 = np.ones(len(y)) if weights is None else weights
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        move = np.linalg.solve((x * (w0 * p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(len(beta)), x.T @ (w0 * (y - p)))
        beta += move
        if np.abs(move).max() < 1e-10:
            break
    return beta


def cluster_covariance(x: np.ndarray, y: np.ndarray, beta: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    """Sandwich covariance of a logit with scores added up by cluster."""
    p = 1 / (1 + np.exp(-x @ beta))
    bread = np.linalg.inv((x * (p * (1 - p))[:, None]).T @ x)
    _, code = np.unique(cluster, return_inverse=True)
    g = code.max() + 1
    score = np.zeros((g, x.shape[1]))
    np.add.at(score, code, x * (y - p)[:, None])
    return g / (g - 1) * bread @ score.T @ score @ bread


def roc_points(df: DataFrame, group: str, score: str, label: str) -> DataFrame:
    """group, score, tpr, fpr and precision at each distinct score, rows at or above it being called positive, and the
    group's areas under the receiver curve (auc) and the precision-recall curve by steps (ap).

    What is windowed is one row for each distinct score, so round scores of many rows first. A null score or label is
    left out; a rate whose total is 0 is null.
    """
    known = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    at = known.groupBy(group, score).agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("q"))
    down = Window.partitionBy(group).orderBy(F.desc(score))
    all_rows, before = Window.partitionBy(group), down.rowsBetween(Window.unboundedPreceding, -1)
    run = {f"{c}_above": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("p", "q")} | {f"{c}_all": F.sum(c).over(all_rows) for c in ("p", "q")}
    at = at.withColumns(run).withColumns({"tp": F.col("p_above") + F.col("p"), "fp": F.col("q_above") + F.col("q")})
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    area = F.try_divide(F.col("q") * (F.col("p_above") + F.col("p") / 2), F.col("p_all") * F.col("q_all"))
    steps = F.try_divide(F.col("p"), F.col("p_all")) * precision
    out = at.select(group, score, F.try_divide("tp", "p_all").alias("tpr"), F.try_divide("fp", "q_all").alias("fpr"), precision.alias("precision"), F.sum(area).over(all_rows).alias("auc"), F.sum(steps).over(all_rows).alias("ap"))
    return out.select(group, score, *(F.round(c, 6).alias(c) for c in ("tpr", "fpr", "precision", "auc", "ap")))
