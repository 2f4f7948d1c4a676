"""Split-conformal intervals: one normalised quantile, or one a difficulty bin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mensura.operators.splits import quantiles, running

BY = ["split", "seed"]


def rank_of(n: Column, alpha: float) -> Column:
    """1-based rank of the conformal quantile: min(n, ceil((n + 1)(1 - alpha)) + 1)."""
    return F.least(n, F.ceil((n + 1) * F.lit(1.0 - alpha)) + 1)


def conformal_quantile(scores: DataFrame, by: list[str], score: str = "score", alpha: float = 0.1) -> DataFrame:
    """(by, q, n): the score of that rank in every group."""
    r = running(scores.select(*by, score), by, [F.col(score)])
    return r.groupBy(*by).agg(F.max(F.when(F.col("_before") + 1 == rank_of(F.col("_total"), alpha), F.col(score))).alias("q"), F.max("_total").alias("n"))


def _bounded(rows: DataFrame) -> DataFrame:
    return rows.withColumn("lo", F.col("mu") - F.col("half")).withColumn("hi", F.col("mu") + F.col("half")).withColumn("covered", F.col("y").between(F.col("lo"), F.col("hi")))


def normalised(predicted: DataFrame, alpha: float = 0.1, by: list[str] = BY) -> DataFrame:
    """Test rows with half = q * sigma, q the quantile of abs(y - mu) / sigma over the calibration rows."""
    scores = predicted.filter("role = 'cal'").select(*by, (F.abs(F.col("y") - F.col("mu")) / F.col("sigma")).alias("score"))
    q = conformal_quantile(scores, by, alpha=alpha).select(*by, "q")
    return _bounded(predicted.filter("role = 'test'").join(q, by).withColumn("half", F.col("q") * F.col("sigma")).drop("q"))


def mondrian(predicted: DataFrame, alpha: float = 0.1, bins: int = 5, least: int = 10, by: list[str] = BY) -> DataFrame:
    """Test rows with half = the quantile of abs(y - mu) in their bin of sigma.

    Inner edges are the calibration rows' sigma quantiles; a row's bin is the number of edges at or below
    its sigma. Bins with fewer than ``least`` calibration rows use the quantile of all.
    """
    cal = predicted.filter("role = 'cal'")
    edges = quantiles(cal, by, "sigma", [i / bins for i in range(1, bins)]).withColumnRenamed("q", "edges")
    binned = predicted.join(edges, by).withColumn("bin", F.size(F.filter("edges", lambda e: e <= F.col("sigma")))).drop("edges")
    scores = binned.filter("role = 'cal'").withColumn("score", F.abs(F.col("y") - F.col("mu")))
    overall = conformal_quantile(scores, by, alpha=alpha).select(*by, F.col("q").alias("q_all"))
    per_bin = conformal_quantile(scores, [*by, "bin"], alpha=alpha).filter(F.col("n") >= least).select(*by, "bin", F.col("q").alias("q_bin"))
    test = binned.filter("role = 'test'").join(overall, by).join(per_bin, [*by, "bin"], "left")
    return _bounded(test.withColumn("half", F.coalesce("q_bin", "q_all")).drop("q_all", "q_bin"))
