"""Errors, rank correlation, coverage and width of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.operators.splits import running

BY = ["split", "seed"]


def _r(c, name: str):
    return F.round(c, 6).alias(name)


def point_metrics(test: DataFrame, by: list[str] = BY) -> DataFrame:
    """rmse, mae, r2 per (split, seed); a constant y counts as a total of 1e-12."""
    mean = test.groupBy(*by).agg(F.avg("y").alias("_m"))
    e = test.join(mean, by).withColumn("_e", F.col("y") - F.col("mu")).withColumn("_t", F.pow(F.col("y") - F.col("_m"), 2))
    total = F.when(F.sum("_t") == 0, 1e-12).otherwise(F.sum("_t"))
    return e.groupBy(*by).agg(_r(F.sqrt(F.avg(F.col("_e") * F.col("_e"))), "rmse"), _r(F.avg(F.abs("_e")), "mae"), _r(1 - F.sum(F.col("_e") * F.col("_e")) / total, "r2"))


def spearman(test: DataFrame, by: list[str] = BY) -> DataFrame:
    """Correlation of average ranks per (split, seed); null for two rows or fewer and for constants."""
    out = test.select(*by, "y", F.round("mu", 9).alias("mu"))
    for c in ("y", "mu"):
        ties = out.groupBy(*by, c).agg(F.count("*").alias("_n"))
        ranks = running(ties, by, [F.col(c)], F.col("_n")).select(*by, c, (F.col("_before") + (F.col("_n") + 1) / 2).alias(f"r_{c}"))
        out = out.join(ranks, [*by, c])
    together = F.try_divide(F.covar_pop("r_y", "r_mu"), F.stddev_pop("r_y") * F.stddev_pop("r_mu"))
    return out.groupBy(*by).agg(_r(F.when(F.count("*") > 2, together), "spearman"))


def coverage_strata(test: DataFrame, near: float = 0.7, novel: float = 0.5, by: list[str] = BY) -> DataFrame:
    """Coverage, mean width, and the width of rows with a near (nn >= 0.7) or no similar (nn < 0.5) fit row; empty strata are null."""
    w = 2 * F.col("half")
    return test.groupBy(*by).agg(
        _r(F.avg(F.col("covered").cast("double")), "coverage"), _r(F.avg(w), "mean_width"), _r(F.avg(F.when(F.col("nn") >= near, w)), "width_low_novel"), _r(F.avg(F.when(F.col("nn") < novel, w)), "width_high_novel")
    )


def fold_result(test: DataFrame, by: list[str] = BY) -> DataFrame:
    """All figures of a fold in one row per (split, seed)."""
    return point_metrics(test, by).join(spearman(test, by), by).join(coverage_strata(test, by=by), by)


def render(results: DataFrame, by: list[str] = BY) -> list[str]:
    """Lines of text for a (small) results table: one a fold."""
    figure = lambda x, digits=2: "-" if x is None else f"{x:.{digits}f}"
    return [
        f"  [{'/'.join(str(r[c]) for c in by):>20}] R2={figure(r['r2'], 3)} RMSE={figure(r['rmse'])} rho={figure(r['spearman'], 3)} | normalised coverage {figure(r['coverage'])} width {figure(r['width'])} | binned coverage {figure(r['coverage_mondrian'])} width {figure(r['width_mondrian'])}"
        for r in results.orderBy(*by).collect()
    ]
