"""Summaries over seeds, verdicts and the tables behind the figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BY = ["split", "seed"]
SPLITS = ("random", "scaffold", "cluster", "time")


def result_rows(normal: DataFrame, binned: DataFrame, by: list[str] = BY) -> DataFrame:
    """Results table: the fold figures of the normalised run and coverage and width of the binned one."""
    a = normal.select(*by, "rmse", "mae", "r2", "spearman", "coverage", F.col("mean_width").alias("width"), F.col("width_low_novel").alias("width_near"), F.col("width_high_novel").alias("width_novel"))
    b = binned.select(*by, F.col("coverage").alias("coverage_mondrian"), F.col("mean_width").alias("width_mondrian"))
    return a.join(b, by)


def _r(c, name: str):
    return F.round(c, 6).alias(name)


def seed_summary(results: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Means and population deviations over seeds (nulls skipped)."""
    return results.groupBy(*by, "split").agg(
        _r(F.avg("r2"), "r2"), _r(F.stddev_pop("r2"), "r2_sd"), _r(F.avg("rmse"), "rmse"), _r(F.avg("coverage"), "coverage"), _r(F.stddev_pop("coverage"), "cov_sd"), _r(F.avg("width"), "width"),
        _r(F.avg("coverage_mondrian"), "cov_mond"), _r(F.avg("width_mondrian"), "width_mond"),
    )


def gap_verdict(summary: DataFrame) -> DataFrame:
    """Random minus scaffold r2 with its deviation and what it says (one row)."""
    at = lambda s, c: F.max(F.when(F.col("split") == s, F.col(c)))
    both = summary.agg((at("random", "r2") - at("scaffold", "r2")).alias("gap"), F.hypot(at("random", "r2_sd"), at("scaffold", "r2_sd")).alias("gap_sd"))
    verdict = F.when(F.round(F.abs("gap"), 6) <= F.round("gap_sd", 6), "within noise").when(F.col("gap") > 0, "random over-estimates").otherwise("scaffold above random")
    return both.select(_r(F.col("gap"), "gap"), _r(F.col("gap_sd"), "gap_sd"), verdict.alias("verdict"))


def worst_split(summary: DataFrame) -> DataFrame:
    """The prospective split of lowest r2."""
    return summary.filter(F.col("split").isin("scaffold", "cluster", "time")).agg(F.min_by("split", F.struct("r2", "split")).alias("split"), F.min("r2").alias("r2"))


def overcoverage(summary: DataFrame, alpha: float = 0.1, by: tuple[str, ...] = ()) -> DataFrame:
    """Prospective splits that cover 0.03 or more above nominal, and whether binning brings them nearer without falling 0.02 below."""
    nominal = F.lit(1.0 - alpha)
    over = summary.filter(F.col("split").isin("scaffold", "cluster", "time") & (F.col("coverage") >= F.round(nominal + 0.03, 6)))
    better = (F.abs(F.col("cov_mond") - nominal) < F.abs(F.col("coverage") - nominal)) & (F.col("cov_mond") >= F.round(nominal - 0.02, 6))
    return over.select(*by, "split", "coverage", "width", "cov_mond", "width_mond", better.alias("improved"))


def _in_order(spark, rows: DataFrame) -> DataFrame:
    order = spark.createDataFrame([(s, i) for i, s in enumerate(SPLITS)], "split string, ord int")
    return order.join(rows, "split", "left")


def panel_audit(audit: DataFrame) -> DataFrame:
    return _in_order(audit.sparkSession, audit.select("split", "exact_dupe_keys", "frac_test_nn_ge_0_9", "scaffold_straddle_frac"))


def panel_mean_sd(results: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and sample deviation (null as 0) over seeds, in the order of the splits; absent splits have null means."""
    g = results.groupBy("split").agg(*[x for c in columns for x in (_r(F.avg(c), f"{c}_mean"), _r(F.coalesce(F.stddev_samp(c), F.lit(0.0)), f"{c}_sd"))])
    return _in_order(results.sparkSession, g)


def panel_widths(results: DataFrame) -> DataFrame:
    return _in_order(results.sparkSession, results.groupBy("split").agg(_r(F.avg("width_near"), "near"), _r(F.avg("width_novel"), "novel")))
