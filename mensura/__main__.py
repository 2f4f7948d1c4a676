"""The evaluation from the command line: python -m mensura --data FOLDER [--alpha ..] [--test-frac ..] [--seeds ..] [--report FOLDER]."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from mensura.operators import audit, conformal, metrics, models, report, splits
from mensura.plans import reference
from mensura.session import cut
from mensura.sources import sinks

BY = reference.EBY


def arguments(args: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="mensura", description="Audit and evaluate every endpoint of a data folder.")
    parser.add_argument("--data", required=True, help="folder of <table>.parquet")
    parser.add_argument("--alpha", type=float, default=0.1, help="1 - nominal coverage")
    parser.add_argument("--test-frac", type=float, default=0.25)
    parser.add_argument("--seeds", type=int, default=10, help="seeds of every split but time, which has one")
    parser.add_argument("--report", help="shared folder for audit, results and report text")
    return parser.parse_args(args)


def evaluate(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    """Audit (seed 1) and results of all four splits; written below ``--report`` if it is given."""
    plan = [(kind, seed) for kind in ("random", "scaffold", "cluster") for seed in range(1, a.seeds + 1)] + [("time", 1)]
    rows, pairs = reference.clustered_rows(spark, a.data)
    sided = cut(splits.split_table(rows, "key", plan, a.test_frac, by=("endpoint",)))
    leaks = cut(audit.leakage_audit(sided.filter("seed = 1"), cut(reference.first_sets(spark, a.data)), by=BY))
    roles = cut(splits.calibration_roles(splits.large_enough(sided, BY), "key", by=("endpoint",)))
    p = cut(models.knn_predict(roles, pairs, by=BY))
    normal = metrics.fold_result(cut(conformal.normalised(p, a.alpha, BY)), BY)
    binned = metrics.coverage_strata(cut(conformal.mondrian(p, a.alpha, by=BY)), by=BY)
    results = cut(report.result_rows(normal, binned, BY))
    summary = cut(report.seed_summary(results, ("endpoint",)))
    lines = ["LEAKAGE AUDIT", *audit.render(leaks, BY), "RESULTS", *metrics.render(results, BY), "COVERS TOO MUCH"]
    lines += [f"  {r['endpoint']} {r['split']}: {r['coverage']:.2f}, binned {r['cov_mond']:.2f}" for r in report.overcoverage(summary, a.alpha, ("endpoint",)).orderBy("endpoint", "split").collect()]
    if a.report:
        sinks.write_report(leaks, f"{a.report}/audit")
        sinks.write_report(results, f"{a.report}/results")
        sinks.write_text(spark, lines, f"{a.report}/report")
    else:
        print("\n".join(lines))
    return lines


if __name__ == "__main__":
    evaluate(SparkSession.builder.appName("mensura").getOrCreate(), arguments())
