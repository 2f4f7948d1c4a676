"""Replicates and sources folded to one row per molecule, gene and endpoint, with provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mensura.functions.keys import compact, finite, molecule_key, present, usable_year

KEY = ["inchikey", "gene", "endpoint"]


def first_by(value: str, order: str) -> Column:
    """The first non-null value in the given order (as a frame's ``first`` is)."""
    return F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order)))


def clean_records(records: DataFrame) -> DataFrame:
    """compound_target rows with keys in one spelling, NaN and values off the scale as null; rows without a key or value are dropped."""
    out = records.select(
        "rec_id", molecule_key("inchikey").alias("inchikey"), F.upper(present("gene")).alias("gene"), compact("endpoint").alias("endpoint"), present("std_smiles").alias("std_smiles"),
        F.when(finite("pchembl").between(0, 14), F.col("pchembl")).alias("pchembl"), usable_year("year").alias("year"), F.upper(present("target_chembl_id")).alias("target_chembl_id"),
        present("scaffold").alias("scaffold"), F.coalesce(F.lower(present("source")), F.lit("unknown")).alias("source"),
    )
    return out.na.drop(subset=[*KEY, "pchembl"])


def fold_replicates(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Per group: first text, median value, number of rows, earliest year, first target and scaffold (null group keys must be gone)."""
    firsts = [first_by(c, order).alias(c) for c in ("std_smiles", "target_chembl_id", "scaffold") if c in rows.columns]
    return rows.groupBy(*by).agg(F.median("pchembl").alias("pchembl"), F.count("*").alias("n_meas"), F.min("year").alias("year"), *firsts, F.min(order).alias("ord"))


def per_source(records: DataFrame) -> DataFrame:
    return fold_replicates(clean_records(records), [*KEY, "source"], "rec_id")


def merge_sources(sources: DataFrame) -> DataFrame:
    """Median of the sources' medians, first texts, earliest year and the sorted list of sources, in one aggregation."""
    return sources.groupBy(*KEY).agg(
        F.median("pchembl").alias("pchembl"), F.min("year").alias("year"), *[first_by(c, "ord").alias(c) for c in ("std_smiles", "target_chembl_id", "scaffold")],
        F.concat_ws(",", F.sort_array(F.collect_set("source"))).alias("sources"), F.min("ord").alias("ord"),
    ).withColumn("source", F.col("sources"))


def repeated_keys(rows: DataFrame, by: list[str]) -> DataFrame:
    """Number of keys that occur more than once (one row)."""
    return rows.groupBy(*by).count().agg(F.count_if(F.col("count") > 1).alias("n_repeated"), F.count("*").alias("n_keys"))


def require_unique(rows: DataFrame, by: list[str]) -> DataFrame:
    """The rows, failing the job if a key occurs twice."""
    repeated = F.raise_error(F.concat(F.lit("repeated key: "), F.concat_ws("|", *by))).cast("boolean")
    checked = rows.groupBy(*by).agg(F.count("*").alias("_n")).filter(F.when(F.col("_n") > 1, repeated).otherwise(F.lit(True))).select(*by)
    return rows.join(checked, by)


def overlap_report(merged: DataFrame, naive: DataFrame) -> DataFrame:
    """Totals of the merge against the naive union."""
    n = merged.agg(F.count("*").alias("n_merged"), F.count_if(F.col("sources").contains(",")).alias("n_in_several"), F.count_if(F.col("sources") == "chembl").alias("n_only_chembl"), F.count_if(F.col("sources") == "bindingdb").alias("n_only_bindingdb"))
    u = naive.agg(F.count("*").alias("n_naive"))
    both = n.join(u, F.lit(True))  # two rows of one
    return both.withColumn("n_removed", F.col("n_naive") - F.col("n_merged")).withColumn("removed_share", F.round(F.try_divide(F.col("n_removed").cast("double"), F.col("n_naive").cast("double")), 6))


def fill_defaults(merged: DataFrame) -> DataFrame:
    """Null scaffolds become '' and null years the median year of the table."""
    median = merged.agg(F.median("year").alias("_m"))
    return merged.join(median, F.lit(True)).withColumn("scaffold", F.coalesce("scaffold", F.lit(""))).withColumn("year", F.coalesce(F.col("year").cast("double"), "_m")).drop("_m")
