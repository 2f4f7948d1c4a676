"""Queries of the numbered general problems (5 and 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.functions.keys import compact, finite, present, usable_year
from mensura.operators.fill_missing import fill_from_clusters, held_out_error
from mensura.operators.schema_drift import schema_changes, unified
from mensura.session import cut
from mensura.sources.tables import table


def _features() -> dict:
    return {
        "numeric": {"pchembl": F.when(finite("pchembl").between(0, 14), F.col("pchembl")), "loaded": F.col("loaded_at").cast("timestamp").cast("double") / 86400},
        "categorical": {"gene": compact("gene"), "endpoint": compact("endpoint"), "source": compact("source")},
    }


def filled_years(spark: SparkSession, folder: str) -> DataFrame:
    """measurement with year_filled and year_method."""
    m = table(spark, folder, "measurement")
    return fill_from_clusters(m, usable_year("year"), F.upper(present("assay_id")), **_features(), out="year_filled", method="year_method")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return filled_years(spark, folder).filter("year_method = 'entity'").select("row_id", F.col("year_filled").cast("int").alias("year"))


def p5_filled(spark: SparkSession, folder: str) -> DataFrame:
    return filled_years(spark, folder).select("row_id", "year", "year_filled", "year_method")


def p5_levels(spark: SparkSession, folder: str) -> DataFrame:
    """How many rows each level fills; what has no entity's value goes to its cluster or the table."""
    level = F.when(F.col("year_method").isin("observed", "entity"), F.col("year_method")).otherwise("cluster or table")
    return filled_years(spark, folder).groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.count("year_filled").alias("n_filled"))


def p5_genes(spark: SparkSession, folder: str) -> DataFrame:
    """A categorical field: the gene of rows without one, from their target, the rows most like them, or the table."""
    m = table(spark, folder, "measurement")
    numeric, categorical = _features().values()
    like = {n: c for n, c in categorical.items() if n != "gene"}
    filled = fill_from_clusters(m, compact("gene"), F.upper(present("target_chembl_id")), numeric, like, out="gene_filled", method="gene_method", kind="category")
    return filled.select("row_id", "gene_filled", "gene_method")


def p5_holdout(spark: SparkSession, folder: str) -> DataFrame:
    """What each level is worth: every fifth observed year hidden and filled again."""
    return held_out_error(table(spark, folder, "measurement"), usable_year("year"), F.upper(present("assay_id")), **_features(), order=F.col("row_id"))


def _changes(spark: SparkSession, folder: str) -> DataFrame:
    return schema_changes(table(spark, folder, "export_file"), table(spark, folder, "export_line"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _changes(spark, folder).select("file_id", "change_type", "column_name")


def p7_table(spark: SparkSession, folder: str) -> DataFrame:
    return unified(table(spark, folder, "export_file"), table(spark, folder, "export_line"), cut(_changes(spark, folder)))


def queries() -> dict:
    return {f.__name__: f for f in (p5_found, p5_filled, p5_levels, p5_genes, p5_holdout, p7_found, p7_table)}


def oracle_sql() -> dict[str, str]:
    """The mode of every assay's usable years, in SQL."""
    from mensura.plans.oracle import present

    assay = f"upper({present('assay_id')})"
    return {
        "p5_levels": f"""with m as (select {assay} as assay, case when year between 1970 and 2026 then year end as year from measurement), known as (select distinct assay from m where year is not null and assay is not null)
            select case when year is not null then 'observed' when known.assay is not null then 'entity' else 'cluster or table' end as level, count(*) as n, count(*) as n_filled from m left join known using (assay) group by 1""",
        "p5_found": f"""with m as (select row_id, {assay} as assay, case when year between 1970 and 2026 then year end as year from measurement),
            counted as (select assay, year, count(*) as n from m where assay is not null and year is not null group by 1, 2),
            modes as (select assay, year from counted qualify row_number() over (partition by assay order by n desc, year) = 1)
            select m.row_id, modes.year from m join modes using (assay) where m.year is null"""
    }
