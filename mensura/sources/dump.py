"""Activities out of a database dump's tables, landed as Parquet or read over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.functions.keys import finite

TABLES = ("component_sequences", "target_components", "target_dictionary", "assays", "activities", "compound_structures", "molecule_dictionary", "docs")


def read_dump(spark: SparkSession, url: str | None = None, folder: str | None = None, **options: str) -> dict[str, DataFrame]:
    """The eight tables from a JDBC url (its driver must be on the classpath) or from Parquet."""
    if url:
        return {t: spark.read.format("jdbc").options(url=url, dbtable=t, **options).load() for t in TABLES}
    return {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in TABLES}


def dump_measurements(t: dict[str, DataFrame], endpoint: str, family: dict[str, str], assay_type: str = "B") -> DataFrame:
    """Measurements of one endpoint for a family of accessions, in one query for all genes.

    Six inner joins, and a left join for the year; a target of several components yields one row per
    component of the family. The filters stand next to their tables, so they are pushed into the scans.
    """
    genes = F.create_map(*[F.lit(x) for gene, acc in family.items() for x in (acc, gene)])
    csq = t["component_sequences"].filter(F.col("accession").isin(*family.values())).select("component_id", genes[F.col("accession")].alias("gene"))
    act = t["activities"].filter((F.col("standard_type") == endpoint) & (F.col("standard_relation") == "=") & F.col("pchembl_value").isNotNull()).select("assay_id", "molregno", "doc_id", "standard_type", "pchembl_value")
    a = t["assays"].filter(F.col("assay_type") == assay_type).select("assay_id", "tid", F.col("chembl_id").alias("assay"))
    cs = t["compound_structures"].filter("canonical_smiles is not null").select("molregno", F.col("canonical_smiles").alias("smiles"))
    targets = csq.join(t["target_components"].select("component_id", "tid"), "component_id").join(t["target_dictionary"].select("tid", F.col("chembl_id").alias("target_chembl_id")), "tid")
    joined = act.join(a, "assay_id").join(targets, "tid").join(cs, "molregno").join(t["molecule_dictionary"].select("molregno", F.col("chembl_id").alias("mol_id")), "molregno").join(t["docs"].select("doc_id", "year"), "doc_id", "left")
    value = finite(F.col("pchembl_value").try_cast("double"))
    return joined.select("gene", "target_chembl_id", "mol_id", "smiles", value.alias("pchembl"), F.col("standard_type").alias("endpoint"), F.col("year").cast("int").alias("year"), F.col("assay").alias("assay_id")).na.drop(subset=["smiles", "pchembl"])
