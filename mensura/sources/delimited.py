"""Tolerant readers of delimited exports: one wide TSV, or a folder of CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.functions.keys import present
from mensura.functions.text import equals_relation, exact_number, first_match, p_scale

#: Value column of each endpoint and the start of the accession columns (fixed values).
ENDPOINT_COLUMN = {"Ki": "Ki (nM)", "IC50": "IC50 (nM)", "Kd": "Kd (nM)"}
ACCESSION_PREFIX = "UniProt (SwissProt) Primary ID of Target Chain"
#: Header texts of the fields of a narrow export (fixed values).
HEADERS = {
    "smiles": ("Smiles", "Canonical Smiles", "canonical_smiles"), "endpoint": ("Standard Type", "standard_type"), "relation": ("Standard Relation", "standard_relation"), "pchembl": ("pChEMBL Value", "pchembl_value"),
    "year": ("Document Year", "document_year"), "assay_id": ("Assay ChEMBL ID", "assay_chembl_id"), "mol_id": ("Molecule ChEMBL ID", "molecule_chembl_id"), "target_chembl_id": ("Target ChEMBL ID", "target_chembl_id"),
}


def find_column(columns: list[str], *candidates: str) -> str | None:
    """The first candidate that exists, compared without case and outer blanks."""
    at = {c.strip().lower(): c for c in reversed(columns)}
    return next((at[c.lower()] for c in candidates if c.lower() in at), None)


def require(found: dict[str, object], where: str) -> None:
    missing = [k for k, v in found.items() if not v]
    if missing:
        raise ValueError(f"{where}: no column for {', '.join(missing)}")


def parse_lines(lines: DataFrame, header: str, line: str = "value", separator: str = "\t") -> DataFrame:
    """Columns c0, c1, ... of tab-separated lines without quoting.

    Lines with more fields than the header are dropped, short ones are padded with nulls, and the usual
    placeholders count as missing. Works on batches and on streams alike; other columns are kept.
    """
    n = len(header.split(separator))
    fields = F.split(F.col(line), separator.replace("|", "\\|"), -1)
    kept = lines.filter(F.col(line).isNotNull() & (F.col(line) != F.lit(header)) & (F.size(fields) <= n)).withColumn("_f", fields)
    return kept.select(*[c for c in lines.columns if c != line], *[present(F.get("_f", F.lit(i))).alias(f"c{i}") for i in range(n)])


def wide_measurements(lines: DataFrame, header: str, endpoint: str, family: dict[str, str], line: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Measurements of one endpoint out of the wide TSV's lines.

    A line counts if any chain's accession belongs to the family (the first that does gives the gene) and
    its value is an exact number; values become 9 - log10(nM), zero and less are dropped. ``family`` is a
    small gene -> accession dictionary.
    """
    columns = header.split("\t")
    c_smiles, c_value = find_column(columns, "Ligand SMILES", "SMILES"), find_column(columns, ENDPOINT_COLUMN[endpoint])
    accessions = [i for i, c in enumerate(columns) if c.startswith(ACCESSION_PREFIX)]
    require({"smiles": c_smiles, ENDPOINT_COLUMN[endpoint]: c_value, "accession": accessions}, "TSV")
    c_mol = find_column(columns, "BindingDB MonomerID", "BindingDB Ligand Name", "Ligand InChI Key")
    at = lambda name: f"c{columns.index(name)}"
    genes = F.create_map(*[F.lit(x) for gene, acc in family.items() for x in (acc, gene)])
    rows = parse_lines(lines, header, line).withColumn("_a", first_match([f"c{i}" for i in accessions], list(family.values())))
    rows = rows.filter("_a is not null").withColumn("_p", p_scale(exact_number(at(c_value))))
    return rows.filter("_p is not null").filter(F.col(at(c_smiles)).isNotNull()).select(
        *keep, genes[F.col("_a")].alias("gene"), F.concat(F.lit("BDB:"), "_a").alias("target_chembl_id"), (F.col(at(c_mol)) if c_mol else F.lit("BDB_NA")).alias("mol_id"), F.col(at(c_smiles)).alias("smiles"),
        F.col("_p").alias("pchembl"), F.lit(endpoint).alias("endpoint"), F.lit(None).cast("int").alias("year"), F.lit("BDB").alias("assay_id"), F.lit("BindingDB").alias("source"),
    )


def read_tsv(spark: SparkSession, path: str, endpoint: str, family: dict[str, str]) -> DataFrame:
    """The same from a file; only its first line comes to the driver."""
    lines = spark.read.text(path)
    return wide_measurements(lines, lines.first()["value"], endpoint, family)


def narrow_measurements(rows: DataFrame, endpoint: str, gene: Column, where: str = "CSV") -> DataFrame:
    """Measurements of one endpoint out of a frame of text columns with the usual headers.

    Endpoint without case and blanks; relation '=' or only quotes (a missing relation is dropped, a
    missing column is not); numbers that cannot be read are dropped with their rows.
    """
    cols = rows.columns
    at = {k: find_column(cols, *v) for k, v in HEADERS.items()}
    require({k: at[k] for k in ("smiles", "endpoint", "pchembl")}, where)
    c = lambda k: F.col(f"`{at[k]}`")
    kept = rows.filter(F.upper(F.trim(c("endpoint"))) == endpoint.upper())
    if at["relation"]:
        kept = kept.filter(equals_relation(c("relation")))
    text = lambda k: (present(c(k)) if at[k] else F.lit("NA")).alias(k)
    return kept.select(
        gene.alias("gene"), text("target_chembl_id"), text("mol_id"), present(c("smiles")).alias("smiles"), exact_number(c("pchembl")).alias("pchembl"), F.lit(endpoint).alias("endpoint"),
        (exact_number(c("year")).cast("int") if at["year"] else F.lit(None).cast("int")).alias("year"), text("assay_id"),
    ).na.drop(subset=["smiles", "pchembl"])


def read_export_folder(spark: SparkSession, path: str, endpoint: str) -> DataFrame:
    """A folder of CSV files with one header text, parted by gene (``gene=..``): one scan however many files there are."""
    rows = spark.read.csv(path, sep=";", header=True)
    return narrow_measurements(rows, endpoint, F.upper(F.col("gene")), path)


def read_csv_dir(spark: SparkSession, paths: list[str], endpoint: str) -> DataFrame:
    """Every file of the list; the gene is the file name. A file with one column under ';' is read with ','."""
    out = None
    for path in sorted(paths):
        d = spark.read.csv(path, sep=";", header=True)
        d = spark.read.csv(path, sep=",", header=True) if len(d.columns) == 1 else d
        gene = path.rsplit("/", 1)[-1].rsplit(".", 1)[0].upper()
        part = narrow_measurements(d, endpoint, F.lit(gene), path)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no CSV files")
    return out


def read_results(spark: SparkSession, pattern: str) -> DataFrame:
    """Result tables written as CSV; the endpoint is the last part of the file name."""
    return spark.read.csv(pattern, header=True, inferSchema=True).withColumn("file_endpoint", F.regexp_extract("_metadata.file_name", "_([^_.]+)\\.csv$", 1))
