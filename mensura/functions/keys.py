"""Column expressions that bring keys, labels and placeholders to one spelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells that mean "no value" (fixed values, compared in upper case without outer blanks).
MISSING = ("", "NA", "N/A", "NAN", "NONE", "NULL", "-")
#: Blanks of every kind, also those that Java's \\s leaves out.
BLANK = "[\\s\\u00a0\\u2007\\u202f\\u200b\\ufeff]"


def trimmed(c: Column | str) -> Column:
    """Text without outer blanks of any kind; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def present(c: Column | str) -> Column:
    """Trimmed text, null for every placeholder of a missing value."""
    t = trimmed(c)
    return F.when(~F.upper(t).isin(*MISSING), t)


def finite(c: Column | str) -> Column:
    """A double, null for NaN and the infinities."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def molecule_key(c: Column | str) -> Column:
    """The key without case, blanks and a label in front such as ``InChIKey=``; null for placeholders."""
    c = F.col(c) if isinstance(c, str) else c
    bare = F.regexp_replace(F.upper(F.regexp_replace(c, BLANK, "")), "^[A-Z_]+[=:]", "")
    return F.when(~bare.isin(*MISSING), bare)


def compact(c: Column | str) -> Column:
    """Upper case without any blanks; null for placeholders."""
    c = F.col(c) if isinstance(c, str) else c
    bare = F.upper(F.regexp_replace(c, BLANK, ""))
    return F.when(~bare.isin(*MISSING), bare)


def usable_year(c: Column | str, low: int = 1970, high: int = 2026) -> Column:
    """The year if it lies in [low, high], else null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.between(low, high), c.cast("int"))


def with_molecule(df: DataFrame, id_col: str = "rec_id", key: str = "inchikey", smiles: str = "std_smiles", out: str = "molecule") -> DataFrame:
    """Add ``out``: the normalised key, or where it is missing that of the rows with a key and the same text in ``smiles``.

    If such rows state several keys, the one most of them state holds, of equally frequent ones the
    smallest. Rows without key and without such a partner get null. Only rows without a key are
    shuffled against the (text, key) counts; the others pass straight through.
    """
    base = df.withColumn(out, molecule_key(key))
    lost = base.filter(F.col(out).isNull()).drop(out).withColumn("__text", present(smiles))
    texts = lost.filter(F.col("__text").isNotNull()).select("__text").distinct()
    stated = (
        base.filter(F.col(out).isNotNull()).select(present(smiles).alias("__text"), F.col(out))
        .join(texts, "__text", "left_semi")
        .groupBy("__text", out).agg(F.count("*").alias("__n"))
        .groupBy("__text").agg(F.min_by(out, F.struct(-F.col("__n"), F.col(out))).alias(out))
    )
    found = lost.join(stated, "__text", "left").drop("__text")
    return base.filter(F.col(out).isNotNull()).unionByName(found)


def with_target(df: DataFrame, targets: DataFrame, gene: str = "gene", target: str = "target_chembl_id", out: str = "target") -> DataFrame:
    """Add ``out``: the dictionary's target for the gene or a synonym of it; where the gene is empty, the target id without ``BDB:``.

    A gene that the dictionary lacks stands for itself. Null where both are missing.
    ``targets`` is joined on the name, so its size is up to Spark's own broadcast threshold.
    """
    names = (
        targets.select(F.upper(trimmed("chembl_id")).alias("__target"), F.explode(F.array_union(F.array("gene"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("__gene"))
        .select(F.upper(trimmed("__gene")).alias("__gene"), "__target").filter("__gene is not null").groupBy("__gene").agg(F.min("__target").alias("__target"))
    )
    own = F.regexp_replace(F.upper(present(target)), "^BDB:\\s*", "")
    return (
        df.withColumn("__gene", F.upper(present(gene))).join(names, "__gene", "left")
        .withColumn(out, F.when(F.col("__gene").isNull(), F.when(~own.isin(*MISSING), own)).otherwise(F.coalesce("__target", F.concat(F.lit("GENE:"), "__gene"))))
        .drop("__gene", "__target")
    )
