"""Text columns: exact numbers, relations, canonical texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a plain decimal number looks like in ASCII.
NUMBER = "^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def exact_number(c: Column | str) -> Column:
    """The number a cell states exactly; null for '>', '<', '~', '=' in front, for blanks, words, 'nan', 'inf' and forms only one parser knows."""
    t = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def p_scale(nanomolar: Column) -> Column:
    """9 - log10(value); null for zero and less."""
    return F.when(nanomolar > 0, 9 - F.log10(nanomolar))


def equals_relation(c: Column | str) -> Column:
    """Whether the relation is '=' or only quotes; a missing one is not."""
    bare = F.btrim(F.trim(F.col(c) if isinstance(c, str) else c), F.lit("'\""))
    return F.coalesce(bare.isin("=", ""), F.lit(False)) & (F.trim(c) != "")


def first_match(columns: list[str], wanted: list[str]) -> Column:
    """The first of the columns, left to right, whose value is wanted."""
    return F.coalesce(*[F.when(F.col(c).isin(*wanted), F.col(c)) for c in columns])


def largest_fragment(smiles: Column | str) -> Column:
    """Text canonicaliser: the longest part between dots, of equally long ones the smaller; null if there is none.

    A stand-in for a chemistry toolkit's parent molecule (see ``functions.chem``); it compares texts, not structures.
    """
    s = F.trim(F.col(smiles) if isinstance(smiles, str) else smiles)
    best = F.array_min(F.transform(F.split(s, "[.]"), lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x"))))["x"]
    return F.when(best != "", best)


def text_key(std: Column) -> Column:
    """Key of a canonical text."""
    return F.upper(F.md5(std))
