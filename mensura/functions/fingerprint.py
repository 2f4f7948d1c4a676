"""Bit sets: positions out of arrays or text, compact codes, similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

N_BITS = 2048
#: Added to a position so that it is an ordinary character when the code is read as UTF-16.
SHIFT = 256


def listed(bits: Column | str = "bits", text: Column | str | None = "bits_text") -> Column:
    """Positions as they are stated, null and impossible ones too; where the array is null, the numbers in the text."""
    bits = F.col(bits) if isinstance(bits, str) else bits
    if text is not None:
        found = F.transform(F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit("(\\d+)"), 1), lambda x: x.try_cast("int"))
        bits = F.coalesce(bits.cast("array<int>"), found)
    return bits


def positions(bits: Column | str = "bits", text: Column | str | None = "bits_text", n_bits: int = N_BITS) -> Column:
    """Sorted distinct positions in [0, n_bits); where the array is null, the numbers in the text. Empty if there is none."""
    bits = listed(bits, text)
    ok = F.filter(bits, lambda x: x.isNotNull() & (x >= 0) & (x < n_bits))
    return F.coalesce(F.sort_array(F.array_distinct(ok)), F.array().cast("array<int>"))


def code(pos: Column | str) -> Column:
    """Positions as big-endian 16-bit numbers (position + SHIFT), which is also UTF-16 text of one character a position."""
    pos = F.col(pos) if isinstance(pos, str) else pos
    return F.unhex(F.array_join(F.transform(pos, lambda b: F.lpad(F.hex((b + SHIFT).cast("long")), 4, "0")), ""))


def code_text(c: Column | str) -> Column:
    """The text of one character a position that ``code`` holds."""
    return F.decode(F.col(c) if isinstance(c, str) else c, "UTF-16BE")


def tanimoto(shared: Column, a: Column, b: Column) -> Column:
    """Shared / either, 0 where the union is empty."""
    return F.coalesce(F.try_divide(shared.cast("double"), (a + b - shared).cast("double")), F.lit(0.0))
