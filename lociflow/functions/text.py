"""String helpers of file formats, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens that stand for a missing value in any of the formats.
MISSING = ("", ".", "-9", "NA", "NAN", "NULL")


def tokens(line: str | Column) -> Column:
    """Fields of a line with any white space between them."""
    return F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")


def number(c: Column) -> Column:
    """A double, or null for missing tokens and what isn't a number."""
    t = F.upper(F.trim(c))
    v = c.try_cast("double")
    return F.when(~t.isin(*MISSING) & ~F.isnan(v), v)


def complement(base: Column) -> Column:
    """A with T, C with G; anything else 0."""
    return F.when(base.isin("A", "C", "G", "T"), F.translate(base, "ACGT", "TGCA")).otherwise("0")


def first_token(c: Column, separators: str = r"[\s,;]+") -> Column:
    return F.element_at(F.split(F.trim(c), separators), 1)


def last_token(c: Column, separators: str = r"[\s,;]+") -> Column:
    return F.element_at(F.split(F.trim(c), separators), -1)


def quoted(c: Column) -> Column:
    """What stands between the first pair of double quotes."""
    return F.regexp_extract(c, '"([^"]*)"', 1)


def chromosome(c: Column, autosomes: int = 22) -> Column:
    """Chromosome codes: X, Y, XY and MT follow the autosomes; others by number, null if neither."""
    u = F.upper(c)
    named = {"X": 1, "Y": 2, "XY": 3, "MT": 4, "M": 4}
    out = u.try_cast("int")
    for name, k in named.items():
        out = F.when(u == name, autosomes + k).otherwise(out)
    return out
