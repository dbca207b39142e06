"""Units of time and exact multiples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scaled(c: Column, by: float) -> Column:
    """In a unit that is ``by`` times as large."""
    return c / F.lit(float(by))


def femtoseconds_to_picoseconds(c: Column) -> Column:
    return scaled(c, 1000)


def picoseconds_to_nanoseconds(c: Column) -> Column:
    return scaled(c, 1000)


def is_multiple(c: Column, of: int) -> Column:
    """Whether a whole number is a multiple; null stays null."""
    return F.pmod(c, F.lit(of)) == 0


def steps_of(total: Column, step: Column, tolerance: float = 1e-9) -> Column:
    """How many steps make up a total; a total that is no whole number of them fails the task."""
    n = F.round(total / step)
    whole = F.abs(total - n * step) <= tolerance * F.greatest(F.abs(total), F.lit(1.0))
    return F.when(whole & (step > 0), n.cast("long")).otherwise(F.raise_error(F.lit("not a whole number of steps")).cast("long"))
