"""Positions and running sums along an order, without one task per key.

The rows of a key are cut into pieces that follow the order; each piece is sorted in a task of
its own, and the sums of the pieces before it are added from a table of one row per piece. So a
key that holds a third of all rows is sorted by many tasks. Pieces are pure functions of the
row: a recomputed task gives what the lost one gave.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Pieces per doubling of a score's size: a piece holds scores within 0.07 % of each other.
PER_OCTAVE = 1024
_FAR = 4_000_000


def score_piece(score: Column | str) -> Column:
    """A number that never falls as the score rises: its logarithm in fixed steps, with its sign.

    Null comes first and NaN last, as in Spark's order. Equal scores share a piece.
    """
    x = (F.col(score) if isinstance(score, str) else score).cast("double")
    size = F.floor(F.log2(F.abs(x)) * PER_OCTAVE).cast("long") + 2 * PER_OCTAVE * PER_OCTAVE
    infinite = F.abs(x) == float("inf")
    return (
        F.when(x.isNull(), -_FAR - 1)
        .when(F.isnan(x), _FAR + 1)
        .when(infinite, F.signum(x).cast("long") * _FAR)
        .when(x == 0, 0)
        .otherwise(F.signum(x).cast("long") * size)
    )


def hash_piece(hexadecimal: Column) -> Column:
    """4,096 even pieces of an order by a hash in hexadecimal."""
    return F.conv(F.substring(hexadecimal, 1, 3), 16, 10).cast("long")


def spread(df: DataFrame, keys: Sequence[str], piece: Column, order: Sequence, sums: dict[str, Column] | None = None, ties: str | None = None) -> DataFrame:
    """``df`` with ``__to_<name>`` and ``__all_<name>``: each sum up to and with the row, and over its key.

    The sum ``n`` counts rows, so ``__to_n`` is the row's position from 1. ``ties``, the first
    column of ``order``, adds ``__mean``: positions from 1 where equal values share their mean.
    ``piece`` must not fall along ``order``. ``__k`` (the keys) stays. Null keys are keys.
    Rows are shuffled once, by key and piece; the sums of pieces combine on the map side.
    """
    sums = {"n": F.lit(1).cast("long"), **(sums or {})}
    key = F.struct(*keys) if keys else F.struct(F.lit(0))
    rows = df.withColumns({"__k": key, "__p": F.coalesce(piece, F.lit(0).cast("long"))})
    per = rows.groupBy("__k", "__p").agg(*[F.sum(c).alias(f"__s_{s}") for s, c in sums.items()])
    whole = Window.partitionBy("__k")
    earlier = whole.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        "__k",
        "__p",
        *[F.coalesce(F.sum(f"__s_{s}").over(earlier), F.lit(0)).alias(f"__before_{s}") for s in sums],
        *[F.sum(f"__s_{s}").over(whole).alias(f"__all_{s}") for s in sums],
    )
    inside = Window.partitionBy("__k", "__p")
    along = inside.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = {f"__to_{s}": F.sum(c).over(along) for s, c in sums.items()}  # of columns that the rows have: nothing is sent twice
    if ties:
        by = inside.orderBy(ties)
        local["__mean"] = (F.rank().over(by) + F.count(F.lit(1)).over(by.rangeBetween(Window.unboundedPreceding, Window.currentRow))) / 2
    out = rows.withColumns(local).join(per, ["__k", "__p"])
    whole_sums = {name: F.col(name) + F.col(f"__before_{name.removeprefix('__to_') if name != '__mean' else 'n'}") for name in local}
    return out.withColumns(whole_sums).drop("__p", *[f"__before_{s}" for s in sums])
