"""Score arithmetic over the wide layout (one column per label id).

Everything is written out per column (``greatest``, ``case when``, explicit sums) instead of
array lambdas, so it stays inside whole-stage codegen and no value is recomputed per element.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def argmax(cols: Sequence[Column], maximum: Column | None = None) -> Column:
    """Index of the largest value; ties go to the lowest index (NumPy's rule).

    Pass ``maximum`` as a stored column when available: the comparison chain then reads it
    instead of recomputing ``greatest`` in every branch.
    """
    if len(cols) == 1:
        return F.lit(0)
    m = maximum if maximum is not None else F.greatest(*cols)
    expr = F.when(cols[0] == m, F.lit(0))
    for i, c in enumerate(cols[1:], start=1):
        expr = expr.when(c == m, F.lit(i))
    return expr


def pick(cols: Sequence[Column], index: Column) -> Column:
    """Value of column number ``index`` (0-based)."""
    expr = F.when(index == 0, cols[0])
    for i, c in enumerate(cols[1:], start=1):
        expr = expr.when(index == i, c)
    return expr
