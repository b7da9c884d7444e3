from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c) -> Column:
    """Column name or Column -> Column."""
    return c if isinstance(c, Column) else F.col(c)


def lit_or_col(v) -> Column:
    """Python value -> literal; Column stays a Column."""
    return v if isinstance(v, Column) else F.lit(v)
