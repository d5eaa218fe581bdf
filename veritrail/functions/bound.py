"""Values that an expression names more than once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: inside lambdas Spark computes an expression wherever it stands."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
