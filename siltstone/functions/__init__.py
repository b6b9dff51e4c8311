"""Column functions: text, predicates, scores, keys, dates and maps."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(x) -> Column:
    """A column, or the column of that name."""
    return x if isinstance(x, Column) else F.col(x)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once however often it is named."""
    return F.transform(F.array(value), use)[0]
