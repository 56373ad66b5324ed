"""Name a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once.

    A lambda over an array evaluates whatever it mentions again for each element. A
    value that itself looks at the whole array would make that quadratic; bound
    here, the lambda only reads it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
