"""Values that an expression uses more than once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it.

    Catalyst computes a repeated expression again in each branch of a condition; a lambda's
    variable is a value.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
