"""Bind a column value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to ``value``, which is computed once however often ``body`` reads it.

    The optimizer may inline a column into each place that reads it, even into a lambda that runs
    per array element.  A lambda variable stays bound.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
