"""Small helpers for building expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it by name in ``body``. A plain column used
    inside the lambda of an array function may be inlined there by the optimizer and then
    run once per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
