"""A value that an expression needs several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once a row, however often it is named, also where Spark would repeat it in each place and make one method of all, too long to be compiled."""
    return F.transform(F.array(value), use)[0]
