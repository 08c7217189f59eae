"""Places of rows in one order over a whole table, without one task for all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosswalk.session import written

_BITS = 33


def with_places(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``df`` and the place of each row in ``order``, from 0 without gaps; rows that are equal there stand in any order.

    Rows are dealt out by ranges and sorted within them; the place in a range is added to the number of rows in the ranges
    before. So no key is sorted by one task, and one number per range reaches the driver. What is returned is written to the
    checkpoint folder first, so places stay as they are when a task runs again."""
    local = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()), "places")
    part = F.shiftright(F.col(name), _BITS)
    before, total = [], 0
    for row in sorted(local.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()):
        before += [F.lit(row.part), F.lit(total)]
        total += row.n
    if not before:
        return local
    return local.withColumn(name, F.element_at(F.create_map(*before), part) + F.col(name).bitwiseAND((1 << _BITS) - 1))
