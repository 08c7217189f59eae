"""Joins and keys that keep working when one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_PER_SALT = 1_000_000


def unbounded(df: DataFrame) -> DataFrame:
    """``df`` as one side of a join that is never broadcast. The planner takes a table for as large as its files or what it came from,
    and neither tells how many rows an explode makes or how well rows were packed, so a table of any size may look small enough to
    be collected by the driver. Tables that grow with the input are joined by sorting both sides."""
    return df.hint("merge")


def key_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per key, merged before the shuffle."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))


def _parts(counts: DataFrame, keys: list[str], rows_per_salt: int, name: str) -> DataFrame:
    return (counts.filter(F.col("_rows") > rows_per_salt)
            .select(*keys, F.ceil(F.col("_rows") / F.lit(rows_per_salt)).cast("int").alias(name)))


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], left_spread: list[str], right_spread: list[str],
                rows_per_salt: int = ROWS_PER_SALT, left_counts: DataFrame | None = None,
                right_counts: DataFrame | None = None, split_right: bool = True) -> DataFrame:
    """Inner equi-join that splits every key with more than ``rows_per_salt`` rows on either side.

    The left rows of a hot key go to ``ceil(left rows / rows_per_salt)`` parts by a hash of ``left_spread``, the right
    rows likewise, and each part of one side is copied to the parts of the other, so every pair meets exactly once
    and no task gets more than ``rows_per_salt`` rows of a key from one side. The hashes are of row content, so a task
    that runs again does the same. Keys below the limit join as usual. The list of hot keys has at most
    ``(left rows + right rows) / rows_per_salt`` entries; whether it is broadcast is left to its size. Counts already at
    hand (the keys and ``_rows``) can be passed in. Without ``split_right`` only the left side is counted and split, for a
    right side that is known to have few rows per key."""
    by_left = _parts(key_counts(left, keys) if left_counts is None else left_counts, keys, rows_per_salt, "_l_parts")
    if split_right:
        by_right = _parts(key_counts(right, keys) if right_counts is None else right_counts, keys, rows_per_salt, "_r_parts")
        hot = by_left.join(by_right, keys, "full_outer")
    else:
        hot = by_left.withColumn("_r_parts", F.lit(1))
    l_parts, r_parts = F.coalesce("_l_parts", F.lit(1)), F.coalesce("_r_parts", F.lit(1))

    def salted(df: DataFrame, own: str, own_parts: Column, spread: list[str], other: str, other_parts: Column) -> DataFrame:
        return (df.join(hot, keys, "left")
                .withColumn(own, F.pmod(F.xxhash64(*spread), own_parts).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), other_parts - 1))).drop("_l_parts", "_r_parts"))

    return (salted(left, "_l_salt", l_parts, left_spread, "_r_salt", r_parts)
            .join(salted(right, "_r_salt", r_parts, right_spread, "_l_salt", l_parts), [*keys, "_l_salt", "_r_salt"])
            .drop("_l_salt", "_r_salt"))


def spread_missing(key: Column, *spread_by: Column) -> Column:
    """A join key where rows without a key get one of many values that match nothing, so that they do not all
    go to the same task of an outer join."""
    return F.coalesce(key, F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(*spread_by), F.lit(4096)).cast("string")))
