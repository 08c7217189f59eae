"""Order-dependent choices as aggregations: one-to-one assignment, first of duplicates, top n per group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from crosswalk.operators.skew import unbounded
from crosswalk.session import cut_lineage, written

#: Candidates of a scope that are walked in one array.
FOLDED = 1024


def assign_one_to_one(candidates: DataFrame, scope: list[str], left: str, right: str, order: list[Column],
                      folded: int = FOLDED, stored: bool = False, most: int | None = None) -> DataFrame:
    """Walk the candidates of each scope in the given order and keep those whose two ends are both still free.

    ``order`` has to be a total order within a scope. Scopes of at most ``folded`` candidates are sorted in one array and walked in
    one expression; larger ones go in rounds over all rows (``_in_rounds``), so no array grows with its scope. Both keep the same.
    The candidates are read by the count and by the walk, so they are computed once up front, unless they are ``stored`` already.
    Where no scope is known to have more than ``most``, and that is at most ``folded``, they are walked as they come."""
    rows = candidates.withColumn("_rank", F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)]))
    if scope and most is not None and most <= folded:
        return _folded(rows, scope, left, right, candidates.columns)
    rows = rows if stored else written(rows, "candidates")
    large = rows.groupBy(*scope).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > folded).drop("_n")
    if large.isEmpty():
        return _folded(rows, scope, left, right, candidates.columns)
    if not scope:
        return _in_rounds(rows, scope, left, right, candidates.columns)
    small = _folded(rows.join(large, scope, "left_anti"), scope, left, right, candidates.columns)
    return small.unionByName(_in_rounds(rows.join(large, scope, "left_semi"), scope, left, right, candidates.columns))


def _folded(rows: DataFrame, scope: list[str], left: str, right: str, columns: list[str]) -> DataFrame:
    """The rows kept of each scope, sorted in one array."""
    rest = [c for c in columns if c not in scope]
    walked = rows.groupBy(*scope).agg(F.array_sort(F.collect_list(F.struct("_rank", *rest))).alias("_all"))
    kept = _kept(F.col("_all"), walked.schema["_all"].dataType, left, right)
    return walked.select(*scope, F.explode_outer(kept).alias("_k")).filter(F.col("_k").isNotNull()).select(
        *[c if c in scope else F.col(f"_k.{c}").alias(c) for c in columns])


def _kept(rows: Column, kind: DataType, left: str, right: str) -> Column:
    """The walk itself: the array of what is kept so far grows by each candidate that shares no end with it."""
    def step(kept: Column, one: Column) -> Column:
        met = F.exists(kept, lambda k: k[left].eqNullSafe(one[left]) | k[right].eqNullSafe(one[right]))
        return F.when(met, kept).otherwise(F.concat(kept, F.array(one)))
    return F.aggregate(rows, F.array().cast(kind), step)


def ends_taken(rows: DataFrame, scope: list[str], left: str, right: str, order: str, usable: str, names: tuple[str, str],
               folded: int = FOLDED, most: int | None = None) -> DataFrame:
    """``rows`` with, under the two ``names``, the ``order`` of the row to which ``assign_one_to_one`` over the ``usable`` rows gives
    its left and its right end, null for an end that is free.

    Where no scope has more than ``most`` rows, and that is at most ``folded``, all rows of a scope are in the array that is walked,
    so they are shuffled once. Else the rows are written, and what the assignment keeps is joined to them."""
    if not scope or most is None or most > folded:
        rows = written(rows, "known")  # read by the assignment and by both joins
        taken = assign_one_to_one(rows.filter(usable).select(*scope, order, left, right), scope, left, right, [F.col(order)],
                                  folded, stored=True)
        for end, name in zip((left, right), names):
            rows = rows.join(unbounded(taken.select(*scope, end, F.col(order).alias(name))), [*scope, end], "left")
        return rows
    first = [order, left, right]
    item = F.struct(*first, *[c for c in rows.columns if c not in scope and c not in first])
    walked = rows.groupBy(*scope).agg(F.array_sort(F.collect_list(item)).alias("_all"))
    ends = F.transform(F.filter("_all", lambda x: x[usable]), lambda x: F.struct(*[x[c].alias(c) for c in first]))
    kind = walked.select(ends.alias("_e")).schema["_e"].dataType
    # the walk is a column below the explode, so it is done once for a scope
    each = (walked.withColumn("_kept", _kept(ends, kind, left, right)).select(*scope, "_kept", F.explode_outer("_all").alias("_x"))
            .filter(F.col("_x").isNotNull()))
    holder = [F.get(F.filter("_kept", lambda k: k[end] == F.col(f"_x.{end}")), F.lit(0))[order].alias(name)
              for end, name in zip((left, right), names)]
    return each.select(*[c if c in scope else F.col(f"_x.{c}").alias(c) for c in rows.columns], *holder)


def _in_rounds(open_rows: DataFrame, scope: list[str], left: str, right: str, columns: list[str]) -> DataFrame:
    """A candidate that comes first for both of its ends is taken by the walk whatever else there is, so each round takes all of
    these at once and drops the candidates that lost an end. What is best for an end is an aggregation with map-side merging, so
    a popular end is no hot spot. Rounds end when no candidate is open: usually after three to five, at worst after as many
    as one scope has pairs."""
    taken = []
    while True:
        ends = F.struct("_rank", F.col(left).alias("l"), F.col(right).alias("r"))  # the rank decides, it is unique
        best_left = open_rows.groupBy(*scope, left).agg(F.min(ends).alias("_bl"))
        best_right = open_rows.groupBy(*scope, right).agg(F.min(ends).alias("_br"))
        winners = (best_left.select(*scope, left, F.col("_bl.r").alias(right))
                   .join(best_right.select(*scope, F.col("_br.l").alias(left), right), [*scope, left, right]))
        by_left = winners.select(*scope, left, F.col(right).alias("_partner_r"))
        by_right = winners.select(*scope, right, F.col(left).alias("_partner_l"))
        state = (open_rows.join(by_left, [*scope, left], "left").join(by_right, [*scope, right], "left")
                 .withColumn("_won", F.col("_partner_r").eqNullSafe(F.col(right))
                             & F.col("_partner_l").eqNullSafe(F.col(left)))
                 .filter(F.col("_won") | (F.col("_partner_r").isNull() & F.col("_partner_l").isNull())))
        state = cut_lineage(state.select(*columns, "_rank", "_won"))
        taken.append(state.filter("_won").select(*columns))
        open_rows = state.filter("NOT _won").drop("_won")
        if open_rows.isEmpty():
            return reduce(DataFrame.unionByName, taken)


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in input order. Merged before the shuffle, so duplicates never travel."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = F.min(F.struct(*order, F.struct(*rest).alias("_rest")) if rest else F.struct(*order))
    picked = df.groupBy(*keys).agg(best.alias("_b"))
    columns = [c if c in keys else F.col(f"_b.{c}") if c in order else F.col(f"_b._rest.{c}") for c in df.columns]
    return picked.select(*columns)


def top_n_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group. The rank limit is applied before the shuffle as well as after it."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= n)


def best_per_group(df: DataFrame, keys: list[str], size: str, order: str) -> DataFrame:
    """Largest row of each group, the first one on ties; rows of size zero do not take part."""
    rest = [c for c in df.columns if c not in keys]
    picked = (df.filter(F.col(size) > 0).groupBy(*keys)
              .agg(F.max_by(F.struct(*rest), F.struct(F.col(size), -F.col(order))).alias("_b")))
    return picked.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])
