"""Comparing mapped records with their source, and checking and repairing rows by rules."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosswalk.functions.values import same_value

SAFE_FIX, NO_FALLBACK, FALLBACK = ("safe fixes resolved all diagnostics", "no fallback configured; cannot repair further",
                                   "fallback repair")


@dataclass
class FieldCheck:
    """One pair to check: the consumer column, the provider's wire column, the canonical type of the provider value."""

    consumer_field: str
    provider_json: str
    ctype: str


def _reconciled(provider: DataFrame, consumer: DataFrame, key: str, checks: Sequence[FieldCheck]) -> DataFrame:
    """One row per provider record with the text of both sides of every pair. The join is on the record key, which is
    unique, so no key is hot; both sides carry only the compared columns."""
    expected = provider.select(key, *[F.col(f"`{c}`").cast("string").alias(f"_e{i}")
                                      for i, c in enumerate(dict.fromkeys(x.provider_json for x in checks))])
    actual = consumer.select(key, *[F.col(f"`{c.consumer_field}`").cast("string").alias(f"_a{i}")
                                    for i, c in enumerate(checks)])
    return expected.join(actual, key, "left")


def _sides(checks: Sequence[FieldCheck]) -> list[tuple[FieldCheck, Column, Column]]:
    wires = {c: i for i, c in enumerate(dict.fromkeys(x.provider_json for x in checks))}
    return [(c, F.col(f"_e{wires[c.provider_json]}"), F.col(f"_a{i}")) for i, c in enumerate(checks)]


def field_checks(provider: DataFrame, consumer: DataFrame, key: str, checks: Sequence[FieldCheck],
                 methods: Sequence[str] = ("",)) -> DataFrame:
    """Every mapped value of every record against its source, once per method: expected, actual and ok."""
    rows = [F.struct(F.lit(m).alias("method"), F.lit(c.consumer_field).alias("consumer_field"),
                     F.lit(c.provider_json).alias("provider_json"), e.alias("expected"), a.alias("actual"),
                     same_value(e, a, c.ctype).alias("ok"))
            for m in methods for c, e, a in _sides(checks)]
    return (_reconciled(provider, consumer, key, checks)
            .select(key, F.explode_outer(F.array(*rows)).alias("_c")).select(key, "_c.*"))  # never empty; the inner form computes it twice


def field_check_summary(provider: DataFrame, consumer: DataFrame, key: str, checks: Sequence[FieldCheck]) -> DataFrame:
    """Rows checked and rows ok per field. Counted side by side in one pass, so nothing is multiplied by the number of
    fields before the aggregation."""
    counts = [F.count_if(same_value(e, a, c.ctype)).alias(f"_n{i}") for i, (c, e, a) in enumerate(_sides(checks))]
    totals = _reconciled(provider, consumer, key, checks).agg(F.count(F.lit(1)).alias("_rows"), *counts)
    per_field = [F.struct(F.lit(c.consumer_field).alias("consumer_field"), F.lit(c.provider_json).alias("provider_json"),
                          F.col("_rows").alias("rows_checked"), F.col(f"_n{i}").alias("rows_ok"))
                 for i, c in enumerate(checks)]
    return totals.select(F.explode(F.array(*per_field)).alias("_s")).select("_s.*")


def check_rollup(checks: DataFrame, groups: list[str]) -> DataFrame:
    """Checks ok and total per group; passed only when there is a check and all are ok."""
    return checks.groupBy(*groups).agg(
        F.count_if("ok").alias("ok_checks"), F.count(F.lit(1)).alias("total_checks"),
        F.count_if(~F.col("ok")).alias("failed_checks"), F.coalesce(F.bool_and("ok"), F.lit(False)).alias("passed"))


RowColumn = Callable[[Mapping[str, Column]], Column]


@dataclass
class Rule:
    """A defect of a row: ``bad`` says whether it is there. Both functions get the row, ``r["column"]``. Rules of
    level 2 are looked at only in rows that are clean on level 1."""

    code: str
    level: int
    bad: RowColumn
    message: RowColumn


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value`` with the value computed and named once."""
    return F.transform(F.array(value), body)[0]


def diagnostics(rules: Sequence[Rule], row: Mapping[str, Column]) -> Column:
    """Diagnostics of a row as ``array<string>``, of the lowest level that has any."""
    def found(level: int) -> Column:
        hits = [F.when(F.coalesce(r.bad(row), F.lit(False)), F.concat(F.lit(f"{r.code} "), r.message(row)))
                for r in rules if r.level == level]
        return F.array_compact(F.array(*hits))

    def first_found(levels: list[int]) -> Column:
        head, *rest = levels
        if not rest:
            return found(head)
        return _let(found(head), lambda d: F.when(F.size(d) > 0, d).otherwise(first_found(rest)))

    return first_found(sorted({r.level for r in rules}))


def check_rows(df: DataFrame, rules: Sequence[Rule], keys: list[str]) -> DataFrame:
    """One row per defect: key columns, ``ord`` and ``diagnostic``."""
    row = {c: F.col(c) for c in df.columns}
    return df.select(*keys, diagnostics(rules, row).alias("_d")).select(*keys, F.posexplode_outer("_d").alias("ord", "diagnostic")).filter(F.col("ord").isNotNull())


def repair_rounds(df: DataFrame, rules: Sequence[Rule], fixes: dict[str, RowColumn],
                  fallback: dict[str, RowColumn] | None = None, columns: Sequence[str] | None = None,
                  max_rounds: int = 3) -> DataFrame:
    """Check, fix, check again, per row and for at most ``max_rounds`` rounds.

    Adds ``rounds`` (round, diagnostics, action) and ``passed``. A clean first check records no round. When the safe
    fixes leave something, the fallback gets the row, or without one the row stops there and is not passed. All rounds
    of a row are one expression: a row is repaired where it is, with no shuffle and no job per round. ``columns``
    are those the rules and fixes look at (default: all)."""
    columns = list(columns or df.columns)

    def state(row: Column, rounds: Column, is_open: Column, passed: Column) -> Column:
        return F.struct(row.alias("row"), rounds.alias("rounds"), is_open.alias("open"), passed.alias("passed"))

    def changed(row: Column, by: dict[str, RowColumn]) -> Column:
        return F.struct(*[(by[c](row) if c in by else row[c]).alias(c) for c in columns])

    def one_round(s: Column, n: Column) -> Column:
        def after_check(diags: Column) -> Column:
            def after_fix(f: Column) -> Column:
                solved = F.size(f["left"]) == 0
                action = F.when(solved, F.lit(SAFE_FIX)).otherwise(F.lit(NO_FALLBACK if fallback is None else FALLBACK))
                entry = F.struct(n.alias("round"), F.when(solved, diags).otherwise(f["left"]).alias("diagnostics"),
                                 action.alias("action"))
                row = f["row"] if fallback is None else F.when(solved, f["row"]).otherwise(changed(f["row"], fallback))
                goes_on = solved if fallback is None else F.lit(True)
                return state(row, F.array_append(s["rounds"], entry), goes_on, F.lit(False))

            fixed = _let(changed(s["row"], fixes), lambda r: F.struct(r.alias("row"), diagnostics(rules, r).alias("left")))
            return (F.when(F.size(diags) == 0, state(s["row"], s["rounds"], F.lit(False), F.lit(True)))
                    .otherwise(_let(fixed, after_fix)))

        return F.when(s["open"], _let(diagnostics(rules, s["row"]), after_check)).otherwise(s)

    no_rounds = F.array().cast("array<struct<round:int,diagnostics:array<string>,action:string>>")
    start = state(F.struct(*columns), no_rounds, F.lit(True), F.lit(False))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(max_rounds)), start, one_round, lambda s: F.struct(
        s["row"].alias("row"), s["rounds"].alias("rounds"),
        F.when(s["open"], F.size(diagnostics(rules, s["row"])) == 0).otherwise(s["passed"]).alias("passed")))
    done = df.withColumn("_end", end)
    return done.select(*[F.col(f"_end.row.{c}").alias(c) if c in fixes or (fallback and c in fallback) else F.col(c)
                         for c in df.columns], "_end.rounds", "_end.passed")


def repair_log(repaired: DataFrame, keys: list[str]) -> DataFrame:
    return repaired.select(*keys, F.explode_outer("rounds").alias("_r")).filter(F.col("_r").isNotNull()).select(*keys, "_r.round", "_r.diagnostics", "_r.action")


def repair_summary(repaired: DataFrame) -> DataFrame:
    """What the rounds did over the whole table: rows and diagnostics per round and action."""
    return (repaired.select(F.explode_outer("rounds").alias("_r")).filter(F.col("_r").isNotNull())
            .groupBy(F.col("_r.round").alias("round"), F.col("_r.action").alias("action"))
            .agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("_r.diagnostics")).alias("diagnostics")))


def quarantine(repaired: DataFrame) -> DataFrame:
    """Rows that are still not clean."""
    return repaired.filter(~F.col("passed"))
