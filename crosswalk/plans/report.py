"""Verdict, reasons and report tables of runs. Many runs are rolled up at once; every table carries ``run_id``.

Tables: ``runs`` (run_id, provider, consumer, provider_entity, consumer_entity, engine, generated_at, heal_passed,
e2e_passed, e2e_error, requests), ``rounds`` (round, diagnostics, action), ``checks`` (ord, method, consumer_field,
provider_json, expected, actual, ok), ``scans`` (ord, tool, status, findings, detail, items), ``pairs`` (c_ord,
consumer_field, provider_json, confidence, source), ``unmapped`` (ord, name), ``timings`` (ord, phase, seconds)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosswalk.functions.types import round_half_even
from crosswalk.operators.assign import top_n_per_group

SHOWN_DIAGNOSTICS, SHOWN_ITEMS, LOGGED_ITEMS = 3, 5, 20
MIN_SHARE = 0.01


@dataclass
class RunTables:
    runs: DataFrame
    rounds: DataFrame
    checks: DataFrame
    scans: DataFrame
    pairs: DataFrame
    unmapped: DataFrame
    timings: DataFrame | None = None


def run_verdict(runs: DataFrame, scans: DataFrame) -> DataFrame:
    """Passed: repaired, checked end to end, and no scan with findings or an error. Skipped scans and no scans at all
    do not fail a run."""
    bad = scans.groupBy("run_id").agg(F.bool_or(F.col("status").isin("findings", "error")).alias("bad_scan"))
    return runs.join(bad, "run_id", "left").select(
        "run_id", (F.col("heal_passed") & F.col("e2e_passed") & ~F.coalesce("bad_scan", F.lit(False))).alias("passed"))


def shown_value(value: Column) -> Column:
    """A value in a reason: numbers and truth values as they are, text in quotes, a missing one as None."""
    bare = value.rlike(r"^-?\d+(\.\d+)?$") | value.isin("True", "False")
    return F.when(value.isNull(), F.lit("None")).when(bare, value).otherwise(F.concat(F.lit("'"), value, F.lit("'")))


def _joined(rows: DataFrame, order: str, value: str, separator: str) -> DataFrame:
    """Values of a run in order, as one text. As long as an entity has unmapped fields."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return rows.groupBy("run_id").agg(F.array_join(F.transform(listed, lambda x: x["v"]), separator).alias("text"))


def failure_reasons(t: RunTables) -> DataFrame:
    """Why a run failed: ``run_id, rank, ord, reason``. Unmapped fields are listed even where the run passed."""
    last = t.rounds.groupBy("run_id").agg(F.max_by("diagnostics", "round").alias("diagnostics"))
    shown = F.array_join(F.slice(F.coalesce("diagnostics", F.array().cast("array<string>")), 1, SHOWN_DIAGNOSTICS), "; ")
    heal = t.runs.filter(~F.col("heal_passed")).join(last, "run_id", "left").select(
        "run_id", F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias("ord"),
        F.concat(F.lit("Generated code does not compile: "), F.when(shown == "", F.lit("see heal rounds")).otherwise(shown))
        .alias("reason"))
    failed_runs = t.runs.filter(~F.col("e2e_passed"))
    bad = t.checks.filter(~F.col("ok")).join(failed_runs.select("run_id"), "run_id", "left_semi")
    values = bad.select("run_id", F.lit(1).alias("rank"), F.col("ord").cast("bigint").alias("ord"), F.concat(
        F.lit("End-to-end: `"), "consumer_field", F.lit("` expected "), shown_value(F.col("expected")), F.lit(" from `"),
        "provider_json", F.lit("`, got "), shown_value(F.col("actual")), F.lit(" ("), "method", F.lit(")")).alias("reason"))
    unrun = failed_runs.join(bad.select("run_id"), "run_id", "left_anti").select(
        "run_id", F.lit(1).alias("rank"), F.lit(0).cast("bigint").alias("ord"),
        F.concat(F.lit("End-to-end check did not run: "),
                 F.when(F.coalesce("e2e_error", F.lit("")) == "", F.lit("unknown error")).otherwise(F.col("e2e_error")))
        .alias("reason"))
    found = F.concat("tool", F.lit(": "), F.col("findings").cast("string"), F.lit(" finding(s): "),
                     F.array_join(F.slice("items", 1, SHOWN_ITEMS), ", "))
    errored = F.concat("tool", F.lit(" errored, so the code is not proven clean: "), "detail")
    scans = t.scans.filter(F.col("status").isin("findings", "error")).select(
        "run_id", F.lit(2).alias("rank"), F.col("ord").cast("bigint").alias("ord"),
        F.when(F.col("status") == "findings", found).otherwise(errored).alias("reason"))
    missing = _joined(t.unmapped, "ord", "name", ", ").select(
        "run_id", F.lit(3).alias("rank"), F.lit(0).cast("bigint").alias("ord"),
        F.concat(F.lit("Consumer fields with no provider source: "), "text").alias("reason"))
    return reduce(DataFrame.unionByName, [heal, values, unrun, scans, missing])


def logged_items(scans: DataFrame) -> DataFrame:
    """The first findings of each scan, as far as they are logged."""
    return (scans.select("run_id", "tool", F.posexplode(F.slice("items", 1, LOGGED_ITEMS)).alias("ord", "item")))


def first_diagnostics(diagnostics: DataFrame, keys: list[str], n: int = SHOWN_DIAGNOSTICS) -> DataFrame:
    return top_n_per_group(diagnostics, keys, [F.col("ord")], n)


def phase_shares(timings: DataFrame) -> DataFrame:
    """Seconds of each phase, their total per run, and the share shown, at least ``MIN_SHARE``; a total of 0 counts as 1."""
    totals = timings.groupBy("run_id").agg(F.sum("seconds").alias("total"))
    divisor = F.when(F.col("total") == 0, F.lit(1.0)).otherwise(F.col("total"))
    return timings.join(totals, "run_id").select(
        "run_id", "ord", "phase", "seconds", "total", F.greatest(F.col("seconds") / divisor, F.lit(MIN_SHARE)).alias("share"))


def report_tiles(t: RunTables) -> DataFrame:
    """The headline figures of each run as texts."""
    def counted(df: DataFrame, *aggs: Column) -> DataFrame:
        return df.groupBy("run_id").agg(*aggs)

    one = F.count(F.lit(1))
    out = t.runs.select("run_id")
    for part in (
        counted(t.pairs, one.alias("mapped")), counted(t.unmapped, one.alias("unmapped")),
        counted(t.checks, F.count_if("ok").alias("ok"), one.alias("checks")), counted(t.rounds, one.alias("n_rounds")),
        counted(t.scans, F.count_if(F.col("status") == "clean").alias("clean"),
                F.count_if(F.col("status") != "skipped").alias("ran"), one.alias("scans")),
        counted(t.timings, F.sum("seconds").alias("seconds")),
    ):
        out = out.join(part, "run_id", "left")
    out = out.fillna(0)
    total = F.col("mapped") + F.col("unmapped")
    share = F.coalesce(F.try_divide(F.col("mapped").cast("double"), total), F.lit(0.0))
    skipped = F.col("scans") - F.col("ran")
    scan_value = (F.when(F.col("scans") == 0, F.lit("off")).when(F.col("ran") > 0, F.format_string("%d/%d", "clean", "ran"))
                  .otherwise(F.lit("-")))
    scan_text = (F.when(F.col("scans") == 0, F.lit("scanners not run"))
                 .when((F.col("ran") > 0) & (skipped > 0), F.format_string("scanners clean (%d skipped)", skipped))
                 .when(F.col("ran") > 0, F.lit("scanners clean"))
                 .otherwise(F.format_string("scanners: all %d skipped", skipped)))
    percent = (round_half_even(share, 3) * 100)
    return out.select(
        "run_id", F.format_string("%d/%d", F.col("mapped"), total).alias("fields_mapped"),
        F.format_string("%.0f%%", F.bround(percent, 0)).alias("coverage"),
        F.format_string("%d/%d", "ok", "checks").alias("field_checks"), F.col("n_rounds").cast("string").alias("rounds"),
        scan_value.alias("scanners"), scan_text.alias("scanners_text"),
        F.format_string("%.1fs", round_half_even(F.col("seconds"), 1)).alias("total_time"))


def report_markdown_lines(t: RunTables) -> DataFrame:
    """Report of each run as Markdown lines: ``run_id, section, ord, sub, line``, to be written in that order."""
    def lines(df: DataFrame, section: int, order: Column, line: Column, sub: Column | None = None) -> DataFrame:
        return df.select("run_id", F.lit(section).alias("section"), order.cast("bigint").alias("ord"),
                         (F.lit(0) if sub is None else sub).cast("bigint").alias("sub"), line.alias("line"))

    def fixed(df: DataFrame, section: int, texts: list) -> DataFrame:
        """Lines that do not depend on a list; columns or plain texts, in order."""
        columns = [x if isinstance(x, Column) else F.lit(x) for x in texts]
        return (df.select("run_id", F.posexplode(F.array(*columns)).alias("ord", "line"))
                .select("run_id", F.lit(section).alias("section"), F.col("ord").cast("bigint").alias("ord"),
                        F.lit(0).cast("bigint").alias("sub"), "line"))

    runs, r = t.runs.join(run_verdict(t.runs, t.scans), "run_id"), failure_reasons(t)
    having = {"why": r.select("run_id").distinct(), "scans": t.scans.select("run_id").distinct()}
    counts = (runs.join(t.checks.groupBy("run_id").agg(F.count_if("ok").alias("ok_n"), F.count(F.lit(1)).alias("n")),
                        "run_id", "left")
              .join(t.rounds.groupBy("run_id").agg(F.count(F.lit(1)).alias("rounds_n")), "run_id", "left").fillna(0, ["ok_n", "n", "rounds_n"]))
    why, scanned = runs.join(having["why"], "run_id", "left_semi"), runs.join(having["scans"], "run_id", "left_semi")
    items = t.scans.select("run_id", F.col("ord").alias("o"), "tool", F.posexplode("items").alias("i", "item"))
    pass_fail = lambda c: F.when(c, F.lit("pass")).otherwise(F.lit("fail"))
    confidence = F.format_string("%.2f", round_half_even(F.col("confidence"), 2))
    return reduce(DataFrame.unionByName, [
        fixed(runs, 0, [F.concat(F.lit("# Integration report: "), "consumer", F.lit(" -> "), "provider"), "",
                        F.concat(F.lit("**Result:** "), F.when(F.col("passed"), F.lit("PASS")).otherwise(F.lit("FAIL")), F.lit("  ")),
                        F.concat(F.lit("**Mapping engine:** "), "engine", F.lit("  ")),
                        F.concat(F.lit("**Generated:** "), F.coalesce("generated_at", F.lit(""))), ""]),
        fixed(why, 1, ["## Why it failed", ""]),
        lines(r, 2, F.col("rank"), F.concat(F.lit("- "), "reason"), F.col("ord")),
        fixed(why, 3, [""]),
        fixed(runs, 4, [F.concat(F.lit("## Field mapping ("), "provider_entity", F.lit(" -> "), "consumer_entity", F.lit(")")), "",
                        "| Consumer field | Provider field (wire) | Confidence | Source |", "|---|---|---|---|"]),
        lines(t.pairs, 5, F.col("c_ord"), F.concat(F.lit("| `"), "consumer_field", F.lit("` | `"), "provider_json", F.lit("` | "),
                                                   confidence, F.lit(" | "), "source", F.lit(" |"))),
        lines(t.unmapped, 6, F.col("ord"), F.concat(F.lit("| `"), "name", F.lit("` | _unmapped_ | | |"))),
        fixed(counts, 7, ["", "## Validation", "",
                          F.concat(F.lit("- Compile: "), pass_fail(F.col("heal_passed")),
                                   F.format_string(" (%d heal round(s))", "rounds_n"))]),
        lines(t.rounds, 8, F.col("round"), F.format_string("  - round %d: %s (%d diagnostic(s))", "round", "action", F.size("diagnostics"))),
        fixed(counts, 9, [F.concat(F.lit("- End-to-end: "), pass_fail(F.col("e2e_passed")),
                                   F.format_string(", %d/%d field checks, requests: ", "ok_n", "n"), F.array_join("requests", ", "))]),
        fixed(scanned, 10, ["", "## Security (delta-scoped, parallel)", "", "| Scanner | Status | Findings | Detail |",
                            "|---|---|---|---|"]),
        lines(t.scans, 11, F.col("ord"), F.concat(
            F.lit("| "), "tool", F.lit(" | "), "status", F.lit(" | "),
            F.when(F.col("status") != "skipped", F.col("findings").cast("string")).otherwise(F.lit("-")), F.lit(" | "), "detail", F.lit(" |"))),
        fixed(items.select("run_id").distinct(), 12, [""]),
        lines(items, 13, F.col("o"), F.concat(F.lit("- `"), "tool", F.lit("`: "), "item"), F.col("i")),
    ])


def write_markdown(lines: DataFrame, path: str) -> None:
    """One folder per run. Files hold ranges of lines, so a long report is many files whose names are in line order."""
    (lines.repartitionByRange("run_id", "section", "ord", "sub").sortWithinPartitions("run_id", "section", "ord", "sub")
     .select("run_id", "line").write.mode("overwrite").partitionBy("run_id").text(path))
