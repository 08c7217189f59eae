"""Scanner reports: JSON of five tools flattened to finding labels, and the status of a tool run.

Every step is an expression on the row of the tool run, so classifying runs needs no shuffle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosswalk.functions.values import finding_label, last_line


@dataclass
class Flattener:
    """How one tool's report is read. ``items`` gives the labels; ``nothing`` says that nothing was examined;
    ``broken`` that a needed part is missing. ``list_schema`` is set where the report may be a list of reports."""

    schema: str
    items: Callable[[Column], Column]
    nothing: Callable[[Column], Column]
    broken: Callable[[Column], Column]
    nothing_text: str = ""
    list_schema: str | None = None
    empty_is_clean: bool = False
    no_report_text: str = "scanner produced no JSON output"


def _or_empty(array: Column, element: str) -> Column:
    return F.coalesce(array, F.array().cast(f"array<{element}>"))


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit("None"))


_VULN = "struct<VulnerabilityID:string,PkgName:string,InstalledVersion:string>"
_SECRET, _MISCONFIG = "struct<RuleID:string>", "struct<ID:string,Status:string>"
_OSV_PKG = "struct<package:struct<name:string,version:string>,vulnerabilities:array<struct<id:string>>>"
_SEMGREP_HIT = "struct<check_id:string,path:string,start:struct<line:bigint>>"
_CHECK = "struct<check_id:string,file_path:string>"
_CHECKOV = f"struct<results:struct<failed_checks:array<{_CHECK}>>>"
_LEAK = "struct<RuleID:string,File:string,StartLine:bigint>"
_TRIVY_RESULT = (f"struct<Target:string,Vulnerabilities:array<{_VULN}>,Secrets:array<{_SECRET}>,"
                 f"Misconfigurations:array<{_MISCONFIG}>>")
_OSV_RESULT = f"struct<packages:array<{_OSV_PKG}>>"


def _semgrep_items(r: Column) -> Column:
    return F.transform(_or_empty(r["results"], _SEMGREP_HIT),
                       lambda h: finding_label(h["check_id"], h["path"], h["start"]["line"]))


def _gitleaks_items(r: Column) -> Column:
    return F.transform(r, lambda f: finding_label(f["RuleID"], f["File"], f["StartLine"]))


def _osv_items(r: Column) -> Column:
    def of_package(p: Column) -> Column:
        place = F.concat(_text(p["package"]["name"]), F.lit("@"), _text(p["package"]["version"]))
        return F.transform(_or_empty(p["vulnerabilities"], "struct<id:string>"),
                           lambda v: F.concat(v["id"], F.lit(" "), place))

    packages = F.flatten(F.transform(_or_empty(r["results"], _OSV_RESULT), lambda x: _or_empty(x["packages"], _OSV_PKG)))
    return F.flatten(F.transform(packages, of_package))


def _trivy_items(r: Column) -> Column:
    def of_result(x: Column) -> Column:
        vulns = F.transform(_or_empty(x["Vulnerabilities"], _VULN), lambda v: F.concat(
            v["VulnerabilityID"], F.lit(" "), v["PkgName"], F.lit("@"), v["InstalledVersion"]))
        secrets = F.transform(_or_empty(x["Secrets"], _SECRET), lambda v: F.concat(v["RuleID"], F.lit(" "), x["Target"]))
        failed = F.filter(_or_empty(x["Misconfigurations"], _MISCONFIG), lambda v: v["Status"] == "FAIL")
        misconfigs = F.transform(failed, lambda v: F.concat(v["ID"], F.lit(" "), x["Target"]))
        return F.concat(vulns, secrets, misconfigs)

    return F.flatten(F.transform(_or_empty(r["Results"], _TRIVY_RESULT), of_result))


def _checkov_items(r: Column) -> Column:
    reports = F.filter(r, lambda x: x["results"].isNotNull())
    failed = F.flatten(F.transform(reports, lambda x: _or_empty(x["results"]["failed_checks"], _CHECK)))
    return F.transform(failed, lambda c: F.concat(c["check_id"], F.lit(" "), F.coalesce(c["file_path"], F.lit(""))))


def _never(_: Column) -> Column:
    return F.lit(False)


def _no_label(items: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A label that could not be built lacks a needed part."""
    return lambda r: F.exists(items(r), lambda i: i.isNull())


FLATTENERS: dict[str, Flattener] = {
    "semgrep": Flattener(
        f"struct<paths:struct<scanned:array<string>>,results:array<{_SEMGREP_HIT}>>", _semgrep_items,
        lambda r: F.size(_or_empty(r["paths"]["scanned"], "string")) == 0, _no_label(_semgrep_items), "no files scanned"),
    "gitleaks": Flattener(f"array<{_LEAK}>", _gitleaks_items, _never, _no_label(_gitleaks_items), empty_is_clean=True,
                          no_report_text="gitleaks wrote no report"),
    "osv-scanner": Flattener(f"struct<results:array<{_OSV_RESULT}>>", _osv_items, _never, _no_label(_osv_items)),
    "trivy": Flattener(f"struct<Results:array<{_TRIVY_RESULT}>>", _trivy_items,
                       lambda r: F.size(_or_empty(r["Results"], _TRIVY_RESULT)) == 0, _no_label(_trivy_items),
                       "no scannable targets"),
    "checkov": Flattener(f"array<{_CHECKOV}>", _checkov_items,
                         lambda r: ~F.exists(r, lambda x: x["results"].isNotNull()), _no_label(_checkov_items),
                         "no IaC resources in scope", list_schema=_CHECKOV),
}


def register_flattener(tool: str, flattener: Flattener) -> None:
    FLATTENERS[tool] = flattener


def parse_report(tool: str, text: Column) -> Column:
    """The report of a tool as ``struct(state, detail, items)``; state is ok, nothing or broken."""
    f = FLATTENERS[tool]
    body = F.regexp_replace(text, r"^\s+|\s+$", "")
    if f.empty_is_clean:
        body = F.when(body == "", F.lit("[]")).otherwise(body)
    wrapped = body if f.list_schema is None else F.when(body.startswith("["), body).otherwise(
        F.concat(F.lit("["), body, F.lit("]")))
    none = F.array().cast("array<string>")

    def judge(v: Column) -> Column:
        def result(state: str, detail: Column, items: Column = none) -> Column:
            return F.struct(F.lit(state).alias("state"), detail.alias("detail"), items.alias("items"))

        missing = v["body"].isNull() | (v["body"] == "")
        unread = v["json"].isNull() | v["report"].isNull()
        return (F.when(missing, result("broken", F.lit(f.no_report_text)))
                .when(unread, result("broken", F.lit("invalid JSON")))
                .when(f.nothing(v["report"]), result("nothing", F.lit(f.nothing_text)))
                .when(f.broken(v["report"]), result("broken", F.lit("missing key")))
                .otherwise(result("ok", F.lit(""), f.items(v["report"]))))

    parsed = F.struct(body.alias("body"), F.try_parse_json(wrapped).alias("json"),
                      F.from_json(wrapped, f.schema).alias("report"))
    return F.transform(F.array(parsed), judge)[0]


def flatten_report(runs: DataFrame, tool: str, keys: list[str]) -> DataFrame:
    """Finding labels of one tool's runs, one row each: the key columns, ``ord`` and ``item``."""
    report = parse_report(tool, F.col("stdout"))
    return (runs.filter(F.col("tool") == tool).select(*keys, report["items"].alias("_items"))
            .select(*keys, F.posexplode("_items").alias("ord", "item")))


def classify_scan(runs: DataFrame, keys: list[str], timeout: int = 600) -> DataFrame:
    """Status of every tool run. Not installed and nothing examined are ``skipped``; a missing exit code means the
    time ran out; exit codes other than 0 and 1, and output that cannot be read, or of a tool without reader, are ``error``; never an implicit
    clean result."""
    parsed = F.coalesce(*[F.when(F.col("tool") == tool, parse_report(tool, F.col("stdout"))) for tool in FLATTENERS])
    staged = runs.withColumn("_r", parsed).withColumn("_err", last_line(F.col("stderr")))
    none = F.array().cast("array<string>")
    ran = F.col("installed") & F.col("returncode").isin(0, 1)
    state = F.col("_r.state")
    status = (F.when(~F.col("installed"), F.lit("skipped")).when(~F.coalesce(ran, F.lit(False)), F.lit("error"))
              .when(state == "nothing", F.lit("skipped")).when(state.isNull() | (state == "broken"), F.lit("error"))
              .when(F.size("_r.items") > 0, F.lit("findings")).otherwise(F.lit("clean")))
    detail = (F.when(~F.col("installed"), F.lit("not installed"))
              .when(F.col("returncode").isNull(), F.lit(f"timed out after {timeout}s"))
              .when(~F.col("returncode").isin(0, 1), F.format_string("exit %d: %s", "returncode", "_err"))
              .when(state.isNull(), F.lit("unknown tool"))
              .when(state == "nothing", F.col("_r.detail"))
              .when(state == "broken", F.format_string("unreadable output (%s): %s", "_r.detail", "_err"))
              .otherwise(F.lit("")))
    items = F.when(status.isin("findings"), F.col("_r.items")).otherwise(none)
    return (staged.withColumn("status", status).withColumn("detail", detail).withColumn("items", items)
            .select(*keys, "tool", "status", F.size("items").cast("bigint").alias("findings"), "detail", "items"))


