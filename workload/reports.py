"""Scanner reports and run reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosswalk.plans import report
from crosswalk.sources import scan_reports
from workload.base import query, table

# One tool run per event. The key decides the kind of output: 0 empty, 1 nothing examined, 2 no JSON, 3 clean, 4 and 5 findings.
_KIND = "event_id % 6"
_OUT = {
    "semgrep": ("'{\"paths\": {\"scanned\": []}}'", "'{\"paths\": {\"scanned\": [\"a.py\"]}, \"results\": []}'",
                "format_string('{\"paths\": {\"scanned\": [\"a.py\"]}, \"results\": [{\"check_id\": \"rule.%s\", \"path\": \"/x/f%d.py\", \"start\": {\"line\": %d}}, "
                "{\"check_id\": \"b\", \"path\": \"c.py\", \"start\": {\"line\": 7}}]}', event_type, user_id, event_id)",
                ["'rule.' || event_type || ' f' || user_id || '.py:' || event_id", "'b c.py:7'"]),
    "gitleaks": ("NULL", "'[]'",
                 "format_string('[{\"RuleID\": \"%s\", \"File\": \"a/b/f%d\", \"StartLine\": %d}]', event_type, user_id, event_id)",
                 ["event_type || ' f' || user_id || ':' || event_id"]),
    "osv-scanner": ("'{}'", "'{\"results\": []}'",
                    "format_string('{\"results\": [{\"packages\": [{\"package\": {\"name\": \"p%d\", \"version\": \"1.%d\"}, \"vulnerabilities\": [{\"id\": \"GHSA-%d\"}, "
                    "{\"id\": \"CVE-%d\"}]}, {\"package\": {\"name\": \"q\"}, \"vulnerabilities\": [{\"id\": \"X\"}]}]}]}', user_id, user_id, event_id, event_id)",
                    ["'GHSA-' || event_id || ' p' || user_id || '@1.' || user_id", "'CVE-' || event_id || ' p' || user_id || '@1.' || user_id", "'X q@None'"]),
    "trivy": ("'{\"Results\": []}'", "'{\"Results\": [{\"Target\": \"t\"}]}'",
              "format_string('{\"Results\": [{\"Target\": \"t%d\", \"Vulnerabilities\": [{\"VulnerabilityID\": \"CVE-%d\", \"PkgName\": \"p\", \"InstalledVersion\": \"2\"}], "
              "\"Secrets\": [{\"RuleID\": \"%s\"}], \"Misconfigurations\": [{\"ID\": \"D1\", \"Status\": \"FAIL\"}, {\"ID\": \"D2\", \"Status\": \"PASS\"}]}]}', user_id, event_id, event_type)",
              ["'CVE-' || event_id || ' p@2'", "event_type || ' t' || user_id", "'D1 t' || user_id"]),
    "checkov": ("'{\"passed\": 0}'", "'[{\"results\": {\"failed_checks\": []}}]'",
                "format_string('%s{\"results\": {\"failed_checks\": [{\"check_id\": \"CKV_%d\", \"file_path\": \"/f%d\"}, {\"check_id\": \"CKV_X\"}]}}%s', "
                "IF(event_id % 2 = 0, '[', ''), event_id, user_id, IF(event_id % 2 = 0, ', {\"other\": 1}]', ''))",
                ["'CKV_' || event_id || ' /f' || user_id", "'CKV_X '"]),
}


def _stdout(tool: str) -> str:
    nothing, clean, found, _ = _OUT[tool]
    return f"CASE {_KIND} WHEN 0 THEN '' WHEN 1 THEN {nothing} WHEN 2 THEN 'oops' WHEN 3 THEN {clean} ELSE {found} END"


def _register_flattener(tool: str) -> None:
    labels = ", ".join(_OUT[tool][3])

    @query(f"flatten_{tool.split('-')[0]}", f"SELECT event_id, ord - 1 AS ord, l[ord] AS item FROM (SELECT event_id, [{labels}] AS l FROM events WHERE {_KIND} >= 4), "
                                           "LATERAL (SELECT unnest(range(1, len(l) + 1)) AS ord)")
    def flatten(spark, sf):
        runs = table(spark, sf, "events").select("event_id", F.lit(tool).alias("tool"), F.expr(_stdout(tool)).alias("stdout"))
        return scan_reports.flatten_report(runs, tool, ["event_id"])


for _tool in _OUT:
    _register_flattener(_tool)

_TOOLS = list(_OUT)
_TOOL = "CASE user_id % 5 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TOOLS)) + " END"
_CODE = "CASE event_id % 11 WHEN 3 THEN 2 WHEN 4 THEN NULL WHEN 5 THEN 1 ELSE 0 END"
_NOTHING_TEXT = "CASE tool WHEN 'semgrep' THEN 'no files scanned' WHEN 'trivy' THEN 'no scannable targets' ELSE 'no IaC resources in scope' END"
_CLASSIFY_SQL = f"""SELECT event_id, {_TOOL} AS tool, event_id % 7 <> 0 AS installed, {_CODE} AS code, {_KIND} AS kind,
CASE WHEN event_id % 2 = 0 THEN 'last ' || event_type ELSE 'no output' END AS err FROM events"""
_COUNT = "CASE tool WHEN 'gitleaks' THEN 1 WHEN 'osv-scanner' THEN 3 WHEN 'trivy' THEN 3 ELSE 2 END"
_STATE = ("CASE WHEN kind = 0 THEN CASE WHEN tool = 'gitleaks' THEN 'clean' ELSE 'empty' END WHEN kind = 1 THEN CASE tool WHEN 'gitleaks' THEN 'noreport' "
          "WHEN 'osv-scanner' THEN 'clean' ELSE 'nothing' END WHEN kind = 2 THEN 'bad' WHEN kind = 3 THEN 'clean' ELSE 'findings' END")


@query("classify_scan", f"""WITH r AS ({_CLASSIFY_SQL}), s AS (SELECT *, {_STATE} AS state FROM r),
t AS (SELECT *, CASE WHEN NOT installed THEN 'skipped' WHEN code IS NULL OR code = 2 THEN 'error' WHEN state = 'nothing' THEN 'skipped'
WHEN state IN ('empty', 'bad', 'noreport') THEN 'error' ELSE state END AS status FROM s)
SELECT event_id, tool, status, CASE WHEN status = 'findings' THEN {_COUNT} ELSE 0 END AS findings,
CASE WHEN NOT installed THEN 'not installed' WHEN code IS NULL THEN 'timed out after 600s' WHEN code = 2 THEN 'exit 2: ' || err
WHEN state = 'nothing' THEN {_NOTHING_TEXT} WHEN state = 'empty' THEN 'unreadable output (scanner produced no JSON output): ' || err
WHEN state = 'noreport' THEN 'unreadable output (gitleaks wrote no report): ' || err WHEN state = 'bad' THEN 'unreadable output (invalid JSON): ' || err
ELSE '' END AS detail FROM t""")
def classify_scan(spark, sf):
    out = F.coalesce(*[F.when(F.col("tool") == t, F.expr(_stdout(t))) for t in _TOOLS])
    runs = table(spark, sf, "events").withColumn("tool", F.expr(_TOOL)).select(
        "event_id", "tool", F.expr("event_id % 7 <> 0").alias("installed"), F.expr(_CODE).alias("returncode"), out.alias("stdout"),
        F.expr("IF(event_id % 2 = 0, concat('first\nlast ', event_type, '  '), NULL)").alias("stderr"))
    return scan_reports.classify_scan(runs, ["event_id"]).select("event_id", "tool", "status", "findings", "detail")


# ---- runs: one per customer, its field checks are the customer's orders

_RUN = {"provider": "lower(c_mktsegment)", "consumer": "c_name", "provider_entity": "'Order'", "consumer_entity": "'OrderRecord'",
        "engine": "CASE WHEN c_custkey % 2 = 0 THEN 'heuristic' ELSE 'model-x' END", "generated_at": "concat('2026-01-', 10 + c_custkey % 20)",
        "heal_passed": "c_custkey % 6 <> 0", "e2e_passed": "c_custkey % 4 <> 1",
        "e2e_error": "CASE WHEN c_custkey % 8 = 1 THEN 'compile failed' ELSE '' END"}
_PHASES = ["1_parse", "2_map", "3_generate", "4_validate", "security"]


def _run_tables(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    run = F.col("c_custkey").alias("run_id")
    runs = c.select(run, *[F.expr(t).alias(n) for n, t in _RUN.items()],
                    F.array(F.lit("GET /api/orders/1"), F.concat(F.lit("GET /api/"), "c_name")).alias("requests"))
    rounds = c.filter("c_custkey % 6 = 0").select(
        run, F.explode(F.array(F.lit(1), F.lit(2))).alias("round")).select(
        "run_id", "round", F.expr("filter(array(concat('F821 x', round), 'E9 y', 'F401 z', 'W1 w'), (v, i) -> i < run_id % 5)").alias("diagnostics"),
        F.expr("concat('step ', round)").alias("action"))
    checks = o.select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("ord"), F.lit("get_order").alias("method"),
                      F.lower("o_orderpriority").alias("consumer_field"), F.col("o_orderpriority").alias("provider_json"),
                      F.col("o_orderkey").cast("string").alias("expected"),
                      F.expr("CASE WHEN o_orderkey % 17 = 0 THEN o_orderstatus WHEN o_orderkey % 19 = 0 THEN NULL ELSE cast(o_orderkey AS STRING) END").alias("actual"),
                      F.expr("o_orderkey % 17 <> 0 AND o_orderkey % 19 <> 0").alias("ok"))
    scans = c.filter("c_custkey % 9 <> 0").select(run, "c_nationkey", F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(t).alias("tool")) for i, t in enumerate(_TOOLS)])).alias("t")).select(
        "run_id", "t.ord", "t.tool", F.expr("CASE (run_id + t.ord) % 13 WHEN 0 THEN 'findings' WHEN 1 THEN 'error' WHEN 2 THEN 'skipped' ELSE IF(c_nationkey = 3, 'skipped', 'clean') END").alias("status"),
        F.expr("IF((run_id + t.ord) % 13 = 1, concat('exit ', run_id), '')").alias("detail"),
        F.expr("IF((run_id + t.ord) % 13 = 0, transform(sequence(1, 7), n -> concat('X-', run_id, '-', n)), array())").alias("items"))
    scans = scans.withColumn("findings", F.size("items").cast("bigint"))
    pairs = c.select(run, F.explode(F.sequence(F.lit(0), F.lit(2))).alias("c_ord")).select(
        "run_id", "c_ord", F.expr("concat('f', c_ord)").alias("consumer_field"), F.expr("concat('wire', c_ord)").alias("provider_json"),
        F.expr("cast((run_id * 7 + c_ord * 13) % 101 AS DOUBLE) / 100").alias("confidence"), F.lit("heuristic").alias("source"))
    unmapped = c.filter("c_custkey % 3 = 0").select(run, F.explode(F.array(F.lit(0), F.lit(1))).alias("ord")).select("run_id", "ord", F.expr("concat('u', ord)").alias("name"))
    phases = F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(p).alias("phase")) for i, p in enumerate(_PHASES)]))
    timings = c.select(run, phases.alias("p")).select("run_id", "p.ord", "p.phase", F.expr("IF(run_id % 10 = 0, 0D, cast((run_id * (p.ord + 3)) % 100 AS DOUBLE) / 8)").alias("seconds"))
    return report.RunTables(runs, rounds, checks, scans, pairs, unmapped, timings)


_STATUS_SQL = "CASE (c_custkey + o) % 13 WHEN 0 THEN 'findings' WHEN 1 THEN 'error' WHEN 2 THEN 'skipped' ELSE CASE WHEN c_nationkey = 3 THEN 'skipped' ELSE 'clean' END END"
_RUNS_SQL = f"""runs AS (SELECT c_custkey AS run_id, {', '.join(f'{t} AS {n}' for n, t in _RUN.items())}, c_name FROM customer),
rounds AS (SELECT c_custkey AS run_id, r AS round, list_filter(['F821 x' || r, 'E9 y', 'F401 z', 'W1 w'], lambda v, i: i <= c_custkey % 5) AS diagnostics
FROM customer CROSS JOIN (VALUES (1), (2)) v(r) WHERE c_custkey % 6 = 0),
checks AS (SELECT o_custkey AS run_id, o_orderkey AS ord, lower(o_orderpriority) AS cf, o_orderpriority AS pj, o_orderkey::VARCHAR AS expected,
CASE WHEN o_orderkey % 17 = 0 THEN o_orderstatus WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_orderkey::VARCHAR END AS actual,
o_orderkey % 17 <> 0 AND o_orderkey % 19 <> 0 AS ok FROM orders),
scans AS (SELECT c_custkey AS run_id, o AS ord, tool, {_STATUS_SQL} AS status, CASE WHEN (c_custkey + o) % 13 = 1 THEN 'exit ' || c_custkey ELSE '' END AS detail,
CASE WHEN (c_custkey + o) % 13 = 0 THEN list_transform(range(1, 8), lambda n: 'X-' || c_custkey || '-' || n) ELSE [] END AS items
FROM customer CROSS JOIN (VALUES {', '.join(f"({i}, '{t}')" for i, t in enumerate(_TOOLS))}) v(o, tool) WHERE c_custkey % 9 <> 0),
timings AS (SELECT c_custkey AS run_id, o AS ord, p AS phase, CASE WHEN c_custkey % 10 = 0 THEN 0.0::DOUBLE ELSE ((c_custkey * (o + 3)) % 100)::DOUBLE / 8 END AS seconds
FROM customer CROSS JOIN (VALUES {', '.join(f"({i}, '{p}')" for i, p in enumerate(_PHASES))}) v(o, p)),
verdict AS (SELECT run_id, heal_passed AND e2e_passed AND NOT coalesce(b, FALSE) AS passed FROM runs
LEFT JOIN (SELECT run_id, bool_or(status IN ('findings', 'error')) AS b FROM scans GROUP BY ALL) USING (run_id))"""


@query("run_verdict", f"WITH {_RUNS_SQL} SELECT run_id, passed FROM verdict")
def run_verdict(spark, sf):
    t = _run_tables(spark, sf)
    return report.run_verdict(t.runs, t.scans)


@query("phase_shares", f"""WITH {_RUNS_SQL}, tot AS (SELECT run_id, sum(seconds) AS total FROM timings GROUP BY ALL)
SELECT run_id, ord, phase, seconds, total, greatest(seconds / CASE WHEN total = 0 THEN 1.0::DOUBLE ELSE total END, 0.01::DOUBLE) AS share
FROM timings JOIN tot USING (run_id)""")
def phase_shares(spark, sf):
    return report.phase_shares(_run_tables(spark, sf).timings)


_SHOWN = "CASE WHEN {0} IS NULL THEN 'None' WHEN regexp_full_match({0}, '-?\\d+(\\.\\d+)?') THEN {0} ELSE '''' || {0} || '''' END"
_REASONS_SQL = f"""{_RUNS_SQL}, reasons AS (
SELECT run_id, 0 AS rank, 0 AS ord, 'Generated code does not compile: ' || CASE WHEN len(coalesce(d, [])) = 0 THEN 'see heal rounds' ELSE array_to_string(d[1:3], '; ') END AS reason
FROM runs LEFT JOIN (SELECT run_id, diagnostics AS d FROM rounds WHERE round = 2) USING (run_id) WHERE NOT heal_passed
UNION ALL SELECT run_id, 1, ord, 'End-to-end: `' || cf || '` expected ' || {_SHOWN.format('expected')} || ' from `' || pj || '`, got ' || {_SHOWN.format('actual')} || ' (get_order)'
FROM checks JOIN runs USING (run_id) WHERE NOT ok AND NOT e2e_passed
UNION ALL SELECT run_id, 1, 0, 'End-to-end check did not run: ' || CASE WHEN e2e_error = '' THEN 'unknown error' ELSE e2e_error END FROM runs r
WHERE NOT e2e_passed AND NOT EXISTS (SELECT 1 FROM checks c WHERE c.run_id = r.run_id AND NOT ok)
UNION ALL SELECT run_id, 2, ord, CASE status WHEN 'findings' THEN tool || ': 7 finding(s): ' || array_to_string(items[1:5], ', ')
ELSE tool || ' errored, so the code is not proven clean: ' || detail END FROM scans WHERE status IN ('findings', 'error')
UNION ALL SELECT run_id, 3, 0, 'Consumer fields with no provider source: u0, u1' FROM runs WHERE run_id % 3 = 0)"""


@query("failure_reasons", f"WITH {_REASONS_SQL} SELECT run_id, rank, ord, reason FROM reasons")
def failure_reasons(spark, sf):
    return report.failure_reasons(_run_tables(spark, sf))


@query("logged_items", f"WITH {_RUNS_SQL} SELECT run_id, tool, unnest(items) AS item FROM scans")
def logged_items(spark, sf):
    return report.logged_items(_run_tables(spark, sf).scans).select("run_id", "tool", "item")


@query("report_tiles", f"""WITH {_RUNS_SQL}, k AS (SELECT run_id, count(*) FILTER (WHERE ok) AS ok, count(*) AS n FROM checks GROUP BY ALL),
s AS (SELECT run_id, count(*) FILTER (WHERE status = 'clean') AS clean, count(*) FILTER (WHERE status <> 'skipped') AS ran, count(*) AS n FROM scans GROUP BY ALL),
t AS (SELECT run_id, sum(seconds) AS secs FROM timings GROUP BY ALL)
SELECT run_id, '3/' || CASE WHEN run_id % 3 = 0 THEN 5 ELSE 3 END AS fields_mapped, CASE WHEN run_id % 3 = 0 THEN '60%' ELSE '100%' END AS coverage,
coalesce(k.ok, 0) || '/' || coalesce(k.n, 0) AS field_checks, CASE WHEN run_id % 6 = 0 THEN '2' ELSE '0' END AS rounds,
CASE WHEN s.n IS NULL THEN 'off' WHEN s.ran > 0 THEN s.clean || '/' || s.ran ELSE '-' END AS scanners,
CASE WHEN s.n IS NULL THEN 'scanners not run' WHEN s.ran > 0 THEN 'scanners clean' || CASE WHEN s.n > s.ran THEN ' (' || (s.n - s.ran) || ' skipped)' ELSE '' END
ELSE 'scanners: all ' || s.n || ' skipped' END AS scanners_text, printf('%.1fs', round_even(t.secs, 1)) AS total_time
FROM runs LEFT JOIN k USING (run_id) LEFT JOIN s USING (run_id) LEFT JOIN t USING (run_id)""")
def report_tiles(spark, sf):
    return report.report_tiles(_run_tables(spark, sf))


_CONF = "printf('%.2f', ((run_id * 7 + o * 13) % 101)::DOUBLE / 100)"


@query("report_markdown_lines", f"""WITH {_REASONS_SQL}, k AS (SELECT run_id, count(*) FILTER (WHERE ok) AS ok, count(*) AS n FROM checks GROUP BY ALL),
pf AS (SELECT * FROM runs JOIN verdict USING (run_id)), why AS (SELECT DISTINCT run_id FROM reasons), sc AS (SELECT DISTINCT run_id FROM scans)
SELECT run_id, 0 AS section, i - 1 AS ord, 0 AS sub, l[i] AS line FROM (SELECT run_id, ['# Integration report: ' || consumer || ' -> ' || provider, '',
'**Result:** ' || CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END || '  ', '**Mapping engine:** ' || engine || '  ', '**Generated:** ' || generated_at, ''] AS l FROM pf), range(1, 7) g(i)
UNION ALL SELECT run_id, 1, i, 0, CASE i WHEN 0 THEN '## Why it failed' ELSE '' END FROM why, range(0, 2) g(i)
UNION ALL SELECT run_id, 2, rank, ord, '- ' || reason FROM reasons
UNION ALL SELECT run_id, 3, 0, 0, '' FROM why
UNION ALL SELECT run_id, 4, i - 1, 0, (['## Field mapping (Order -> OrderRecord)', '', '| Consumer field | Provider field (wire) | Confidence | Source |', '|---|---|---|---|'])[i] FROM runs, range(1, 5) g(i)
UNION ALL SELECT run_id, 5, o, 0, '| `f' || o || '` | `wire' || o || '` | ' || {_CONF} || ' | heuristic |' FROM runs, range(0, 3) g(o)
UNION ALL SELECT run_id, 6, o, 0, '| `u' || o || '` | _unmapped_ | | |' FROM runs, range(0, 2) g(o) WHERE run_id % 3 = 0
UNION ALL SELECT run_id, 7, i - 1, 0, (['', '## Validation', '', '- Compile: ' || CASE WHEN heal_passed THEN 'pass (0' ELSE 'fail (2' END || ' heal round(s))'])[i] FROM runs, range(1, 5) g(i)
UNION ALL SELECT run_id, 8, round, 0, '  - round ' || round || ': step ' || round || ' (' || len(diagnostics) || ' diagnostic(s))' FROM rounds
UNION ALL SELECT run_id, 9, 0, 0, '- End-to-end: ' || CASE WHEN e2e_passed THEN 'pass' ELSE 'fail' END || ', ' || coalesce(ok, 0) || '/' || coalesce(n, 0) || ' field checks, requests: GET /api/orders/1, GET /api/' || c_name FROM runs LEFT JOIN k USING (run_id)
UNION ALL SELECT run_id, 10, i - 1, 0, (['', '## Security (delta-scoped, parallel)', '', '| Scanner | Status | Findings | Detail |', '|---|---|---|---|'])[i] FROM sc, range(1, 6) g(i)
UNION ALL SELECT run_id, 11, ord, 0, '| ' || tool || ' | ' || status || ' | ' || CASE WHEN status = 'skipped' THEN '-' ELSE len(items)::VARCHAR END || ' | ' || detail || ' |' FROM scans
UNION ALL SELECT DISTINCT run_id, 12, 0, 0, '' FROM scans WHERE len(items) > 0
UNION ALL SELECT run_id, 13, ord, i - 1, '- `' || tool || '`: ' || items[i] FROM scans, range(1, 8) g(i) WHERE len(items) > 0""")
def report_markdown_lines(spark, sf):
    return report.report_markdown_lines(_run_tables(spark, sf))
