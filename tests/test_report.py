import os

from crosswalk.plans import report


def tables(spark, failed=False):
    runs = spark.createDataFrame([(1, "order-service", "billing", "Order", "OrderRecord", "heuristic", "now", True, not failed, "", ["GET /x"])],
                                 "run_id INT, provider STRING, consumer STRING, provider_entity STRING, consumer_entity STRING, engine STRING, generated_at STRING, "
                                 "heal_passed BOOLEAN, e2e_passed BOOLEAN, e2e_error STRING, requests ARRAY<STRING>")
    checks = [(1, i, "get", "client_id" if i == 1 else f"f{i}", "customerId", "2055", "1713" if failed and i == 1 else "2055", not (failed and i == 1)) for i in range(14)]
    scans = [(1, 0, "osv-scanner", "findings", 1, "", ["GHSA-xxxx anyio@4.9.0"]), (1, 1, "semgrep", "error", 0, "exit 2: boom", [])] if failed else [(1, 0, "trivy", "clean", 0, "", [])]
    return report.RunTables(
        runs, spark.createDataFrame([], "run_id INT, round INT, diagnostics ARRAY<STRING>, action STRING"),
        spark.createDataFrame(checks, "run_id INT, ord INT, method STRING, consumer_field STRING, provider_json STRING, expected STRING, actual STRING, ok BOOLEAN"),
        spark.createDataFrame(scans, "run_id INT, ord INT, tool STRING, status STRING, findings BIGINT, detail STRING, items ARRAY<STRING>"),
        spark.createDataFrame([(1, 0, "client_id", "customerId", 0.9, "heuristic")], "run_id INT, c_ord INT, consumer_field STRING, provider_json STRING, confidence DOUBLE, source STRING"),
        spark.createDataFrame([], "run_id INT, ord INT, name STRING"),
        spark.createDataFrame([(1, 0, "1_parse", 0.0)], "run_id INT, ord INT, phase STRING, seconds DOUBLE"))


def ordered(lines):
    return [r["line"] for r in lines.orderBy("section", "ord", "sub").collect()]


def test_clean_run(spark, tmp_path):
    t = tables(spark)
    assert report.run_verdict(t.runs, t.scans).first()["passed"] and report.failure_reasons(t).count() == 0
    lines = ordered(report.report_markdown_lines(t))
    assert "**Result:** PASS  " in lines and any("14/14 field checks" in x for x in lines) and "## Why it failed" not in lines
    report.write_markdown(report.report_markdown_lines(t), str(tmp_path / "md"))
    folder = tmp_path / "md" / "run_id=1"
    written = "".join((folder / f).read_text() for f in sorted(os.listdir(folder)) if f.startswith("part-"))
    assert written.splitlines() == lines


def test_failed_run(spark):
    t = tables(spark, failed=True)
    reasons = [r["reason"] for r in report.failure_reasons(t).orderBy("rank", "ord").collect()]
    assert reasons == ["End-to-end: `client_id` expected 2055 from `customerId`, got 1713 (get)", "osv-scanner: 1 finding(s): GHSA-xxxx anyio@4.9.0",
                       "semgrep errored, so the code is not proven clean: exit 2: boom"]
    assert not report.run_verdict(t.runs, t.scans).first()["passed"]
    assert report.phase_shares(t.timings).first()["share"] == 0.01
