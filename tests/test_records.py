import json
import re

from pyspark.sql import functions as F

from crosswalk import model
from crosswalk.operators import apply, check, graph, routes, scan
from crosswalk.sources.scan_reports import classify_scan
from crosswalk.streaming import pipelines
from crosswalk.streaming.pipelines import start, stream_of

SF = "/root/testdata/sf0.001"
CONSUMER = [{"name": "order_ref", "type": "integer", "source_type": ""}, {"name": "client_id", "type": "integer", "source_type": ""},
            {"name": "memo", "type": "string", "source_type": ""}]


def orders(spark):
    return spark.read.parquet(f"{SF}/orders.parquet").select(F.col("o_orderkey").alias("orderId"), F.col("o_custkey").alias("customerId"))


def test_a_wrong_mapping_fails_exactly_its_field(spark):
    checks = [check.FieldCheck("order_ref", "orderId", "integer"), check.FieldCheck("client_id", "customerId", "integer")]
    provider = orders(spark).filter("orderId <> customerId")
    wrong = apply.apply_mapping(provider, [("order_ref", "orderId"), ("client_id", "orderId")], CONSUMER, keep=["orderId"])
    rows = check.check_rollup(check.field_checks(provider, wrong, "orderId", checks), ["consumer_field"]).collect()
    assert {r["consumer_field"]: r["passed"] for r in rows} == {"order_ref": True, "client_id": False}
    summary = {r["consumer_field"]: r["rows_ok"] for r in check.field_check_summary(provider, wrong, "orderId", checks).collect()}
    assert summary == {"order_ref": provider.count(), "client_id": 0}


def test_stream_equals_batch(spark, tmp_path):
    plan = [("order_ref", "orderId"), ("client_id", "customerId")]
    orders(spark).repartition(3).write.parquet(str(tmp_path / "in"))
    query = pipelines.start_mapping(pipelines.stream_of(spark, str(tmp_path / "in"), 1), plan, CONSUMER, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    got, want = spark.read.parquet(str(tmp_path / "out")), apply.apply_mapping(orders(spark), plan, CONSUMER)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_rule_scan_on_a_stream(spark, tmp_path):
    rules = [("license", "(?i)license"), ("email", r"[a-z0-9.]+@[a-z0-9.]+")]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs.write.parquet(str(tmp_path / "in"))
    pipelines.start_rule_scan(pipelines.stream_of(spark, str(tmp_path / "in")), rules, ["doc_id"], str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    want = scan.scan_rules(docs, rules, ["doc_id"])
    assert spark.read.parquet(str(tmp_path / "out")).exceptAll(want).count() == 0 and want.count() > 0


def rules():
    return [check.Rule("A", 1, lambda r: r["t"].contains("\t"), lambda r: F.lit("tab")), check.Rule("B", 2, lambda r: r["t"].contains("x"), lambda r: F.lit("has x"))]


def repaired(spark, fallback=None):
    df = spark.createDataFrame([(1, "clean"), (2, "a\tb"), (3, "x"), (4, "x\tx")], "id INT, t STRING")
    out = check.repair_rounds(df, rules(), {"t": lambda r: F.replace(r["t"], F.lit("\t"), F.lit(" "))}, fallback)
    return {r["id"]: (r["t"], r["passed"], [(x["round"], x["diagnostics"], x["action"]) for x in r["rounds"]]) for r in out.collect()}


def test_repair_without_fallback(spark):
    assert repaired(spark) == {1: ("clean", True, []), 2: ("a b", True, [(1, ["A tab"], check.SAFE_FIX)]),
                               3: ("x", False, [(1, ["B has x"], check.NO_FALLBACK)]), 4: ("x x", False, [(1, ["B has x"], check.NO_FALLBACK)])}


def test_repair_with_fallback(spark):
    got = repaired(spark, {"t": lambda r: F.regexp_replace(r["t"], "^(.*?)x", "$1y")})
    assert got[3] == ("y", True, [(1, ["B has x"], check.FALLBACK)])
    assert got[4] == ("y y", True, [(1, ["B has x"], check.FALLBACK), (2, ["B has x"], check.FALLBACK)])


def test_level_two_waits_for_level_one(spark):
    df = spark.createDataFrame([(4, "x\tx")], "id INT, t STRING")
    assert [r["diagnostic"] for r in check.check_rows(df, rules(), ["id"]).collect()] == ["A tab"]


def test_scan_status(spark):
    semgrep = json.dumps({"paths": {"scanned": ["a"]}, "results": [{"check_id": c, "path": "/x/client.py", "start": {"line": 7}} for c in "ab"]})
    rows = [("semgrep", False, 0, "", ""), ("semgrep", True, 0, "", ""), ("trivy", True, 0, "", ""), ("gitleaks", True, 0, None, ""),
            ("semgrep", True, 1, semgrep, ""), ("semgrep", True, 0, '{"paths": {"scanned": []}}', ""), ("checkov", True, 0, '{"passed": 0}', ""),
            ("semgrep", True, 2, "", "boom"), ("gitleaks", True, 0, "", ""), ("semgrep", True, 0, '{"paths": {"scanned": ["a"]}, "results": [{"path": "p"}]}', "")]
    runs = spark.createDataFrame(rows, model.TOOL_RUNS_DDL).coalesce(1).withColumn("n", F.monotonically_increasing_id())
    got = {r["n"]: r for r in classify_scan(runs, ["n"]).collect()}
    assert [got[i]["status"] for i in range(10)] == ["skipped", "error", "error", "error", "findings", "skipped", "skipped", "error", "clean", "error"]
    assert got[4]["items"] == ["a client.py:7", "b client.py:7"] and got[0]["detail"] == "not installed" and "exit 2" in got[7]["detail"]


ROUTE_DDL = "ep_ord BIGINT, method STRING, path STRING, handler STRING"


def slow_route(declared, method, url):
    path = re.sub("[?#].*$", "", re.sub("^https?://[^/?#]*", "", url)) if url is not None else None
    fits = [r for r in declared if path is not None and r[1] == method and re.search("^" + re.sub(r"\{\w+\}", "[^/]+", r[2]) + r"/?\Z", path)]
    return min(fits, default=(None, None, None, None))


def test_routes_of_every_shape(spark):
    declared = [(0, "GET", "/a/{x}", "one"), (1, "GET", "/a/b", "never"), (2, "GET", "/c/", "slash"), (3, "POST", "/a/{x}/{y}", "two"), (4, "GET", "/", "root"),
                (5, "GET", "/v1.0/{x}.json", "file"), (6, "GET", "/d/x{y}", "part"), (7, "GET", "/e.*", "wild"), (8, "GET", "/d/{z}/q", "deep"), (9, "PUT", "", "empty")]
    urls = [("GET", "http://h/a/b?q=1"), ("GET", "/a/b/"), ("GET", "/a/b//"), ("GET", "/c/"), ("GET", "/c//"), ("GET", "/c"), ("POST", "/a/1/2#f"), ("POST", "/a/1"),
            ("GET", "/"), ("GET", "http://h"), ("PUT", "http://h"), ("PUT", "/"), ("GET", "/v1.0/x.json"), ("GET", "/v1/0/xy/json"), ("GET", "/v1.0/.json"), ("GET", "/d/xy"),
            ("GET", "/d/x"), ("GET", "/d/x1/q/"), ("GET", "/e/f/g"), ("GET", "/e"), ("GET", None), (None, "/a/b"), ("get", "/a/b"), ("GET", "/a//"), ("GET", "/a/")]
    requests = spark.createDataFrame([(i % 5 or None, *u) for i, u in enumerate(urls)] * 2, "ep_ord INT, method STRING, url STRING")
    expected = sorted(repr((i % 5 or None, *[slow_route(declared, *u)[c] for c in (0, 2, 3)])) for i, u in enumerate(urls)) * 2
    for per_trie in (2, 100):  # keys repeat, are null and have the name of a column of the result
        found = routes.match_routes(requests.withColumnRenamed("ep_ord", "path"), spark.createDataFrame(declared, ROUTE_DDL), ["path"], routes_per_trie=per_trie)
        assert sorted(repr(tuple(r)) for r in found.collect()) == sorted(expected)
    nothing = routes.match_routes(requests, spark.createDataFrame([], ROUTE_DDL), ["url"])
    assert nothing.columns == ["url", "ep_ord", "route", "handler"] and nothing.filter("handler IS NOT NULL").count() == 0


def test_many_routes_on_a_batch_and_on_a_stream(spark, tmp_path):
    """Ten routes and a hundred thousand, a third of all requests for one path."""
    declared = [(i, "GET", f"/s{i % 317}/{{id}}/t{i}" if i % 3 else f"/s{i % 317}/x{i}", f"h{i}") for i in range(100_000)]
    urls = ["/s1/x318"] * 300 + [f"/s{i % 317}/9/t{i}" for i in range(0, 100_000, 311)] + [f"/s{i % 317}/x{i}/" for i in range(0, 100_000, 411)]
    requests = spark.createDataFrame(list(enumerate(urls)), "id INT, url STRING").selectExpr("id", "'GET' AS method", "url")
    requests.write.parquet(str(tmp_path / "in"))
    by_path = {}
    for r in reversed(declared):
        by_path[r[2]] = r
    for some in (declared[:10], declared):
        table = spark.createDataFrame(some, ROUTE_DDL)
        got = {r.id: r.ep_ord for r in routes.match_routes(requests, table, ["id"]).collect()}
        def known(u):
            parts = u.strip("/").split("/")
            r = by_path.get("/" + "/".join(parts if len(parts) < 3 else [parts[0], "{id}", parts[2]]))
            return r[0] if r and r[0] < len(some) else None
        assert got == {i: known(u) for i, u in enumerate(urls)}
        out = str(tmp_path / f"out{len(some)}")
        start(stream_of(spark, str(tmp_path / "in")), lambda df: routes.match_routes(df, table, ["id"]), out, out + "-checkpoint").awaitTermination()
        assert {r.id: r.ep_ord for r in spark.read.parquet(out).collect()} == got


def test_closure_skips_unknown_packages_and_survives_cycles(spark):
    packages = spark.createDataFrame([("Httpx", "1"), ("anyio", "2"), ("idna", "3"), ("lonely", "4")], "name STRING, version STRING")
    needs = spark.createDataFrame([("httpx", "AnyIO>=1"), ("anyio", "idna"), ("idna", "httpx"), ("httpx", "ghost"), ("ghost", "lonely"), ("httpx", "lonely; extra == 'x'")],
                                  "name STRING, requirement STRING")
    got = graph.sorted_pins(graph.dependency_closure(packages, needs, spark.createDataFrame([("HTTPX",), ("gone",)], "name STRING"))).collect()
    assert [r["pin"] for r in got] == ["anyio==2", "httpx==1", "idna==3"]


def test_many_rules_run_in_several_automata(spark):
    df = spark.createDataFrame([(1, "one two\nthree")], "id INT, text STRING")
    hits = scan.scan_rules(df, [("a", "one"), ("b", "two"), ("c", "three"), ("d", "four"), ("e", "e$")], ["id"], rules_per_automaton=2).collect()
    assert sorted((r["rule"], r["line"]) for r in hits) == [("a", 1), ("b", 1), ("c", 2), ("e", 2)]


def test_versions_of_all_shapes(spark):
    from pyspark.sql import functions as F

    from crosswalk.operators import scan
    packages = spark.createDataFrame([(i, "lib", v) for i, v in enumerate(
        ["1.0", "1.0.0", "0.9", "1.0.0rc1", "2.0.0rc1", "2.0", "20240131000000000000", "1.10", "1.9-beta.2"])], "id int, name string, version string")
    advisories = spark.createDataFrame([("A", "lib", "1.0.0", "2.0.0"), ("B", "lib", None, "1.0"), ("C", "lib", "20240130000000000000", None)],
                                       "advisory string, name string, introduced string, fixed string")
    found = {(r.version, r.advisory) for r in scan.match_advisories(packages, advisories, ["id"]).select(
        F.element_at(F.split("item", "@"), 2).alias("version"), "advisory").collect()}
    assert found == {("1.0", "A"), ("1.0.0", "A"), ("2.0.0rc1", "A"), ("1.10", "A"), ("1.9-beta.2", "A"), ("0.9", "B"), ("1.0.0rc1", "B"),
                     ("20240131000000000000", "C")}


def test_unknown_tool_is_never_clean(spark):
    from crosswalk.sources.scan_reports import classify_scan
    runs = spark.createDataFrame([(1, "newtool", True, 0, "{}", "")], "id int, tool string, installed boolean, returncode int, stdout string, stderr string")
    row = classify_scan(runs, ["id"]).first()
    assert (row.status, row.detail) == ("error", "unknown tool")


def test_decimals_keep_their_digits_and_lists_their_type(spark):
    fields = [{"name": n, "type": t, "source_type": ""} for n, t in (("a", "decimal"), ("b", "decimal"), ("c", "decimal"), ("d", "list<decimal>"))]
    df = spark.createDataFrame([(1e25, "1.2345678901234567e-5")], "x DOUBLE, y STRING").withColumn("z", F.expr("CAST(1.23 AS DECIMAL(30,20))"))
    out = apply.apply_mapping(df, [("a", "x"), ("b", "y"), ("c", "z")], fields)
    assert out.first().a == 1e25 and out.first().b == 1.2345678901234567e-5 and str(out.first().c).startswith("1.23")
    assert out.schema["d"].dataType.simpleString() == "array<double>"


def test_wire_records_by_snake_name_and_as_deep_as_they_are(spark):
    def field(name, wire, ctype):
        return {"name": name, "json_name": wire, "type": ctype}
    catalog = {"E0": ("class", [field("shipCity", "ship-city", "string"), field("next", "next", "ref:E1")])}
    for i in range(1, 6):
        catalog[f"E{i}"] = ("class", [field("next", "next", f"ref:E{i + 1}")])
    catalog["E6"] = ("class", [field("leafValue", "leafValue", "integer"), field("back", "back", "ref:E0")])
    body = '{"ship_city": "Rome", "next": ' + '{"next": ' * 5 + '{"leafValue": 7, "back": {"a": 1}}' + "}" * 6
    row = apply.parse_dto(spark.createDataFrame([(body,)], "body STRING"), "body", "E0", catalog).select(
        "ship_city", "next.next.next.next.next.next.leaf_value", "next.next.next.next.next.next.back").first()
    assert tuple(row) == ("Rome", 7, '{"a":1}')


def test_routes_that_cannot_match_stay_out_of_the_tries(spark, monkeypatch):
    """Of one method and template only the first route, however often it is declared; and no pass holds two tries."""
    from pyspark import SparkContext
    sent, share = [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: sent.append(len(value)) or share(self, value))
    declared = [(i, "GET", f"/a/{{id}}/{i % 3}", f"h{i}") for i in range(300)] + [(7, "GET", "/a/{id}/1", None), (None, "GET", "/a/{id}/2", "x")]
    requests = spark.createDataFrame([(i, "GET", f"/a/9/{i}") for i in range(4)], "id INT, method STRING, url STRING")
    for per_trie, sizes in ((100, [3]), (2, [2, 1])):
        sent.clear()
        found = routes.match_routes(requests, spark.createDataFrame(declared, ROUTE_DDL), ["id"], routes_per_trie=per_trie)
        assert sent == sizes and found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
        assert {r.id: (r.ep_ord, r.handler) for r in found.collect()} == {0: (0, "h0"), 1: (1, "h1"), 2: (None, "x"), 3: (None, None)}
