from pyspark.sql import functions as F

from crosswalk import model
from crosswalk.operators.samples import sample_entities
from crosswalk.sources import catalog as cat
from crosswalk.sources import source_code as sc
from services import ORDERS, entities, fields
from workload import catalogs

JAVA = ('import com.fasterxml.jackson.annotation.*;\npublic record Payment(@JsonProperty("payment_id") String id, java.math.BigDecimal amount) {}\n'
        "class Account { private static final long serialVersionUID = 1L; @JsonIgnore private String secret; private Optional<String> nickname; }\n")
PYTHON = '''
import enum, pydantic
from dataclasses import dataclass

class Tier(enum.IntEnum):
    GOLD = SILVER = 1
    BASIC = 2

class Seat(pydantic.BaseModel):
    LIMIT = 9
    row: "str"
    tier: Tier = Tier.BASIC
    price: float = pydantic.Field(3.5, ge=0, serialization_alias="seatPrice")

@dataclass(frozen=True)
class Booking:
    seats: list[Seat]
    _cache: dict = None

class Plain:
    x: int

@api.get(f"/{V}/seats", response_model=list[Seat])
@app.post("/bookings/{booking_id}")
@cached(60)
async def book(booking_id: int, body: Booking, note: str) -> Booking: ...
'''


def test_java_record_and_ignored_fields(spark):
    c = sc.extract_java_catalog(spark.createDataFrame([("s", "Dto.java", JAVA)], "service STRING, file STRING, text STRING"))
    assert {(r["entity"], r["kind"]) for r in c.entities.collect()} == {("Payment", "record"), ("Account", "class")}
    assert {(r["entity"], r["name"], r["json_name"], r["type"], r["optional"]) for r in c.fields.collect()} == {
        ("Payment", "id", "payment_id", "string", False), ("Payment", "amount", "amount", "decimal", False),
        ("Account", "nickname", "nickname", "string", True)}


def test_python_alias_enum_nested_and_bad_file(spark, tmp_path):
    (tmp_path / "m.py").write_text(PYTHON)
    (tmp_path / "tests").mkdir()
    (tmp_path / "tests" / "skip.py").write_text("class Skipped(BaseModel):\n    a: int\n")
    (tmp_path / "bad.py").write_text("def broken(:\n")
    c = sc.extract_python_catalog(sc.scan_source_files(spark, str(tmp_path), "python", "svc"))
    got = {(r["entity"], r["name"]): (r["json_name"], r["type"]) for r in c.fields.collect()}
    assert got == {("Seat", "row"): ("row", "string"), ("Seat", "tier"): ("tier", "ref:Tier"), ("Seat", "price"): ("seatPrice", "decimal"),
                   ("Booking", "seats"): ("seats", "list<ref:Seat>")}
    assert [r["values"] for r in c.entities.filter("kind = 'enum'").collect()] == [["GOLD", "SILVER", "BASIC"]]
    assert {(r["method"], r["path"], r["returns"]) for r in c.endpoints.collect()} == {("GET", "/", "list<Seat>"), ("POST", "/bookings/{booking_id}", "Booking")}
    assert {(r["name"], r["location"]) for r in c.params.collect() if r["location"] == "path"} == {("booking_id", "path")}
    assert c.params.count() == 6
    assert [(r["file"], r["error"]) for r in c.errors.collect()] == [("bad.py", "SyntaxError")]


def test_catalog_json_on_disk(spark, tmp_path):
    services = spark.createDataFrame([(ORDERS, "java", "spring-boot", "root", 8080)], model.SERVICES_DDL)
    own = F.col("service") == ORDERS
    none = spark.createDataFrame([], model.ENDPOINTS_DDL), spark.createDataFrame([], model.PARAMS_DDL)
    written = cat.Catalog(services, entities(spark).filter(own), fields(spark).filter(own), *none)
    cat.write_catalog_json(written, str(tmp_path / "out"))
    read = cat.read_catalog_json(spark, str(tmp_path / "out"))
    for name in ("entities", "fields"):
        a, b = getattr(written, name), getattr(read, name)
        assert sorted(map(str, a.select(*b.columns).collect())) == sorted(map(str, b.collect()))


def test_catalog_from_tables_names_nested_structs(spark):
    df = spark.createDataFrame([], "id BIGINT, price DECIMAL(10,2), tags ARRAY<STRING>, buyer STRUCT<name: STRING, lines: ARRAY<STRUCT<sku: STRING>>>, m MAP<STRING, INT>")
    c = cat.catalog_from_tables(spark, "svc", {"T": df})
    got = {(r["entity"], r["name"]): r["type"] for r in c.fields.collect()}
    assert got == {("T", "id"): "integer", ("T", "price"): "decimal", ("T", "tags"): "list<string>", ("T", "buyer"): "ref:T_buyer", ("T", "m"): "object",
                   ("T_buyer", "name"): "string", ("T_buyer", "lines"): "list<ref:T_buyer_lines>", ("T_buyer_lines", "sku"): "string"}


def test_nested_samples(spark):
    got = {r["entity"]: r["sample"] for r in sample_entities(fields(spark), entities(spark)).collect()}
    assert '"orderId": 1713' in got["Order"] and '"orderStatus": "PENDING"' in got["Order"] and '"shipping_city": "shippingCity-14"' in got["Order"]
    assert '"items": [{"sku": ' in got["Order"]


def test_samples_stop_at_depth_three(spark):
    ents = spark.createDataFrame([("s", 0, "Node", "class", "", 1, [])], model.ENTITIES_DDL)
    flds = spark.createDataFrame([("s", "Node", 0, "next", "next", "ref:Node", "", False)], model.FIELDS_DDL)
    (row,) = sample_entities(flds, ents).collect()
    assert row["sample"] == '{"next": {"next": {"next": {"next": null}}}}'


def test_the_first_of_same_named_classes_wins(spark):
    files = spark.createDataFrame([("s", "b.java", "class A { String later; }"), ("s", "a.java", "class A { int first; long second; }"),
                                   ("t", "c.java", "class A { String other; }")], "service string, file string, text string")
    found = sc.extract_java_catalog(files)
    assert sorted((r.service, r.entity, r.file) for r in found.entities.collect()) == [("s", "A", "a.java"), ("s", "A", "b.java"), ("t", "A", "c.java")]
    assert sorted((r.service, r.name) for r in found.fields.collect()) == [("s", "first"), ("s", "second"), ("t", "other")]
    python = spark.createDataFrame([("s", "b.py", "class A(BaseModel):\n    later: str\n"), ("s", "a.py", "class A(BaseModel):\n    first: int\n")], "service string, file string, text string")
    assert [(r.name, r.type) for r in sc.extract_python_catalog(python).fields.collect()] == [("first", "integer")]


def test_a_long_file_is_read_in_time():
    import time

    from crosswalk.sources import declarations
    text = "class A {\n" + "".join(f"\n  // note\n  private String field{i} = \"x;{{\";\n" for i in range(8000)) + "}\n\nclass B {\n int last; }\n"
    start = time.process_time()
    rows = list(declarations.java_declarations(text))
    assert time.process_time() - start < 2 and len(rows) == 8003 and len(text) > 350_000
    assert [r["line"] for r in rows if r["row_kind"] == "class"] == [1, text[:text.index("class B")].count("\n") + 1]


def test_services_of_three_languages_as_documents(spark):
    from crosswalk.sources import declarations
    java = ("@RestController class Web {\n @GetMapping(\"/a\") String get(@PathVariable Long id) { return null; }\n"
            " @GetMapping(\"/b\") String get(@RequestParam int n, Foo skipped, @RequestBody A body) { return null; }\n}\nclass A { int x; String y; }\n")
    rows = [("j", "r1", "Web.java", java), ("j", "r1", "Early.java", "record B(int z) {}"), ("j", "r1", "src/test/T.java", "class T { int t; }"),
            ("j", "r1", "application.properties", "server.port=99"), ("p", "r2", "m.py", PYTHON), ("p", "r2", "bad.py", "def broken(:\n"),
            ("k", "r3", "a.toy", "class A { int only; }"), ("n", "r4", "readme.md", "text"), ("j", "r1", "empty.java", "")]
    files = spark.createDataFrame(rows, "service string, root string, file string, text string").repartition(3)
    services = spark.createDataFrame([("k", "toy", "", "r3", 1), ("j", "java", "spring-boot", "r1", 99)], model.SERVICES_DDL)
    sc.register_extractor("toy", ".toy", declarations.java_declarations)
    try:
        toy, _ = sc.extracted_catalog(files.select("service", "file", "text"), services)
        assert [(r.service, r.entity, r.name) for r in toy.fields.filter("service = 'k'").collect()] == [("k", "A", "only")]
    finally:
        for known in (sc.EXTRACTORS, sc.SUFFIXES, sc.MEANINGS, sc.FRAMEWORKS):
            del known["toy"]
    catalog, errors = sc.parse_services(files)
    documents = {r["name"]: r.asDict(recursive=True) for r in cat.catalog_documents(catalog).collect()}
    assert set(documents) == {"j", "p"}
    j, p = documents["j"], documents["p"]
    assert (j["language"], j["framework"], j["root"], j["port"], p["framework"], p["port"]) == ("java", "spring-boot", "r1", 99, "fastapi", 8000)
    assert [(e["name"], [f["name"] for f in e["fields"]]) for e in j["entities"]] == [("B", ["z"]), ("A", ["x", "y"])]
    assert [(e["path"], [(x["name"], x["location"]) for x in e["params"]]) for e in j["endpoints"]] == [
        ("/a", [("id", "path")]), ("/b", [("n", "query"), ("body", "body")])]
    assert [e["name"] for e in p["entities"]] == ["Tier", "Seat", "Booking"] and [e["path"] for e in p["endpoints"]] == ["/", "/bookings/{booking_id}"]
    assert [f["name"] for f in p["entities"][1]["fields"]] == ["row", "tier", "price"]
    assert [[x["name"] for x in e["params"]] for e in p["endpoints"]] == [["booking_id", "body", "note"]] * 2
    assert {(r.service, r.file, r.error) for r in errors.collect()} == {
        ("p", "bad.py", "SyntaxError"), ("n", None, "ValueError"), ("k", None, "ValueError")}
    ords = sorted((r.service, r.entity_ord) for r in catalog.entities.collect())
    assert ords == [("j", 0), ("j", 1), ("p", 0), ("p", 1), ("p", 2)]
    assert sorted((r.service, r.ep_ord, r.param_ord) for r in catalog.params.filter("service = 'j'").collect()) == [("j", 0, 0), ("j", 1, 0), ("j", 1, 1)]


def test_catalog_of_no_files(spark):
    none = spark.createDataFrame([], "service string, root string, file string, text string")
    catalog, errors = sc.parse_services(none)
    assert cat.catalog_documents(catalog).count() == 0 and errors.count() == 0


def test_files_are_read_by_many_tasks(spark, tmp_path, monkeypatch):
    """Also where the table they come from is one small file, or where one service has them all."""
    seen = []
    monkeypatch.setattr(sc, "written", lambda df, name: seen.append(df.rdd.getNumPartitions()) or df)
    rows = [(k, "Brand#1", k % 5, f"name {k}", "t", 1.0) for k in range(40)]
    spark.createDataFrame(rows, "p_partkey BIGINT, p_brand STRING, p_size INT, p_name STRING, p_type STRING, p_retailprice DOUBLE").coalesce(1).write.parquet(
        str(tmp_path / "part.parquet"))
    assert catalogs.extract_errors(spark, str(tmp_path)).count() == 1
    files = spark.createDataFrame([("s", f"f{i}.py", PYTHON) for i in range(40)], "service STRING, file STRING, text STRING").coalesce(1)
    services = spark.createDataFrame([("s", "python", "fastapi", "s", 8000)], "service STRING, language STRING, framework STRING, root STRING, port INT")
    sc.extracted_catalog(files, services)
    assert [n >= 8 for n in seen if n] == [True, True]  # no file is Java: nothing to read


def test_sample_levels_send_only_references(spark):
    """A level joins the records under it to fields that refer to records; a list uses up a level, below the last is null."""
    rows = [("s", "A", 0, "id", "id", "integer", "", False), ("s", "A", 1, "next", "next", "list<ref:A>", "", False), ("s", "A", 2, "kind", "kind", "ref:K", "", False)]
    ents = [("s", 0, "A", "class", "f", 1, []), ("s", 1, "K", "enum", "f", 2, ["ON"])]
    out = sample_entities(spark.createDataFrame(rows, model.FIELDS_DDL), spark.createDataFrame(ents, model.ENTITIES_DDL))
    (sample,) = [r["sample"] for r in out.collect()]
    assert sample.count('"kind": "ON"') == 2 and sample.count('"next": [{') == 1 and sample.count('"next": [null]') == 1
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert any("Filter" in line and "ref_kind" in line for line in plan)


def test_documents_are_never_rows_on_their_way(spark):
    """They are put together as columns of a table: nothing sorts, joins, shuffles or aggregates them, and a reader of one list gets that one."""
    services = spark.createDataFrame([("s", "java", "f", "r", 1)], model.SERVICES_DDL)
    ents = spark.createDataFrame([("s", 0, "A", "class", "f", 1, [])], model.ENTITIES_DDL)
    eps = spark.createDataFrame([("s", 0, "GET", "/", "h", None, "f", 1)], model.ENDPOINTS_DDL)
    found = cat.catalog_documents(cat.Catalog(services, ents, spark.createDataFrame([], model.FIELDS_DDL), eps, spark.createDataFrame([], model.PARAMS_DDL)))
    plan = found.select("name", F.posexplode("entities"))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Exchange", "Join", "Sort", "Aggregate", "MapInArrow")) and "endpoints" not in plan
    assert found.dtypes[:5] == [("name", "string"), ("language", "string"), ("framework", "string"), ("root", "string"), ("port", "int")]


def test_documents_of_odd_services(spark, monkeypatch):
    """Services that come twice, have no name or no lists, lists without a service, ordinals that repeat, are missing or leave gaps."""
    monkeypatch.setattr(cat, "ROWS_PER_RANGE", 2)
    heads = [("a", "java", "f", "r", 1), ("a", "java", "f", "r2", 2), ("b", "python", None, "r", None), (None, "java", "f", "r", 3), ("c", "java", "f", "r", 4), ("c", "java", "f", "r", 4)]
    ents = [(s, o, n, "class", "f", 1, v) for s, o, n, v in (("a", 70, "Z", []), ("a", 2, "M", ["x"]), ("a", 2, "B", []), ("a", 1 << 40, "Far", None), ("a", -3, "Less", []), ("a", None, "None", []),
                                                              ("gone", 0, "G", []), (None, 0, "N", []), ("c", 0, "C", []))]
    fields = [("a", "M", 1, "y", "y", "string", "t", True), ("a", "M", 0, "x", "x", "string", "t", False), (None, "N", 0, "n", "n", "string", "t", False), ("gone", "G", 0, "g", "g", "string", "t", False)]
    eps = [(s, o, "GET", p, "h", None, "f", 1) for s, o, p in (("a", 1, "/1"), ("a", 0, "/0"), ("b", 0, "/b"), ("gone", 0, "/g"), (None, 0, "/n"))]
    params = [("a", 1, 1, "q", "query", "string"), ("a", 1, 0, "p", "path", "string"), (None, 0, 0, "n", "path", "string")]
    catalog = cat.Catalog(*(spark.createDataFrame(rows, ddl) for rows, ddl in ((heads, model.SERVICES_DDL), (ents, model.ENTITIES_DDL), (fields, model.FIELDS_DDL), (eps, model.ENDPOINTS_DDL), (params, model.PARAMS_DDL))))
    found = [r.asDict(recursive=True) for r in cat.catalog_documents(catalog).collect()]
    assert sorted((r["name"] or "", r["root"], r["port"] or 0) for r in found) == [("", "r", 3), ("a", "r", 1), ("a", "r2", 2), ("b", "r", 0), ("c", "r", 4), ("c", "r", 4)]
    lists = {r["name"]: ([(e["name"], [f["name"] for f in e["fields"]], e["values"]) for e in r["entities"]], [(e["path"], [p["name"] for p in e["params"]]) for e in r["endpoints"]]) for r in found}
    assert lists["a"] == ([("None", [], []), ("Less", [], []), ("B", [], []), ("M", ["x", "y"], ["x"]), ("Z", [], []), ("Far", [], None)], [("/0", []), ("/1", ["p", "q"])])
    assert (lists["b"], lists["c"], lists[None]) == (([], [("/b", [])]), ([("C", [], [])], []), ([], []))


def test_document_of_a_service_that_goes_on_over_batches_and_pages(spark):
    n, long = 200_000, "x" * 40
    services = spark.createDataFrame([("s", "java", "f", "r", 1), ("t", "java", "f", "r", 1)], model.SERVICES_DDL)
    ents = spark.range(n).select(F.lit("s").alias("service"), F.col("id").alias("entity_ord"), F.concat(F.lit(long), "id").alias("entity"), F.lit("class").alias("kind"), F.lit("f").alias("file"),
                                 F.lit(1).alias("line"), F.array().cast("array<string>").alias("values"))
    fields = ents.select("service", "entity", F.lit(0).cast("bigint").alias("field_ord"), F.concat(F.lit("f"), "entity_ord").alias("name"), F.lit("j").alias("json_name"), F.lit("string").alias("type"),
                         F.lit("t").alias("source_type"), F.lit(False).alias("optional")).filter("name NOT LIKE '%7'")
    eps = spark.createDataFrame([("s", 0, "GET", "/", "h", None, "f", 1), ("t", 0, "GET", "/t", "h", None, "f", 1)], model.ENDPOINTS_DDL)
    found = cat.catalog_documents(cat.Catalog(services, ents, fields, eps, spark.createDataFrame([], model.PARAMS_DDL)))
    rows = found.select("name", F.posexplode("entities").alias("ord", "e"))
    assert rows.count() == n
    wrong = rows.filter((F.col("e.name") != F.concat(F.lit(long), "ord")) | (F.size("e.fields") != F.when(F.col("ord") % 10 == 7, 0).otherwise(1))
                        | (F.get("e.fields.name", F.lit(0)) != F.concat(F.lit("f"), "ord")))
    assert wrong.count() == 0
    assert sorted((r.name, r.n, r.p) for r in found.select("name", F.size("entities").alias("n"), F.col("endpoints.path").alias("p")).collect()) == [("s", n, ["/"]), ("t", 0, ["/t"])]
