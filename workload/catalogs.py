"""Catalogs: nested documents, generated source files, whole-tree facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosswalk import model
from crosswalk.sources import catalog as cat
from crosswalk.sources import source_code
from workload.base import CATALOG_SQL, entities, fields, query, table


def _catalog(spark, sf):
    services = table(spark, sf, "customer").select(
        F.expr("concat('prov-', c_custkey)").alias("service"), F.lit("java").alias("language"), F.lit("spring-boot").alias("framework"),
        F.lit("root").alias("root"), F.lit(8080).alias("port"))
    prov = F.col("service").startswith("prov-")
    eps = services.select("service", F.explode(F.array(F.lit(0), F.lit(1))).alias("ep_ord")).select(
        "service", F.col("ep_ord").cast("bigint").alias("ep_ord"), F.lit("GET").alias("method"), F.expr("concat('/x/', ep_ord)").alias("path"),
        F.lit("h").alias("handler"), F.lit("string").alias("returns"), F.lit("f").alias("file"), F.lit(1).alias("line"))
    params = eps.filter("ep_ord = 1").select("service", "ep_ord", F.lit(0).alias("param_ord"), F.lit("q").alias("name"),
                                             F.lit("query").alias("location"), F.lit("string").alias("type"))
    return cat.Catalog(services, entities(spark, sf).filter(prov), fields(spark, sf).filter(prov), eps, params)


@query("catalog_json", f"WITH {CATALOG_SQL} SELECT service, entity, field_ord, name, json_name, type, source_type FROM flds WHERE service LIKE 'prov-%'")
def catalog_json(spark, sf):
    """The catalog as JSON documents and back."""
    documents = cat.catalog_documents(_catalog(spark, sf))
    text = documents.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("t"))
    again = cat.catalog_from_json(text.select(F.from_json("t", model.SERVICE_JSON_DDL).alias("d")).select("d.*"))
    return again.fields.select("service", "entity", "field_ord", "name", "json_name", "type", "source_type")


@query("catalog_documents", f"""WITH {CATALOG_SQL}, e AS (SELECT service, count(*) AS n FROM ents WHERE service LIKE 'prov-%' GROUP BY ALL)
SELECT service AS name, n AS n_entities, 2 AS n_endpoints, 'q' AS param FROM e""")
def catalog_documents(spark, sf):
    d = cat.catalog_documents(_catalog(spark, sf))
    return d.select("name", F.size("entities").cast("bigint").alias("n_entities"), F.size("endpoints").cast("bigint").alias("n_endpoints"),
                    F.expr("endpoints[1].params[0].name").alias("param"))


@query("known_types", f"WITH {CATALOG_SQL} SELECT DISTINCT service, entity AS name FROM ents")
def known_types(spark, sf):
    return cat.known_types(entities(spark, sf))


@query("service_summary", f"""WITH {CATALOG_SQL} SELECT e.service, e.entity, e.kind, count(f.name) AS n_fields FROM ents e
LEFT JOIN flds f ON f.service = e.service AND f.entity = e.entity WHERE e.service LIKE 'prov-%' GROUP BY ALL""")
def service_summary(spark, sf):
    return cat.service_summary(_catalog(spark, sf))


@query("service_counts", f"""WITH {CATALOG_SQL} SELECT service, count(*) AS n_entities, 2 AS n_endpoints FROM ents WHERE service LIKE 'prov-%' GROUP BY ALL""")
def service_counts(spark, sf):
    c = _catalog(spark, sf)
    return cat.service_counts(c.services, c.entities, c.endpoints)


# a source tree per customer, with files named by its orders
_TREE = "CASE o_custkey % 4 + o_orderkey % 3 WHEN 0 THEN concat('src/A', o_orderkey, '.java') WHEN 1 THEN concat('app/b', o_orderkey, '.py') WHEN 2 THEN 'requirements.txt' WHEN 3 THEN 'docs/pom.xml' ELSE concat('web/', o_orderkey, '.ts') END"


@query("detect_language", f"""WITH f AS (SELECT o_custkey AS root, {_TREE} AS path FROM orders),
g AS (SELECT root, bool_or(path LIKE '%.java' OR path IN ('pom.xml', 'build.gradle')) AS j, bool_or(path LIKE '%.py' OR path IN ('pyproject.toml', 'requirements.txt')) AS p FROM f GROUP BY ALL)
SELECT root, CASE WHEN j THEN 'java' WHEN p THEN 'python' END AS language,
CASE WHEN NOT j AND NOT p THEN 'no supported language found in ' || root || ' (supported: java, python)' END AS error FROM g""")
def detect_language(spark, sf):
    files = table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("root"), F.expr(_TREE).alias("path"))
    return cat.detect_language(files).withColumn("root", F.col("root").cast("bigint"))


@query("extract_port", """WITH c AS (SELECT concat('svc-', s_suppkey) AS service, s_suppkey AS k FROM supplier)
SELECT service, CASE WHEN k % 2 = 0 THEN CASE WHEN k % 4 = 0 THEN 9000 + k WHEN k % 6 = 0 THEN 7000 + k ELSE 8080 END
ELSE CASE WHEN k % 3 = 0 THEN 5000 + k ELSE 8000 END END AS port FROM c""")
def extract_port(spark, sf):
    files = table(spark, sf, "supplier").select("s_suppkey", F.explode(F.array(*[F.struct(F.lit(n).alias("path"), F.expr(t).alias("text")) for n, t in (
        ("a/application.properties", "IF(s_suppkey % 4 = 0, concat('x=1\nserver.port = ', 9000 + s_suppkey, '\n'), '#server.port=1')"),
        ("b/application.yml", "IF(s_suppkey % 6 = 0, concat('server:\n  port: ', 7000 + s_suppkey), 'server:\n  ssl: 1')"),
        ("app/main.py", "IF(s_suppkey % 3 = 0, concat('PORT = int(os.getenv(\"PORT\", \"', 5000 + s_suppkey, '\"))'), 'pass')"))])).alias("f"))
    return cat.extract_port(files.select(F.expr("concat('svc-', s_suppkey)").alias("service"),
                                         F.expr("IF(s_suppkey % 2 = 0, 'java', 'python')").alias("language"), "f.path", "f.text"))


_FILE = "concat(CASE p_size % 5 WHEN 0 THEN 'tests/' WHEN 1 THEN 'app/venv/' WHEN 2 THEN 'app/mytests/' ELSE 'app/' END, p_type, CASE WHEN p_partkey % 3 = 0 THEN '.pyc' ELSE '.py' END)"


@query("select_source_files", "SELECT p_partkey FROM part WHERE p_size % 5 NOT IN (0, 1) AND p_partkey % 3 <> 0")
def select_source_files(spark, sf):
    files = table(spark, sf, "part").select("p_partkey", F.expr(_FILE).alias("file"))
    return source_code.select_source_files(files, "python").select("p_partkey")


# one generated source file per part, one service per brand
_PY_FILE = """concat('from x import BaseModel, Field\n\nclass Size', p_size, '(str, Enum):\n    A = 1\n    B = 2\n\nclass Part', p_partkey,
'(', IF(p_partkey % 4 = 0, 'object', 'BaseModel'), '):\n    _hidden: int = 0\n    part_key: int = Field(alias="partKey")\n    size: Size', p_size,
'\n    tags: list[str] | None\n    price: Decimal = 1\n\n@app.get("/parts/{part_key}", response_model=list[Part', p_partkey,
'])\ndef read', p_partkey, '(part_key: int, body: Part', p_partkey, ', q: str = ""):\n    return []\n', IF(p_partkey % 50 = 0, 'def broken(:\n', ''))"""


def _sources(spark, sf, text, suffix):
    # each part becomes a file to parse: the keys are spread before the texts are made, the table may be one small file
    keys = table(spark, sf, "part").select("p_brand", "p_partkey", "p_size")
    return keys.repartition(4 * spark.sparkContext.defaultParallelism, *keys.columns).select(F.col("p_brand").alias("service"), F.expr(f"concat('m', p_partkey, '{suffix}')").alias("file"),
                                           F.expr(text).alias("text"))


@query("extract_python_fields", """SELECT p_brand AS service, 'Part' || p_partkey AS entity, f AS name, CASE f WHEN 'part_key' THEN 'partKey' ELSE f END AS json_name,
CASE f WHEN 'part_key' THEN 'integer' WHEN 'size' THEN 'ref:Size' || p_size WHEN 'tags' THEN 'list<string>' ELSE 'decimal' END AS type,
CASE f WHEN 'part_key' THEN 'int' WHEN 'size' THEN 'Size' || p_size WHEN 'tags' THEN 'list[str] | None' ELSE 'Decimal' END AS source_type, f <> 'size' AS optional
FROM part CROSS JOIN (VALUES ('part_key'), ('size'), ('tags'), ('price')) v(f) WHERE p_partkey % 4 <> 0 AND p_partkey % 50 <> 0""")
def extract_python_fields(spark, sf):
    return source_code.extract_python_catalog(_sources(spark, sf, _PY_FILE, ".py")).fields.select(
        "service", "entity", "name", "json_name", "type", "source_type", "optional")


@query("extract_python_entities", """SELECT p_brand AS service, 'm' || p_partkey || '.py' AS file, 'Size' || p_size AS entity, 'enum' AS kind, 3 AS line, 'A,B' AS enum_values FROM part WHERE p_partkey % 50 <> 0
UNION ALL SELECT p_brand, 'm' || p_partkey || '.py', 'Part' || p_partkey, 'class', 7, '' FROM part WHERE p_partkey % 50 <> 0 AND p_partkey % 4 <> 0""")
def extract_python_entities(spark, sf):
    return source_code.extract_python_catalog(_sources(spark, sf, _PY_FILE, ".py")).entities.select(
        "service", "file", "entity", "kind", "line", F.array_join("values", ",").alias("enum_values"))


@query("extract_python_endpoints", """SELECT p_brand AS service, 'GET' AS method, '/parts/{part_key}' AS path, 'read' || p_partkey AS handler,
'list<Part' || p_partkey || '>' AS returns, 15 AS line FROM part WHERE p_partkey % 50 <> 0""")
def extract_python_endpoints(spark, sf):
    return source_code.extract_python_catalog(_sources(spark, sf, _PY_FILE, ".py")).endpoints.select(
        "service", "method", "path", "handler", "returns", "line")


@query("extract_python_params", """SELECT p_brand AS service, 'read' || p_partkey AS handler, n AS name, CASE n WHEN 'part_key' THEN 'path' WHEN 'body' THEN 'body' ELSE 'query' END AS location,
CASE n WHEN 'part_key' THEN 'integer' WHEN 'body' THEN 'ref:Part' || p_partkey ELSE 'string' END AS type FROM part CROSS JOIN (VALUES ('part_key'), ('body'), ('q')) v(n) WHERE p_partkey % 50 <> 0""")
def extract_python_params(spark, sf):
    return source_code.extract_python_catalog(_sources(spark, sf, _PY_FILE, ".py")).params.select("service", "handler", "name", "location", "type")


@query("extract_errors", "SELECT p_brand AS service, 'm' || p_partkey || '.py' AS file, 'SyntaxError' AS error FROM part WHERE p_partkey % 50 = 0")
def extract_errors(spark, sf):
    return source_code.extract_python_catalog(_sources(spark, sf, _PY_FILE, ".py")).errors.select("service", "file", "error")


_JAVA_FILE = """concat('package x; // class Fake {\n/* class Other { */\n@Data\npublic class Part', p_partkey, ' {\n  private static final int MAX = 3;\n  private Long partKey;\n  @JsonProperty("part_size")\n  private Size', p_size,
' size = Size', p_size, '.of("a;{");\n  @JsonIgnore private String secret;\n  private List<Optional<String>> tags = new ArrayList<>();\n  enum Size', p_size, ' { SMALL(1), BIG { int f() { return 2; } }; int n; }\n',
IF(p_partkey % 3 = 0, concat('  record Pair', p_partkey, '(@JsonProperty("l") int left, BigDecimal[] right) {}\n'), ''), '}\n\n@RestController\n@RequestMapping("/api/")\nclass Web', p_partkey,
' {\n  private final Part', p_partkey, ' p;\n  @GetMapping("/{id}/")\n  public List<Part', p_partkey, '> list(@PathVariable Long id, @RequestParam(required = false) String q, Foo other) { if (x) { return null; } }\n}\n')"""


@query("extract_java_fields", """SELECT p_brand AS service, 'Part' || p_partkey AS entity, f AS name, CASE f WHEN 'size' THEN 'part_size' ELSE f END AS json_name,
CASE f WHEN 'partKey' THEN 'integer' WHEN 'size' THEN 'ref:Size' || p_size ELSE 'list<string>' END AS type,
CASE f WHEN 'partKey' THEN 'Long' WHEN 'size' THEN 'Size' || p_size ELSE 'List<Optional<String>>' END AS source_type FROM part CROSS JOIN (VALUES ('partKey'), ('size'), ('tags')) v(f)
UNION ALL SELECT p_brand, 'Pair' || p_partkey, f, CASE f WHEN 'left' THEN 'l' ELSE f END, CASE f WHEN 'left' THEN 'integer' ELSE 'list<decimal>' END, CASE f WHEN 'left' THEN 'int' ELSE 'BigDecimal[]' END
FROM part CROSS JOIN (VALUES ('left'), ('right')) v(f) WHERE p_partkey % 3 = 0""")
def extract_java_fields(spark, sf):
    return source_code.extract_java_catalog(_sources(spark, sf, _JAVA_FILE, ".java")).fields.select(
        "service", "entity", "name", "json_name", "type", "source_type")


@query("extract_java_entities", """SELECT p_brand AS service, 'Part' || p_partkey AS entity, 'class' AS kind, 3 AS line, '' AS enum_values FROM part
UNION ALL SELECT p_brand, 'Size' || p_size, 'enum', 11, 'SMALL,BIG' FROM part UNION ALL SELECT p_brand, 'Pair' || p_partkey, 'record', 12, '' FROM part WHERE p_partkey % 3 = 0""")
def extract_java_entities(spark, sf):
    return source_code.extract_java_catalog(_sources(spark, sf, _JAVA_FILE, ".java")).entities.select(
        "service", "entity", "kind", "line", F.array_join("values", ",").alias("enum_values"))


@query("extract_java_endpoints", """SELECT p_brand AS service, 'GET' AS method, '/api/{id}' AS path, 'list' AS handler, 'list<Part' || p_partkey || '>' AS returns FROM part""")
def extract_java_endpoints(spark, sf):
    return source_code.extract_java_catalog(_sources(spark, sf, _JAVA_FILE, ".java")).endpoints.select("service", "method", "path", "handler", "returns")


@query("extract_java_params", """SELECT p_brand AS service, 'm' || p_partkey || '.java' AS file, 'list' AS handler, n AS name, CASE n WHEN 'id' THEN 'path' ELSE 'query' END AS location,
CASE n WHEN 'id' THEN 'integer' ELSE 'string' END AS type FROM part CROSS JOIN (VALUES ('id'), ('q')) v(n)""")
def extract_java_params(spark, sf):
    return source_code.extract_java_catalog(_sources(spark, sf, _JAVA_FILE, ".java")).params.select("service", "file", "handler", "name", "location", "type")


# both trees of a brand: Java sources with a configuration file, Python sources with files that cannot be read
@query("extracted_catalog", """WITH j AS (SELECT 'java-' || p_brand AS name, 'java' AS language, 'spring-boot' AS framework, 9000 + substr(p_brand, 7)::INT AS port,
  'm' || p_partkey || '.java' AS file, p_partkey AS k, p_size AS z FROM part),
p AS (SELECT 'python-' || p_brand AS name, 'python' AS language, 'fastapi' AS framework, 8000 AS port, 'm' || p_partkey || '.py' AS file, p_partkey AS k, p_size AS z
  FROM part WHERE p_partkey % 50 <> 0),
e AS (SELECT name, language, framework, port, file, 0 AS seq, 'Part' || k AS item, 'partKey' AS first_part, 3 AS n FROM j UNION ALL SELECT name, language, framework, port, file, 1, 'Size' || z, NULL, 0 FROM j
  UNION ALL SELECT name, language, framework, port, file, 2, 'Pair' || k, 'left', 2 FROM j WHERE k % 3 = 0
  UNION ALL SELECT name, language, framework, port, file, 0, 'Size' || z, NULL, 0 FROM p UNION ALL SELECT name, language, framework, port, file, 1, 'Part' || k, 'part_key', 4 FROM p WHERE k % 4 <> 0),
r AS (SELECT name, language, framework, port, file, 'list' AS item, 'id' AS first_part, 2 AS n FROM j UNION ALL SELECT name, language, framework, port, file, 'read' || k, 'part_key', 3 FROM p)
SELECT name, language, framework, port, 'entity' AS what, row_number() OVER (PARTITION BY name ORDER BY file, seq) - 1 AS ord, item, first_part, n FROM e
UNION ALL SELECT name, language, framework, port, 'endpoint', row_number() OVER (PARTITION BY name ORDER BY file) - 1, item, first_part, n FROM r""")
def extracted_catalog(spark, sf):
    """Source trees to service documents: what each document lists, in its order."""
    def tree(language, text, suffix):
        return _sources(spark, sf, text, suffix).withColumn("service", F.concat(F.lit(language + "-"), "service"))
    settings = table(spark, sf, "part").select(F.concat(F.lit("java-"), "p_brand").alias("service"), F.lit("application.properties").alias("file"),
                                               F.expr("concat('server.port=', 9000 + cast(substr(p_brand, 7) AS INT))").alias("text")).distinct()
    files = tree("java", _JAVA_FILE, ".java").unionByName(tree("python", _PY_FILE, ".py")).unionByName(settings)
    catalog, _ = source_code.parse_services(files.withColumn("root", F.col("service")))
    documents = cat.catalog_documents(catalog)

    def listed(what, items, item, parts):
        rows = documents.select("name", "language", "framework", "port", F.lit(what).alias("what"), F.posexplode(items).alias("ord", "i"))
        return rows.select("name", "language", "framework", "port", "what", "ord", F.col(f"i.{item}").alias("item"),
                           F.get(F.col(f"i.{parts}.name"), F.lit(0)).alias("first_part"), F.size(f"i.{parts}").alias("n"))
    return listed("entity", "entities", "name", "fields").unionByName(listed("endpoint", "endpoints", "handler", "params"))
