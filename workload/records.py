"""Records: applying mappings, field checks, repair, routes, rule scans, advisories, closures."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosswalk.operators import apply, check, graph, match, routes, scan
from crosswalk.operators.assign import best_per_group, first_wins, top_n_per_group
from crosswalk.plans.mapping_plan import build_plan
from crosswalk.sources.catalog import catalog_from_tables
from workload.base import CATALOG_SQL, entities, plans, query, table

PROVIDER, CONSUMER = "order-service", "billing-service"
CONSUMER_DDL = ("order_ref BIGINT, client_id BIGINT, amount_due DECIMAL(38,18), currency STRING, placed_at TIMESTAMP_NTZ, "
                "status STRING, city STRING, memo STRING")
PROVIDER_SQL = """prov AS (SELECT o_orderkey AS orderId, o_custkey AS customerId, o_totalprice AS totalAmount, 'USD' AS currencyCode,
o_orderdate AS createdAt, o_orderstatus AS orderStatus, n_name AS shipping_city FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey)"""


def provider_orders(spark, sf):
    orders, customer, nation = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    return (orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(F.col("o_orderkey").alias("orderId"), F.col("o_custkey").alias("customerId"),
                    F.col("o_totalprice").alias("totalAmount"), F.lit("USD").alias("currencyCode"),
                    F.col("o_orderdate").alias("createdAt"), F.col("o_orderstatus").alias("orderStatus"),
                    F.col("n_name").alias("shipping_city")))


def crosswalk_plan(spark, sf):
    """Catalogs of both sides from their Spark schemas, and the plan between them."""
    provider = catalog_from_tables(spark, PROVIDER, {"Order": provider_orders(spark, sf)})
    consumer = catalog_from_tables(spark, CONSUMER, {"OrderRecord": spark.createDataFrame([], CONSUMER_DDL)})
    fields = provider.fields.unionByName(consumer.fields)
    entities_ = provider.entities.unionByName(consumer.entities)
    pairing = spark.createDataFrame([(1, PROVIDER, "Order", CONSUMER, "OrderRecord")],
                                    "plan_id INT, provider_service STRING, provider_entity STRING, consumer_service STRING, consumer_entity STRING")
    plan = build_plan(pairing, fields, entities_, ["plan_id"])
    return plan, fields


FIXED_PLAN = [("order_ref", "orderId"), ("client_id", "customerId"), ("amount_due", "totalAmount"), ("currency", "currencyCode"),
              ("placed_at", "createdAt"), ("status", "orderStatus"), ("city", "shipping_city")]
PROVIDER_TYPES = {"orderId": "integer", "customerId": "integer", "totalAmount": "decimal", "currencyCode": "string",
                  "createdAt": "datetime", "orderStatus": "string", "shipping_city": "string"}
CONSUMER_FIELDS = [{"name": n, "type": t, "source_type": ""} for n, t in (
    ("order_ref", "integer"), ("client_id", "integer"), ("amount_due", "decimal"), ("currency", "string"),
    ("placed_at", "datetime"), ("status", "string"), ("city", "string"), ("memo", "string"))]
CHECKS = [check.FieldCheck(c, p, PROVIDER_TYPES[p]) for c, p in FIXED_PLAN]


def delivered_orders(spark, sf, plan=FIXED_PLAN):
    """What the consumer holds: the mapped orders, some of them changed on the way by their key."""
    orders = apply.apply_mapping(provider_orders(spark, sf), plan, CONSUMER_FIELDS, keep=["orderId"])
    return (orders.filter("orderId % 211 <> 0")
            .withColumn("client_id", F.expr("IF(orderId % 97 = 0, client_id + 1, client_id)"))
            .withColumn("city", F.expr("IF(orderId % 89 = 0, NULL, city)"))
            .withColumn("placed_at", F.expr("IF(orderId % 83 = 0, placed_at + INTERVAL 1 DAY, placed_at)")))


_DELIVERED_SQL = f"""{PROVIDER_SQL}, cmp AS (SELECT orderId, orderId % 211 = 0 AS gone, customerId, orderId % 97 = 0 AS bad_client,
orderId % 89 = 0 AS bad_city, orderId % 83 = 0 AS bad_date FROM prov),
oks AS (SELECT orderId, unnest([{{'f': 'order_ref', 'ok': NOT gone}}, {{'f': 'client_id', 'ok': NOT gone AND NOT bad_client}},
{{'f': 'amount_due', 'ok': NOT gone}}, {{'f': 'currency', 'ok': NOT gone}}, {{'f': 'placed_at', 'ok': NOT gone AND NOT bad_date}},
{{'f': 'status', 'ok': NOT gone}}, {{'f': 'city', 'ok': NOT gone AND NOT bad_city}}]) AS c FROM cmp)"""
_WIRE_SQL = "CASE c.f " + " ".join(f"WHEN '{c}' THEN '{p}'" for c, p in FIXED_PLAN) + " END"
# confidence of each pair, worked out by hand from the matching rules
_CONFIDENCE_SQL = ("CASE c.f WHEN 'order_ref' THEN 0.8 WHEN 'client_id' THEN 0.9 WHEN 'amount_due' THEN 0.9 WHEN 'currency' THEN 1.0 "
                   "WHEN 'placed_at' THEN 0.8 WHEN 'status' THEN 1.0 ELSE 0.667 END::DOUBLE")


@query("crosswalk_orders", f"""WITH {_DELIVERED_SQL} SELECT c.f AS consumer_field, {_WIRE_SQL} AS provider_field,
{_CONFIDENCE_SQL} AS confidence, count(*) AS rows_checked, count(*) FILTER (WHERE c.ok) AS rows_ok FROM oks GROUP BY c.f""")
def crosswalk_orders(spark, sf):
    """The whole way: catalogs from schemas, plan, mapped records, and every mapped value checked against its source."""
    plan, fields = crosswalk_plan(spark, sf)
    pairs = apply.collect_plan(plan.pairs)
    types_of = {r["name"]: r["type"] for r in apply.collect_fields(fields, PROVIDER, "Order")}
    consumer_fields = apply.collect_fields(fields, CONSUMER, "OrderRecord")
    checks = [check.FieldCheck(c, p, types_of[p]) for c, p in pairs]
    provider = provider_orders(spark, sf)
    delivered = (apply.apply_mapping(provider, pairs, consumer_fields, keep=["orderId"]).filter("orderId % 211 <> 0")
                 .withColumn("client_id", F.expr("IF(orderId % 97 = 0, client_id + 1, client_id)"))
                 .withColumn("city", F.expr("IF(orderId % 89 = 0, NULL, city)"))
                 .withColumn("placed_at", F.expr("IF(orderId % 83 = 0, placed_at + INTERVAL 1 DAY, placed_at)")))
    summary = check.field_check_summary(provider, delivered, "orderId", checks)
    return summary.join(F.broadcast(plan.pairs.select("consumer_field", "confidence")), "consumer_field").select(  # as many rows as columns
        "consumer_field", F.col("provider_json").alias("provider_field"), "confidence", "rows_checked", "rows_ok")


@query("apply_mapping", f"""WITH {PROVIDER_SQL} SELECT orderId AS order_ref, customerId AS client_id, totalAmount::DOUBLE AS amount_due,
currencyCode AS currency, createdAt AS placed_at, orderStatus AS status, shipping_city AS city, 'n/a' AS memo FROM prov""")
def apply_mapping(spark, sf):
    mapped = apply.apply_mapping(provider_orders(spark, sf), FIXED_PLAN, CONSUMER_FIELDS, defaults={"memo": F.lit("n/a")})
    return mapped.withColumn("amount_due", F.col("amount_due").cast("double"))


@query("field_checks", f"""WITH {_DELIVERED_SQL} SELECT orderId, m AS method, c.f AS consumer_field, {_WIRE_SQL} AS provider_json, c.ok AS ok
FROM oks CROSS JOIN (VALUES ('get_order'), ('list_orders')) v(m)""")
def field_checks(spark, sf):
    return check.field_checks(provider_orders(spark, sf), delivered_orders(spark, sf), "orderId", CHECKS, ("get_order", "list_orders")).select(
        "orderId", "method", "consumer_field", "provider_json", "ok")


@query("check_rollup", f"""WITH {_DELIVERED_SQL} SELECT c.f AS consumer_field, count(*) FILTER (WHERE c.ok) AS ok_checks, count(*) AS total_checks,
count(*) FILTER (WHERE NOT c.ok) AS failed_checks, bool_and(c.ok) AS passed FROM oks GROUP BY c.f""")
def check_rollup(spark, sf):
    rows = check.field_checks(provider_orders(spark, sf), delivered_orders(spark, sf), "orderId", CHECKS)
    return check.check_rollup(rows, ["consumer_field"])


_DTO = {"Order": ("class", [{"name": n, "json_name": j, "type": t} for n, j, t in (
    ("orderId", "orderId", "integer"), ("orderStatus", "orderStatus", "ref:Status"), ("shippingCity", "shipping_city", "string"),
    ("buyer", "buyer", "ref:Buyer"), ("tags", "tags", "list<string>"), ("neverSent", "neverSent", "decimal"))]),
    "Buyer": ("class", [{"name": n, "json_name": j, "type": t} for n, j, t in (("buyerId", "buyer-id", "integer"), ("nickName", "nickName", "string"))]),
    "Status": ("enum", [])}


@query("project_dto", """SELECT o_orderkey AS order_id, o_orderstatus AS order_status, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'snake' END AS shipping_city,
o_custkey AS buyer_id, NULL AS nick_name, o_orderpriority || ',x' AS tags, NULL::DOUBLE AS never_sent FROM orders""")
def project_dto(spark, sf):
    orders = table(spark, sf, "orders")
    text = F.to_json(F.struct(
        F.col("o_orderkey").alias("orderId"), F.col("o_orderstatus").alias("orderStatus"), F.lit("dropped").alias("extra"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise(F.lit("snake")).alias("shipping_city"),
        F.struct(F.col("o_custkey").alias("buyer-id")).alias("buyer"), F.array("o_orderpriority", F.lit("x")).alias("tags")))
    dto = apply.parse_dto(orders.select(text.alias("body")), "body", "Order", _DTO)
    return dto.select("order_id", "order_status", "shipping_city", "buyer.buyer_id", "buyer.nick_name",
                      F.array_join("tags", ",").alias("tags"), F.col("never_sent").cast("double").alias("never_sent"))


_ENDPOINT = {"method": "CASE c_custkey % 4 WHEN 0 THEN 'POST' ELSE 'GET' END", "handler": "concat('load', c_mktsegment, 'ById')"}


@query("mapped_methods", f"""WITH {CATALOG_SQL}, eps AS (SELECT concat('prov-', c_custkey) AS service, i AS ep_ord, {_ENDPOINT['method']} AS method,
'load' || c_mktsegment || 'ById' AS handler, CASE i WHEN 0 THEN e.entity WHEN 1 THEN 'list<' || e.entity || '>' ELSE 'OrderStatus' END AS returns
FROM customer CROSS JOIN (VALUES (0), (1), (2)) v(i) JOIN ents e ON e.service = concat('prov-', c_custkey) AND e.entity_ord = c_custkey % 2)
SELECT s.plan_id, ep_ord, starts_with(returns, 'list<') AS is_list,
lower(regexp_replace(handler, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) || '_as_' || lower(regexp_replace(s.consumer_entity, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS method_name
FROM plans s JOIN eps ON eps.service = s.provider_service AND replace(replace(returns, 'list<', ''), '>', '') = s.provider_entity WHERE method = 'GET'""")
def mapped_methods(spark, sf):
    ents = entities(spark, sf)
    customers = table(spark, sf, "customer").select(
        F.expr("concat('prov-', c_custkey)").alias("service"), (F.col("c_custkey") % 2).alias("entity_ord"),
        F.expr(_ENDPOINT["method"]).alias("method"), F.expr(_ENDPOINT["handler"]).alias("handler"),
        F.explode(F.sequence(F.lit(0), F.lit(2))).alias("ep_ord"))
    eps = customers.join(ents.select("service", "entity_ord", "entity"), ["service", "entity_ord"]).select(
        "service", "ep_ord", "method", "handler", F.lit("/x").alias("path"),
        F.expr("CASE ep_ord WHEN 0 THEN entity WHEN 1 THEN concat('list<', entity, '>') ELSE 'OrderStatus' END").alias("returns"))
    return apply.mapped_methods(eps, ents, plans(spark, sf), ["plan_id"]).select("plan_id", "ep_ord", "is_list", "method_name")


# ---- choices in order


@query("lookup_first", "SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def lookup_first(spark, sf):
    return first_wins(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice"), ["o_custkey"], ["o_orderkey"])


@query("lookup_entity", f"""WITH {CATALOG_SQL}, named AS (SELECT service, entity, entity_ord, kind FROM ents UNION ALL SELECT service, entity, entity_ord + 10, 'record' FROM ents)
SELECT service, entity, kind, entity_ord FROM named QUALIFY row_number() OVER (PARTITION BY service, entity ORDER BY entity_ord) = 1""")
def lookup_entity(spark, sf):
    ents = entities(spark, sf).select("service", "entity", "entity_ord", "kind")
    again = ents.withColumns({"entity_ord": F.col("entity_ord") + 10, "kind": F.lit("record")})
    return match.lookup_entity(ents.unionByName(again)).select("service", "entity", "kind", "entity_ord")


@query("non_enum_entities", f"WITH {CATALOG_SQL} SELECT service, entity, kind FROM ents WHERE kind <> 'enum'")
def non_enum_entities(spark, sf):
    return match.non_enum_entities(entities(spark, sf)).select("service", "entity", "kind")


@query("top_n_per_group", "SELECT user_id, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank FROM events) WHERE rank <= 3")
def top_n(spark, sf):
    return top_n_per_group(table(spark, sf, "events").select("user_id", "event_id"), ["user_id"], [F.col("event_id")], 3)


@query("best_per_group", """SELECT p_brand, p_partkey, p_size FROM part WHERE p_size > 0
QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) = 1""")
def best_rendition(spark, sf):
    return best_per_group(table(spark, sf, "part").select("p_brand", "p_partkey", "p_size"), ["p_brand"], "p_size", "p_partkey")


# ---- checking and repairing rows

_RULES_SQL = r"""d AS (SELECT doc_id, text, contains(text, chr(9)) OR regexp_matches(text, '[ ]{2,}') AS wide, regexp_matches(text, '(^\s)|(\s$)') AS loose,
length(text) < 40 AS short FROM documents)"""


def _rules():
    return [check.Rule("W1", 1, lambda r: F.contains(r["text"], F.lit("\t")) | r["text"].rlike(" {2,}"), lambda r: F.lit("wide gap")),
            check.Rule("W2", 1, lambda r: r["text"].rlike(r"(^\s)|(\s$)"), lambda r: F.lit("loose edge")),
            check.Rule("L1", 2, lambda r: F.length(r["text"]) < 40, lambda r: F.concat(F.lit("short: "), F.length(r["text"]).cast("string")))]


@query("check_rows", f"""WITH {_RULES_SQL} SELECT doc_id, unnest(CASE WHEN wide OR loose THEN list_filter([CASE WHEN wide THEN 'W1 wide gap' END,
CASE WHEN loose THEN 'W2 loose edge' END], lambda x: x IS NOT NULL) WHEN short THEN ['L1 short: ' || length(text)] ELSE [] END) AS diagnostic FROM d""")
def check_rows(spark, sf):
    return check.check_rows(table(spark, sf, "documents").select("doc_id", "text"), _rules(), ["doc_id"]).select("doc_id", "diagnostic")


_FIXED = r"regexp_replace(replace({0}, chr(9), ' '), '[ ]+', ' ', 'g')"
_FALLBACK = r"CASE WHEN regexp_matches({0}, '(^\s)|(\s$)') THEN regexp_replace({0}, '^\s+|\s+$', '', 'g') ELSE {0} END"
_DIAG = (r"CASE WHEN contains({0}, chr(9)) OR regexp_matches({0}, '[ ]{{2,}}') OR regexp_matches({0}, '(^\s)|(\s$)') THEN "
         r"(CASE WHEN contains({0}, chr(9)) OR regexp_matches({0}, '[ ]{{2,}}') THEN 1 ELSE 0 END + CASE WHEN regexp_matches({0}, '(^\s)|(\s$)') THEN 1 ELSE 0 END) "
         r"WHEN length({0}) < 40 THEN 1 ELSE 0 END")


def _repair_sql(rounds: int = 3) -> str:
    """The rounds written out: t<n> is the text before round n, a<n> after the safe fix."""
    ctes = ["r1 AS (SELECT doc_id, text AS t1 FROM documents)"]
    for n in range(1, rounds + 1):
        ctes.append(f"f{n} AS (SELECT *, {_DIAG.format(f't{n}')} AS d{n}, {_FIXED.format(f't{n}')} AS a{n} FROM r{n})")
        ctes.append(f"g{n} AS (SELECT *, {_DIAG.format(f'a{n}')} AS e{n} FROM f{n})")
        ctes.append(f"r{n + 1} AS (SELECT *, CASE WHEN d{n} = 0 THEN t{n} WHEN e{n} = 0 THEN a{n} ELSE {_FALLBACK.format(f'a{n}')} END AS t{n + 1} FROM g{n})")
    return ", ".join(ctes)


_REPAIR_SQL = _repair_sql()


def _repaired(spark, sf):
    fixes = {"text": lambda r: F.regexp_replace(F.replace(r["text"], F.lit("\t"), F.lit(" ")), " +", " ")}
    fallback = {"text": lambda r: F.when(r["text"].rlike(r"(^\s)|(\s$)"), F.regexp_replace(r["text"], r"^\s+|\s+$", "")).otherwise(r["text"])}
    return check.repair_rounds(table(spark, sf, "documents").select("doc_id", "text"), _rules(), fixes, fallback, ["text"])


@query("repair_rounds", f"""WITH {_REPAIR_SQL}, fin AS (SELECT *, {_DIAG.format('t4')} AS d4 FROM r4)
SELECT doc_id, md5(t4) AS digest, d4 = 0 AS passed, (d1 > 0)::BIGINT + (d2 > 0)::BIGINT + (d3 > 0)::BIGINT AS n_rounds FROM fin""")
def repair_rounds(spark, sf):
    return _repaired(spark, sf).select("doc_id", F.md5("text").alias("digest"), "passed", F.size("rounds").cast("bigint").alias("n_rounds"))


@query("repair_summary", f"""WITH {_REPAIR_SQL}, logs AS (
SELECT 1 AS round, e1 = 0 AS solved, CASE WHEN e1 = 0 THEN d1 ELSE e1 END AS n FROM r4 WHERE d1 > 0 UNION ALL
SELECT 2, e2 = 0, CASE WHEN e2 = 0 THEN d2 ELSE e2 END FROM r4 WHERE d2 > 0 UNION ALL
SELECT 3, e3 = 0, CASE WHEN e3 = 0 THEN d3 ELSE e3 END FROM r4 WHERE d3 > 0)
SELECT round, CASE WHEN solved THEN '{check.SAFE_FIX}' ELSE '{check.FALLBACK}' END AS action, count(*) AS rows, sum(n)::BIGINT AS diagnostics
FROM logs GROUP BY round, solved""")
def repair_summary(spark, sf):
    return check.repair_summary(_repaired(spark, sf))


# ---- routes, scans, advisories

ROUTES = [(0, "GET", "/{lang}/{id}", "byId"), (1, "GET", "/en/{id}", "english"), (2, "POST", "/de/{id}", "german"),
          (3, "POST", "/{lang}/1{id}", "ones"), (4, "POST", "/{lang}/{id}.html", "file"), (5, "PUT", "/fr/825", "fixed")]
_ROUTE_METHOD = "CASE page_id % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'PUT' END"
_ROUTES_SQL = "(VALUES " + ", ".join(f"({o}, '{m}', '{p}', '{h}')" for o, m, p, h in ROUTES) + ") r(ep_ord, method, path, handler)"


def _routed_sql(source: str) -> str:
    return rf"""WITH q AS (SELECT page_id, {_ROUTE_METHOD} AS method, regexp_replace(regexp_replace(url, '^https?://[^/?#]*', ''), '[?#].*$', '') AS p FROM pages),
hits AS (SELECT q.page_id, r.ep_ord, r.path, r.handler FROM q JOIN {source} ON r.method = q.method
AND regexp_matches(q.p, '^' || regexp_replace(r.path, '\{{\w+\}}', '[^/]+', 'g') || '/?$')
QUALIFY row_number() OVER (PARTITION BY q.page_id ORDER BY r.ep_ord) = 1)
SELECT q.page_id, h.ep_ord, h.path AS route, h.handler FROM q LEFT JOIN hits h USING (page_id)"""


def _requests(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url", F.expr(_ROUTE_METHOD).alias("method"))


@query("match_routes", _routed_sql(_ROUTES_SQL))
def match_routes(spark, sf):
    declared = spark.createDataFrame(ROUTES, "ep_ord BIGINT, method STRING, path STRING, handler STRING")
    return routes.match_routes(_requests(spark, sf), declared, ["page_id"])


_MANY = ("SELECT p_partkey AS ep_ord, CASE p_partkey % 2 WHEN 0 THEN 'GET' ELSE 'POST' END AS method, "
         "concat('/', substr('endefres', cast(1 + 2 * (p_partkey % 4) AS INT), 2), '/', cast(p_size * 20 + p_partkey % 20 AS INT), CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '/{rest}' END) AS path, "
         "p_name AS handler FROM part")


@query("match_many_routes", _routed_sql(f"({_MANY}) r"))
def match_many_routes(spark, sf):
    parts = table(spark, sf, "part")
    declared = parts.select(
        F.col("p_partkey").alias("ep_ord"), F.expr("CASE p_partkey % 2 WHEN 0 THEN 'GET' ELSE 'POST' END").alias("method"),
        F.expr("concat('/', substr('endefres', cast(1 + 2 * (p_partkey % 4) AS INT), 2), '/', cast(p_size * 20 + p_partkey % 20 AS INT), "
               "CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '/{rest}' END)").alias("path"), F.col("p_name").alias("handler"))
    return routes.match_routes(_requests(spark, sf), declared, ["page_id"])


@query("delta_scope", "SELECT doc_id, n_chars FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 0)")
def delta_scope(spark, sf):
    delta = table(spark, sf, "labels").filter("quality = 0")
    return scan.delta_scope(table(spark, sf, "documents").select("doc_id", "n_chars"), delta, ["doc_id"])


@query("changed_rows", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 10 = 0 OR (o_orderkey % 7 = 0 AND o_orderstatus <> 'F')")
def changed_rows(spark, sf):
    now = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    before = now.filter("o_orderkey % 10 <> 0").withColumn("o_orderstatus", F.expr("IF(o_orderkey % 7 = 0, 'F', o_orderstatus)"))
    return scan.changed_rows(now, before, ["o_orderkey"]).select("o_orderkey", "o_orderstatus")


RULES = [("hex-token", "token = \"[0-9a-f]{40}\""), ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[a-z]{2,}"), ("license", "(?i)license"),
         ("eval-call", r"\beval\("), ("phone", r"\+?\d{3}[- ]\d{3}[- ]\d{4}"), ("markup", "<[a-z]+>"), ("ends-en", "en\\.$")]


@query("scan_rules", "SELECT doc_id, rule, line FROM (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) "
       "JOIN (VALUES " + ", ".join(f"('{r}', '{p}')" for r, p in RULES) + ") v(rule, pattern) ON regexp_matches(t, pattern)")
def scan_rules(spark, sf):
    return scan.scan_rules(table(spark, sf, "documents").select("doc_id", "text"), RULES, ["doc_id"])


# packages: one per line item, versions out of its numbers; advisories: one per part
_RANGE = "cast(floor(p_partkey / 97) AS INT)"  # a name with its range of parts, so that results grow with the tables
_PKG = {"name": f"concat(replace(p_name, ' ', CASE WHEN l_orderkey % 2 = 0 THEN '_' ELSE '.' END), '-', {_RANGE})",
        "version": "concat(l_linenumber, '.', cast(l_quantity AS INT), '.', l_suppkey % 10)"}
_ADV = "concat('ADV-', p_partkey)"


@query("match_advisories", f"""WITH pkgs AS (SELECT l_orderkey, l_linenumber, l_partkey, {_PKG['name']} AS name, {_PKG['version']} AS version
FROM lineitem JOIN part ON l_partkey = p_partkey),
adv AS (SELECT {_ADV} AS advisory, upper(concat(replace(p_name, ' ', '-'), '-', {_RANGE})) AS name, [(p_size % 5) + 1, p_size, 0] AS f,
CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE [(p_size % 5) + 1, p_size + 3, 5] END AS t FROM part)
SELECT l_orderkey, l_linenumber, l_partkey, advisory, advisory || ' ' || p.name || '@' || version AS item FROM pkgs p JOIN adv a
ON lower(regexp_replace(p.name, '[-_.]+', '-', 'g')) = lower(a.name)
AND list_transform(string_split(version, '.'), lambda x: x::INT) >= f AND (t IS NULL OR list_transform(string_split(version, '.'), lambda x: x::INT) < t)""")
def match_advisories(spark, sf):
    part = table(spark, sf, "part")
    pkgs = table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey", "l_linenumber", "l_partkey", *[F.expr(t).alias(n) for n, t in _PKG.items()])
    adv = part.select(
        F.expr(_ADV).alias("advisory"), F.expr(f"upper(concat(replace(p_name, ' ', '-'), '-', {_RANGE}))").alias("name"),
        F.expr("concat(p_size % 5 + 1, '.', p_size, '.0')").alias("introduced"),
        F.expr("IF(p_partkey % 3 = 0, NULL, concat(p_size % 5 + 1, '.', p_size + 3, '.5'))").alias("fixed"))
    return scan.match_advisories(pkgs, adv, ["l_orderkey", "l_linenumber", "l_partkey"])


# ---- closures

_REQ = {"a": "concat('pkg_', doc_id)", "b": "concat('Pkg.', doc_id // 2, ' >=1')"}
_CLOSURE_SQL = """WITH RECURSIVE e AS (SELECT doc_id AS s, doc_id // 2 AS d FROM documents WHERE doc_id % 5 <> 0 UNION ALL
SELECT doc_id // 3, doc_id FROM documents WHERE doc_id % 40 = 0),
known AS (SELECT doc_id AS k, n_chars FROM documents WHERE doc_id % 11 <> 3),
walk AS (SELECT k FROM known WHERE k % 13 = 0 UNION SELECT e.d FROM walk w JOIN e ON e.s = w.k JOIN known n ON n.k = e.d)"""


def _closure(spark, sf):
    docs = table(spark, sf, "documents")
    packages = docs.filter("doc_id % 11 <> 3").select(F.expr("concat('pkg-', doc_id)").alias("name"), F.expr("concat('1.', n_chars)").alias("version"))
    down = docs.filter("doc_id % 5 <> 0").select(F.expr("concat('pkg_', doc_id)").alias("name"), F.expr("concat('Pkg.', doc_id div 2, ' >=1')").alias("requirement"))
    back = docs.filter("doc_id % 40 = 0").select(F.expr("concat('pkg_', doc_id div 3)").alias("name"), F.expr("concat('PKG--', doc_id, '; python_version > 3')").alias("requirement"))
    extra = docs.select(F.expr("concat('pkg_', doc_id)").alias("name"), F.expr("concat('pkg-', doc_id + 1, '; extra == \"x\"')").alias("requirement"))
    roots = docs.filter("doc_id % 13 = 0").select(F.expr("concat('pkg.', doc_id)").alias("name"))
    return graph.dependency_closure(packages, down.unionByName(back).unionByName(extra), roots)


@query("dependency_closure", f"{_CLOSURE_SQL} SELECT 'pkg-' || k AS name, '1.' || n_chars AS version FROM walk JOIN known USING (k)")
def dependency_closure(spark, sf):
    return _closure(spark, sf)


@query("sorted_pins", f"{_CLOSURE_SQL} SELECT 'pkg-' || k AS name, 'pkg-' || k || '==1.' || n_chars AS pin FROM walk JOIN known USING (k) ORDER BY 1")
def sorted_pins(spark, sf):
    return graph.sorted_pins(_closure(spark, sf))


# entities per supplier: a tree of references over five classes, an enum, and for some suppliers a cycle
_EDGES = [("A", "B"), ("A", "C"), ("B", "D"), ("C", "D"), ("D", "E"), ("E", "Kind"), ("A", "A")]
_EDGE_SQL = " UNION ALL ".join(f"SELECT s_suppkey, '{a}' AS src, '{b}' AS dst FROM supplier" for a, b in _EDGES)


@query("entity_closure", f"""WITH RECURSIVE ed AS (SELECT * FROM ({_EDGE_SQL} UNION ALL SELECT s_suppkey, 'E', 'D' FROM supplier WHERE s_suppkey % 4 = 0) WHERE src <> dst AND dst <> 'Kind'),
roots AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS root FROM supplier),
reach AS (SELECT s_suppkey, root, root AS entity FROM roots UNION SELECT r.s_suppkey, r.root, e.dst FROM reach r JOIN ed e ON e.s_suppkey = r.s_suppkey AND e.src = r.entity),
paths AS (SELECT s_suppkey, src AS top, dst, 1 AS n FROM ed WHERE s_suppkey % 4 <> 0 UNION ALL
SELECT p.s_suppkey, p.top, e.dst, n + 1 FROM paths p JOIN ed e ON e.s_suppkey = p.s_suppkey AND e.src = p.dst),
lv AS (SELECT s_suppkey, top, max(n) AS level FROM paths GROUP BY ALL)
SELECT concat('svc-', r.s_suppkey) AS service, root, entity, CASE WHEN r.s_suppkey % 4 = 0 THEN NULL ELSE coalesce(l.level, 0) END AS level
FROM reach r LEFT JOIN lv l ON l.s_suppkey = r.s_suppkey AND l.top = r.entity""")
def entity_closure(spark, sf):
    suppliers = table(spark, sf, "supplier").select(F.expr("concat('svc-', s_suppkey)").alias("service"), "s_suppkey")
    edge = F.explode(F.array(*[F.struct(F.lit(a).alias("entity"), F.lit(f"list<ref:{b}>" if b == "D" else f"ref:{b}").alias("type")) for a, b in _EDGES]))
    fields = suppliers.select("service", edge.alias("e")).select("service", "e.entity", "e.type").unionByName(
        suppliers.filter("s_suppkey % 4 = 0").select("service", F.lit("E").alias("entity"), F.lit("ref:D").alias("type")))
    kinds = F.explode(F.array(*[F.struct(F.lit(i).cast("bigint").alias("entity_ord"), F.lit(n).alias("entity"), F.lit("enum" if n == "Kind" else "class").alias("kind"))
                                for i, n in enumerate(["A", "B", "C", "D", "E", "Kind"])]))
    ents = suppliers.select("service", kinds.alias("k")).select("service", "k.*")
    roots = suppliers.select("service", F.expr("CASE s_suppkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END").alias("root"))
    return graph.entity_closure(ents, fields, roots)
