"""Registry of the queries, table access, and the catalogs derived from the customer table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(words: str, index: str) -> str:
    """Word number ``index`` (from 0) of a comma-separated list, as SQL both engines read."""
    return f"split_part('{words}', ',', cast({index} AS INT) + 1)"


# Two services per customer, a provider and a consumer, each with two entities whose fields are chosen by the keys.
PROVIDER_NAMES = ("orderId,customerId,totalAmount,currencyCode,createdAt,orderStatus,shippingCity,unitPrice,contactEmail,"
                  "phoneNumber,itemCount,modifiedOn,accountName")
PROVIDER_WIRES = ("orderId,cust_no,totalAmount,currency,created_at,orderStatus,shipping_city,unit_cost,email,phone,qty,"
                  "modifiedOn,account_title")
PROVIDER_TYPES = ("integer,integer,decimal,string,datetime,ref:OrderStatus,string,decimal,string,list<string>,integer,"
                  "datetime,string")
CONSUMER_NAMES = ("order_ref,client_id,amount_due,currency,placed_at,status,city,price_value,mail,mobile_no,quantity,"
                  "changed_at,label")
CONSUMER_TYPES = "integer,integer,decimal,string,datetime,string,string,decimal,string,list<string>,integer,date,string"
PROVIDER_ENTITIES = "Order,OrderItem,Customer,Account,Invoice"
CONSUMER_ENTITIES = "OrderRecord,ClientRecord,Invoice,LineItem,Booking"
N_WORDS, P_FIELDS, C_FIELDS = 13, 7, 6

P_IDX = f"((c_custkey * 5 + e * 4 + i * (1 + c_nationkey % 12)) % {N_WORDS})"
C_IDX = f"((c_custkey * 3 + e * 4 + i * (1 + c_custkey % 12)) % {N_WORDS})"
P_ENTITY = pick(PROVIDER_ENTITIES, "(c_custkey + e * 2) % 5")
C_ENTITY = pick(CONSUMER_ENTITIES, "(c_custkey + c_nationkey + e * 2) % 5")
HAS_STATUS = "c_custkey % 3 <> 0"
FIELD_EXPRS = {
    "provider": {"service": "concat('prov-', c_custkey)", "entity": P_ENTITY, "name": pick(PROVIDER_NAMES, P_IDX),
                 "json_name": pick(PROVIDER_WIRES, P_IDX), "type": pick(PROVIDER_TYPES, P_IDX),
                 "source_type": f"CASE WHEN {P_IDX} % 2 = 0 THEN upper({pick(PROVIDER_TYPES, P_IDX)}) ELSE '' END"},
    "consumer": {"service": "concat('cons-', c_custkey)", "entity": C_ENTITY, "name": pick(CONSUMER_NAMES, C_IDX),
                 "json_name": pick(CONSUMER_NAMES, C_IDX), "type": pick(CONSUMER_TYPES, C_IDX), "source_type": "''"},
}


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    # each customer becomes 26 fields: the two keys are spread first, the table may be one small file
    keys = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    rows = (keys.repartition(spark.sparkContext.defaultParallelism, "c_custkey")
            .withColumn("e", F.explode(F.sequence(F.lit(0), F.lit(1))))
            .withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(P_FIELDS + C_FIELDS - 1))))
            .withColumn("i", F.expr(f"IF(k < {P_FIELDS}, k, k - {P_FIELDS})")))

    def of_role(name: str) -> Column:
        """The provider's fields come first. One pass makes both, as each scan of the table costs the driver a broadcast."""
        return F.expr(f"CASE WHEN k < {P_FIELDS} THEN {FIELD_EXPRS['provider'][name]} ELSE {FIELD_EXPRS['consumer'][name]} END").alias(name)

    return rows.select(of_role("service"), of_role("entity"), F.col("i").cast("bigint").alias("field_ord"), of_role("name"),
                       of_role("json_name"), of_role("type"), of_role("source_type"), F.lit(False).alias("optional"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    # number k of a service pair's entities: two of the provider, two of the consumer, the enum; one pass makes all
    rows = (table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
            .filter(f"k < 4 OR {HAS_STATUS}").withColumn("e", F.col("k") % 2))
    provider, consumer = FIELD_EXPRS["provider"], FIELD_EXPRS["consumer"]
    return rows.select(
        F.expr(f"CASE WHEN k IN (2, 3) THEN {consumer['service']} ELSE {provider['service']} END").alias("service"),
        F.expr("IF(k = 4, 2, e)").cast("bigint").alias("entity_ord"),
        F.expr(f"CASE WHEN k < 2 THEN {provider['entity']} WHEN k < 4 THEN {consumer['entity']} ELSE 'OrderStatus' END").alias("entity"),
        F.expr("IF(k = 4, 'enum', 'class')").alias("kind"),
        F.expr("IF(k = 4, array('PENDING', 'PAID', 'SHIPPED'), cast(array() AS ARRAY<STRING>))").alias("values"),
        F.lit("model").alias("file"), F.lit(1).alias("line"))


def pairings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One service pair per customer."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("pairing_id"), F.expr("concat('prov-', c_custkey)").alias("provider_service"),
        F.expr("concat('cons-', c_custkey)").alias("consumer_service"))


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entity pair per customer: the first entity on both sides."""
    return table(spark, sf_dir, "customer").withColumn("e", F.lit(0)).select(
        F.col("c_custkey").alias("plan_id"), F.expr("concat('prov-', c_custkey)").alias("provider_service"),
        F.expr(P_ENTITY).alias("provider_entity"), F.expr("concat('cons-', c_custkey)").alias("consumer_service"),
        F.expr(C_ENTITY).alias("consumer_entity"))


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed pairs by key: some fit, some name unknown fields, clash in type or use a field twice."""
    rows = table(spark, sf_dir, "customer").withColumn("e", F.lit(0)).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return rows.select(F.col("c_custkey").alias("plan_id"), F.col("i").cast("bigint").alias("ord"),
                       *[F.expr(text).alias(name) for name, text in PROPOSAL_EXPRS.items()])


_PROPOSED_C = f"((c_custkey * 3 + ((i + c_custkey) % 3) * (1 + c_custkey % 12)) % {N_WORDS})"
_PROPOSED_P = f"((c_custkey * 5 + ((i * 2 + c_custkey) % {P_FIELDS}) * (1 + c_nationkey % 12)) % {N_WORDS})"
PROPOSAL_EXPRS = {
    "consumer_field": pick(CONSUMER_NAMES, _PROPOSED_C),
    "provider_field": f"CASE WHEN (c_custkey + i) % 7 = 0 THEN 'invented' ELSE {pick(PROVIDER_NAMES, _PROPOSED_P)} END",
    "confidence": "CASE WHEN (c_custkey + i) % 5 = 0 THEN NULL ELSE cast((c_custkey * 37 + i * 11) % 1000 AS DOUBLE) / 1000 END",
    "reason": "CASE WHEN i % 2 = 0 THEN NULL ELSE concat('proposed ', i) END",
}


def _sql_fields(role: str, n: int) -> str:
    x = FIELD_EXPRS[role]
    ords = ", ".join(f"({k})" for k in range(n))
    return (f"SELECT {x['service']} AS service, {x['entity']} AS entity, i AS field_ord, {x['name']} AS name, "
            f"{x['json_name']} AS json_name, {x['type']} AS type, {x['source_type']} AS source_type, "
            f"c_custkey AS owner, e FROM customer CROSS JOIN (VALUES (0), (1)) ve(e) CROSS JOIN (VALUES {ords}) vi(i)")


CATALOG_SQL = f"""
flds AS ({_sql_fields('provider', P_FIELDS)} UNION ALL {_sql_fields('consumer', C_FIELDS)}),
ents AS (
  SELECT concat('prov-', c_custkey) AS service, e AS entity_ord, {P_ENTITY} AS entity, 'class' AS kind, c_custkey AS owner
  FROM customer CROSS JOIN (VALUES (0), (1)) ve(e)
  UNION ALL SELECT concat('cons-', c_custkey), e, {C_ENTITY}, 'class', c_custkey
  FROM customer CROSS JOIN (VALUES (0), (1)) ve(e)
  UNION ALL SELECT concat('prov-', c_custkey), 2, 'OrderStatus', 'enum', c_custkey FROM customer WHERE {HAS_STATUS}),
plans AS (SELECT c_custkey AS plan_id, concat('prov-', c_custkey) AS provider_service, {P_ENTITY} AS provider_entity,
  concat('cons-', c_custkey) AS consumer_service, {C_ENTITY} AS consumer_entity
  FROM customer CROSS JOIN (VALUES (0)) ve(e)),
pairings AS (SELECT c_custkey AS pairing_id, concat('prov-', c_custkey) AS provider_service,
  concat('cons-', c_custkey) AS consumer_service FROM customer),
props AS (SELECT c_custkey AS plan_id, i AS ord, {', '.join(f'{t} AS {n}' for n, t in PROPOSAL_EXPRS.items())}
  FROM customer CROSS JOIN (VALUES (0)) ve(e) CROSS JOIN (VALUES (0), (1), (2), (3)) vi(i))"""

# ---- comparison of names, in SQL lambdas

from crosswalk.functions import names as _names  # noqa: E402
from crosswalk.functions import types as _types  # noqa: E402


def sql_tokens(name: str) -> str:
    spaced = f"regexp_replace({name}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')"
    return (f"list_transform(list_filter(regexp_split_to_array({spaced}, '[\\s_\\-]+'), lambda w: w <> ''), "
            "lambda w: lower(w))")


def sql_tagged(name: str) -> str:
    groups = ", ".join(f"'{w}': {g}" for g, words in enumerate(_names.SYNONYM_GROUPS) for w in words)
    return f"list_transform({sql_tokens(name)}, lambda t: {{'t': t, 'g': MAP {{{groups}}}[t]}})"


def sql_significant(tagged: str, strip: str | None = None) -> str:
    noise = ", ".join(f"'{w}'" for w in _names.NOISE_WORDS)
    more = f" AND NOT list_contains({strip}, w.t)" if strip else ""
    left = f"list_filter({tagged}, lambda w: w.t NOT IN ({noise}){more})"
    return f"CASE WHEN len({left}) > 0 THEN {left} ELSE {tagged} END"


def sql_list_similarity(a: str, b: str) -> str:
    sim = ("CASE WHEN x.t = y.t THEN 1.0::DOUBLE WHEN x.g = y.g THEN 0.8::DOUBLE WHEN length(x.t) > 3 AND length(y.t) > 3 "
           "AND (starts_with(x.t, y.t) OR starts_with(y.t, x.t)) THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END")

    def half(xs: str, ys: str) -> str:
        return (f"list_reduce(list_transform({xs}, lambda x: list_max(list_transform({ys}, lambda y: {sim}))), "
                "lambda p, q: p + q)")

    return f"(({half(a, b)} + {half(b, a)}) / (len({a}) + len({b})))"


def sql_base(ctype: str) -> str:
    return f"CASE WHEN {ctype} LIKE 'ref:%' THEN 'enum-or-ref' WHEN {ctype} LIKE 'list<%' THEN 'list' ELSE {ctype} END"


def sql_compat(p: str, c: str) -> str:
    near = " OR ".join(f"({p} = '{a}' AND {c} = '{b}') OR ({p} = '{b}' AND {c} = '{a}')" for a, b in _types.COMPATIBLE_TYPES)
    return f"CASE WHEN {p} = {c} THEN 1.0::DOUBLE WHEN {near} THEN 0.9::DOUBLE ELSE 0.2::DOUBLE END"


def sql_round3(x: str) -> str:
    """Printing with three digits rounds the exact binary value, ties to even."""
    return f"printf('%.3f', ({x})::DOUBLE)::DOUBLE"


# Every field pair of the given scope, scored one by one, with nothing left out by keys.
def sql_scored(scope_table: str, scope: str, with_entities: bool) -> str:
    if with_entities:
        p_join = f"JOIN flds p ON p.service = s.provider_service AND p.entity = s.provider_entity"
        c_join = f"JOIN flds c ON c.service = s.consumer_service AND c.entity = s.consumer_entity"
    else:
        p_join = "JOIN flds p ON p.service = s.provider_service"
        c_join = "JOIN flds c ON c.service = s.consumer_service"
    p_base = (f"CASE WHEN p.type LIKE 'ref:%' THEN CASE WHEN k.kind = 'enum' THEN 'string' ELSE 'object' END "
              f"ELSE {sql_base('p.type')} END")
    strip = f"list_concat({sql_tokens('p_ent')}, {sql_tokens('c_ent')})"
    sims = {n: sql_list_similarity("cw", n) for n in ("pw", "pj")}
    return f"""
raw AS (SELECT s.{scope}, p.entity AS p_ent, c.entity AS c_ent, c.field_ord AS c_ord, p.field_ord AS p_ord,
  c.name AS consumer_field, p.name AS provider_field, p.json_name AS provider_json, {p_base} AS p_base,
  {sql_base('c.type')} AS c_base
  FROM {scope_table} s {p_join} {c_join}
  LEFT JOIN ents k ON k.service = p.service AND 'ref:' || k.entity = p.type),
stripped AS (SELECT *, {strip} AS strip FROM raw),
sig AS (SELECT *, {sql_significant(sql_tagged('consumer_field'), 'strip')} AS cw,
  {sql_significant(sql_tagged('provider_field'), 'strip')} AS pw,
  {sql_significant(sql_tagged('provider_json'), 'strip')} AS pj FROM stripped),
scored AS (SELECT {scope}, p_ent AS provider_entity, c_ent AS consumer_entity, c_ord, p_ord, consumer_field, provider_field,
  provider_json, greatest({sims['pw']}, {sims['pj']}) * ({sql_compat('p_base', 'c_base')}) AS score FROM sig),
cand AS (SELECT * FROM scored WHERE score >= 0.5::DOUBLE)"""


def sql_greedy(source: str, scope: str, order: str, out: str) -> str:
    """Walk the rows of each scope in order, keep those with both ends free."""
    return f"""
{out}_r AS (SELECT *, row_number() OVER (PARTITION BY {scope} ORDER BY {order}) AS rn FROM {source}),
{out}_w AS (
  SELECT {scope}, 0::BIGINT AS rn, []::VARCHAR[] AS uc, []::VARCHAR[] AS up, FALSE AS took FROM (SELECT DISTINCT {scope} FROM {source})
  UNION ALL
  SELECT {', '.join('w.' + s.strip() for s in scope.split(','))}, r.rn,
    CASE WHEN NOT list_contains(w.uc, r.consumer_field) AND NOT list_contains(w.up, r.provider_field)
      THEN list_append(w.uc, r.consumer_field) ELSE w.uc END,
    CASE WHEN NOT list_contains(w.uc, r.consumer_field) AND NOT list_contains(w.up, r.provider_field)
      THEN list_append(w.up, r.provider_field) ELSE w.up END,
    NOT list_contains(w.uc, r.consumer_field) AND NOT list_contains(w.up, r.provider_field)
  FROM {out}_w w JOIN {out}_r r ON {' AND '.join(f'w.{s.strip()} = r.{s.strip()}' for s in scope.split(','))} AND r.rn = w.rn + 1),
{out} AS (SELECT r.* FROM {out}_r r JOIN {out}_w w ON {' AND '.join(f'w.{s.strip()} = r.{s.strip()}' for s in scope.split(','))}
  AND r.rn = w.rn AND w.took)"""


PLAN_CANDIDATES_SQL = f"{CATALOG_SQL},{sql_scored('plans', 'plan_id', True)}"
HEURISTIC_SQL = f"{PLAN_CANDIDATES_SQL},{sql_greedy('cand', 'plan_id', 'score DESC, c_ord, p_ord', 'heur')}"
