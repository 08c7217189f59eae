"""Column functions over names, types, values and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosswalk.functions import names, paths, types, values
from workload.base import (CATALOG_SQL, entities, fields, plans, query, sql_base, sql_compat, sql_list_similarity, sql_round3,
                           sql_significant, sql_tagged, sql_tokens, table)

# identifiers in several styles out of the part table
IDENT = "concat(replace(p_name, ' ', '_'), upper(substr(p_type, 1, 1)), lower(substr(p_type, 2)), '-', replace(p_brand, '#', ' '), CASE WHEN p_partkey % 3 = 0 THEN 'No' ELSE 'qtyX' END)"


def _ident(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_size", F.expr(IDENT).alias("ident"))


@query("tokens", f"SELECT p_partkey, array_to_string({sql_tokens(IDENT)}, '|') AS words FROM part")
def tokens(spark, sf):
    return _ident(spark, sf).select("p_partkey", F.array_join(names.tokens("ident"), "|").alias("words"))


_PAIR_SQL = f"""{CATALOG_SQL}, pr AS (SELECT s.plan_id, c.name AS a, p.name AS b, c.entity AS ce, p.entity AS pe, c.type AS ct, p.type AS pt,
p.service AS ps, c.field_ord AS o FROM plans s JOIN flds c ON c.service = s.consumer_service AND c.entity = s.consumer_entity
JOIN flds p ON p.service = s.provider_service AND p.entity = s.provider_entity AND p.field_ord = c.field_ord)"""


def _aligned(spark, sf):
    f, s = fields(spark, sf), plans(spark, sf)
    c = f.select(F.col("service").alias("consumer_service"), F.col("entity").alias("consumer_entity"), F.col("field_ord").alias("o"),
                 F.col("name").alias("a"), F.col("type").alias("ct"))
    p = f.select(F.col("service").alias("provider_service"), F.col("entity").alias("provider_entity"), F.col("field_ord").alias("o"),
                 F.col("name").alias("b"), F.col("type").alias("pt"))
    return s.join(c, ["consumer_service", "consumer_entity"]).join(p, ["provider_service", "provider_entity", "o"])


@query("name_similarity", f"""WITH {_PAIR_SQL}, st AS (SELECT *, list_concat({sql_tokens('pe')}, {sql_tokens('ce')}) AS strip FROM pr),
sg AS (SELECT plan_id, o, {sql_significant(sql_tagged('a'), 'strip')} AS va, {sql_significant(sql_tagged('b'), 'strip')} AS vb FROM st)
SELECT plan_id, o, {sql_list_similarity('va', 'vb')} AS similarity FROM sg""")
def name_similarity(spark, sf):
    rows = _aligned(spark, sf).withColumn("strip", F.concat(names.tokens("provider_entity"), names.tokens("consumer_entity")))
    return rows.select("plan_id", "o", names.name_similarity("a", "b", "strip").alias("similarity"))


@query("type_compat", f"""WITH {_PAIR_SQL} SELECT plan_id, o, {sql_compat('(' + "CASE WHEN pt LIKE 'ref:%' THEN 'object' ELSE " + sql_base('pt') + " END)",
                                                                         '(' + sql_base('ct') + ')')} AS compat, {sql_base('ct')} AS base FROM pr""")
def type_compat(spark, sf):
    base = types.base_type(F.col("ct"))
    none = F.lit(None).cast("string")
    return _aligned(spark, sf).select("plan_id", "o", types.type_compat(types.provider_base(F.col("pt"), none), base).alias("compat"),
                                      base.alias("base"))


@query("naming_styles", f"""SELECT p_partkey, lower(trim(regexp_replace(regexp_replace({IDENT}, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'),
'[^a-zA-Z0-9]+', '_', 'g'), '_')) AS snake, array_to_string(list_transform(list_filter(regexp_split_to_array({IDENT}, '[^a-zA-Z0-9]+'),
lambda w: w <> ''), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), '') AS pascal FROM part""")
def naming_styles(spark, sf):
    return _ident(spark, sf).select("p_partkey", names.snake(F.col("ident")).alias("snake"), names.pascal(F.col("ident")).alias("pascal"))


REQUIREMENT = ("concat(replace(p_name, ' ', CASE p_partkey % 3 WHEN 0 THEN '_' WHEN 1 THEN '.-' ELSE '--' END), lower(p_type), ' >=', p_size, "
               "CASE WHEN p_partkey % 4 = 0 THEN '; extra == ''x''' ELSE '' END)")


@query("package_keys", f"""SELECT p_partkey, CASE WHEN NOT contains(r, 'extra ==') THEN lower(regexp_replace(
regexp_extract(r, '^[A-Za-z0-9_.\\-]+'), '[-_.]+', '-', 'g')) END AS package FROM (SELECT p_partkey, {REQUIREMENT} AS r FROM part)""")
def package_keys(spark, sf):
    req = table(spark, sf, "part").select("p_partkey", F.expr(REQUIREMENT).alias("r"))
    return req.select("p_partkey", names.package_key(names.requirement_name(F.col("r"))).alias("package"))


PAIR_SPEC = "concat(c_mktsegment, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat(':', c_name, CASE WHEN c_custkey % 3 = 0 THEN ':x' ELSE '' END) END)"


@query("parse_pair_spec", f"""SELECT c_custkey, split_part(s, ':', 1) AS provider_entity,
CASE WHEN contains(s, ':') THEN substr(s, strpos(s, ':') + 1) END AS consumer_entity FROM (SELECT c_custkey, {PAIR_SPEC} AS s FROM customer)""")
def parse_pair_spec(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", F.expr(PAIR_SPEC).alias("s"))
    return rows.withColumn("p", names.parse_pair_spec(F.col("s"))).select("c_custkey", "p.provider_entity", "p.consumer_entity")


@query("any_of", "SELECT p_partkey, list_has_any(string_split(p_name, ' '), ['ring', 'bolt', 'blue']) AS hit FROM part")
def any_of(spark, sf):
    return table(spark, sf, "part").select("p_partkey", names.any_of(F.split("p_name", " "), ["ring", "bolt", "blue"]).alias("hit"))


# type texts whose canonical form follows from the keys they are built from
JAVA_INNER = "split_part('String,long,BigDecimal,Boolean,LocalDateTime,LocalDate,UUID,Byte,PartType,java.util.UUID', ',', cast(p_partkey % 10 AS INT) + 1)"
JAVA_CANON = "split_part('string,integer,decimal,boolean,datetime,date,uuid,object,ref:PartType,uuid', ',', cast(p_partkey % 10 AS INT) + 1)"
JAVA_TYPE = f"""CASE p_size % 7 WHEN 0 THEN {JAVA_INNER} WHEN 1 THEN concat('List<', {JAVA_INNER}, '>') WHEN 2 THEN concat('Optional<', {JAVA_INNER}, '>')
WHEN 3 THEN concat('java.util.Set< List<', {JAVA_INNER}, '> >') WHEN 4 THEN concat({JAVA_INNER}, '[][]') WHEN 5 THEN concat('Map<String, ', {JAVA_INNER}, '>')
ELSE concat('List<Optional<', {JAVA_INNER}, '>>[]') END"""


@query("canonical_java", f"""SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN c WHEN 1 THEN 'list<' || c || '>' WHEN 2 THEN c
WHEN 5 THEN 'object' ELSE 'list<list<' || c || '>>' END AS canonical FROM (SELECT *, {JAVA_CANON} AS c FROM part)""")
def canonical_java(spark, sf):
    from crosswalk.sources.source_code import resolve_refs
    rows = table(spark, sf, "part").select(
        F.lit("parts").alias("service"), F.col("p_name").alias("name"), "p_partkey", F.expr(JAVA_TYPE).alias("type_text"))
    known = table(spark, sf, "part").select(F.lit("parts").alias("service"), F.lit("PartType").alias("name")).distinct()
    return resolve_refs(rows, types.java_type_parts(F.col("type_text")), known, "canonical").select("p_partkey", "canonical")


PY_INNER = "split_part('str,int,Decimal,bool,datetime.datetime,date,UUID,bytes,''PartType'',Any', ',', cast(p_partkey % 10 AS INT) + 1)"
PY_CANON = "split_part('string,integer,decimal,boolean,datetime,date,uuid,object,ref:PartType,object', ',', cast(p_partkey % 10 AS INT) + 1)"
PY_TYPE = f"""CASE p_size % 8 WHEN 0 THEN {PY_INNER} WHEN 1 THEN concat('list[', {PY_INNER}, ']') WHEN 2 THEN concat('Optional[', {PY_INNER}, ']')
WHEN 3 THEN concat({PY_INNER}, ' | None') WHEN 4 THEN concat('None | Sequence[', {PY_INNER}, ']') WHEN 5 THEN concat('dict[str, ', {PY_INNER}, ']')
WHEN 6 THEN concat('Annotated[', {PY_INNER}, ' | None, Field(pattern="a|b")]') ELSE concat({PY_INNER}, ' | int | None') END"""


@query("canonical_python", f"""SELECT p_partkey, CASE WHEN p_size % 8 IN (1, 4) THEN 'list<' || c || '>' WHEN p_size % 8 = 5 THEN 'object' ELSE c END
AS canonical, p_size % 8 IN (2, 3, 4, 6, 7) AS optional FROM (SELECT *, {PY_CANON} AS c FROM part)""")
def canonical_python(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", types.python_type_parts(F.expr(PY_TYPE)).alias("p"))
    return rows.select("p_partkey", types.canonical_text(F.col("p"), F.col("p.name") == "PartType").alias("canonical"),
                       F.col("p.optional").alias("optional"))


@query("target_type", f"""WITH {CATALOG_SQL}, b AS (SELECT f.service, f.entity, f.name, f.type, k.kind FROM flds f
LEFT JOIN ents k ON k.service = f.service AND 'ref:' || k.entity = f.type)
SELECT service, entity, name, CASE type WHEN 'integer' THEN 'BIGINT' WHEN 'decimal' THEN 'DECIMAL(38,18)' WHEN 'string' THEN 'STRING'
WHEN 'datetime' THEN 'TIMESTAMP_NTZ' WHEN 'date' THEN 'DATE' WHEN 'list<string>' THEN 'ARRAY<STRING>' ELSE 'STRING' END AS target FROM b""")
def target_type(spark, sf):
    from crosswalk.operators.match import resolve_enum
    rows = resolve_enum(fields(spark, sf), entities(spark, sf))
    return rows.select("service", "entity", "name", types.target_type(F.col("type"), F.col("ref_kind")).alias("target"))


RETURN_TYPE = "CASE c_nationkey % 4 WHEN 0 THEN concat('ref:', c_mktsegment) WHEN 1 THEN concat('list<ref:', c_mktsegment, '>') WHEN 2 THEN 'string' ELSE NULL END"


@query("normalize_return", """SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN c_mktsegment WHEN 1 THEN 'list<' || c_mktsegment || '>' WHEN 2 THEN 'string' END
AS returns, c_nationkey % 4 = 1 AS is_list, CASE c_nationkey % 4 WHEN 2 THEN 'string' WHEN 3 THEN '' ELSE c_mktsegment END AS entity FROM customer""")
def normalize_return(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", types.normalize_return(F.expr(RETURN_TYPE)).alias("returns"))
    shape = types.returned_entity(F.col("returns"))
    return rows.select("c_custkey", "returns", shape["is_list"].alias("is_list"), shape["entity"].alias("entity"))


RATIO = "(cast(o_orderkey % 10001 AS DOUBLE) / cast(10000 AS DOUBLE))"


@query("round_half_even", f"SELECT o_orderkey, {sql_round3(RATIO)} AS rounded FROM orders")
def round_half_even(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", types.round_half_even(F.expr(RATIO)).alias("rounded"))


_SEED = "list_sum(list_transform(string_split(name, ''), lambda ch: ord(ch)))::BIGINT"


@query("sample_value", f"""WITH {CATALOG_SQL}, s AS (SELECT f.*, k.kind, {_SEED.replace('name', 'f.name')} AS seed FROM flds f
LEFT JOIN ents k ON k.service = f.service AND 'ref:' || k.entity = f.type WHERE coalesce(k.kind, 'enum') = 'enum')
SELECT service, entity, name, CASE type WHEN 'string' THEN '"' || name || '-' || (seed % 97) || '"' WHEN 'list<string>' THEN '["' || name || '-' || (seed % 97) || '"]'
WHEN 'integer' THEN (1000 + seed % 9000)::VARCHAR WHEN 'decimal' THEN ((seed % 10000 + 49)::DOUBLE / 100.0::DOUBLE)::VARCHAR
WHEN 'datetime' THEN '"2026-09-' || lpad((1 + seed % 28)::VARCHAR, 2, '0') || 'T' || lpad((seed % 24)::VARCHAR, 2, '0') || ':15:30"'
WHEN 'date' THEN '"2026-09-' || lpad((1 + seed % 28)::VARCHAR, 2, '0') || '"'
ELSE CASE WHEN kind = 'enum' THEN '"' || split_part('PENDING,PAID,SHIPPED', ',', (seed % 3)::INT + 1) || '"' ELSE 'null' END END AS sample FROM s""")
def sample_value(spark, sf):
    from crosswalk.operators.samples import sample_values
    return sample_values(fields(spark, sf), entities(spark, sf)).select("service", "entity", "name", "sample")


@query("sample_entities", f"""WITH {CATALOG_SQL}, s AS (SELECT f.*, k.kind, {_SEED.replace('name', 'f.name')} AS seed FROM flds f
LEFT JOIN ents k ON k.service = f.service AND 'ref:' || k.entity = f.type), v AS (SELECT service, entity, field_ord, json_name, CASE type
WHEN 'string' THEN '"' || name || '-' || (seed % 97) || '"' WHEN 'list<string>' THEN '["' || name || '-' || (seed % 97) || '"]'
WHEN 'integer' THEN (1000 + seed % 9000)::VARCHAR WHEN 'decimal' THEN ((seed % 10000 + 49)::DOUBLE / 100.0::DOUBLE)::VARCHAR
WHEN 'datetime' THEN '"2026-09-' || lpad((1 + seed % 28)::VARCHAR, 2, '0') || 'T' || lpad((seed % 24)::VARCHAR, 2, '0') || ':15:30"'
WHEN 'date' THEN '"2026-09-' || lpad((1 + seed % 28)::VARCHAR, 2, '0') || '"'
ELSE CASE WHEN kind = 'enum' THEN '"' || split_part('PENDING,PAID,SHIPPED', ',', (seed % 3)::INT + 1) || '"' ELSE 'null' END END AS x FROM s)
SELECT service, entity, '{{' || string_agg('"' || json_name || '": ' || x, ', ' ORDER BY field_ord) || '}}' AS sample FROM v GROUP BY ALL""")
def sample_entities(spark, sf):
    from crosswalk.operators.samples import sample_entities as build
    return build(fields(spark, sf), entities(spark, sf))


# expected and delivered texts of an order; the key decides in which form the delivered one comes
_SAME = {
    "number": ("cast(o_orderkey AS STRING)", "CASE o_orderkey % 5 WHEN 0 THEN concat(o_orderkey, '.0') WHEN 1 THEN concat('0', o_orderkey) WHEN 2 THEN 'true' "
                                             "WHEN 3 THEN NULL ELSE cast(o_orderkey + 1 AS STRING) END", "integer", "o_orderkey % 5 IN (0, 1)"),
    "moment": ("date_format(o_orderdate, 'yyyy-MM-dd''T''HH:mm:ss')",
               "CASE o_custkey % 4 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') WHEN 1 THEN date_format(o_orderdate, 'yyyy-MM-dd''T''HH:mm:ss''Z''') "
               "WHEN 2 THEN 'junk' ELSE date_format(o_orderdate, 'yyyy-MM-dd') END", "datetime", "o_custkey % 4 IN (0, 3)"),
    "text": ("CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_orderstatus END", "CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 'F' END", "string",
             "CASE WHEN o_custkey % 3 = 0 THEN o_orderkey % 2 = 0 WHEN o_orderkey % 2 = 0 THEN FALSE ELSE o_orderstatus = 'F' END"),
}


@query("same_value", "SELECT o_orderkey, " + ", ".join(f"{v[3]} AS {k}_same" for k, v in _SAME.items()) + " FROM orders")
def same_value(spark, sf):
    orders = table(spark, sf, "orders")
    return orders.select("o_orderkey", *[values.same_value(F.expr(e), F.expr(a), t).alias(f"{k}_same") for k, (e, a, t, _) in _SAME.items()])


_CHATTER = "CASE event_id % 5 WHEN 0 THEN concat('Sure! ', props, ' hope that helps') WHEN 1 THEN concat('```json\n', props, '\n```') WHEN 2 THEN concat('[', props, ', ', props, ']') WHEN 3 THEN concat(props, ' x }') ELSE event_type END"


@query("first_json_object", "SELECT event_id, CASE WHEN event_id % 5 IN (0, 1) THEN props END AS object, "
                            "CASE WHEN event_id % 5 IN (0, 1) THEN json_extract_string(props, '$.k')::BIGINT END AS k FROM events")
def first_json_object(spark, sf):
    rows = table(spark, sf, "events").select("event_id", values.first_json_object(F.expr(_CHATTER)).alias("object"))
    return rows.select("event_id", "object", F.get_json_object("object", "$.k").cast("bigint").alias("k"))


@query("finding_label", """SELECT page_id, 'rule-' || (page_id % 7) || ' ' || regexp_extract(rtrim(url, '/'), '[^/]*$') || ':' || (page_id * 3) AS finding,
url || ':' || page_id || ': E' || (page_id % 9) || ' length ' || length(html) AS diagnostic FROM pages""")
def finding_label(spark, sf):
    rule = F.concat(F.lit("rule-"), (F.col("page_id") % 7).cast("string"))
    code = F.concat(F.lit("E"), (F.col("page_id") % 9).cast("string"))
    message = F.concat(F.lit("length "), F.length("html").cast("string"))
    return table(spark, sf, "pages").select(
        "page_id", values.finding_label(rule, F.col("url"), F.col("page_id") * 3).alias("finding"),
        values.diagnostic_label(F.col("url"), F.col("page_id"), code, message).alias("diagnostic"))


@query("last_line", r"""SELECT doc_id, CASE WHEN b = '' THEN 'no output' ELSE left(list_extract(regexp_split_to_array(b, '\r\n|[\n\r]'), -1), 200) END AS line
FROM (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS b FROM documents)""")
def last_line(spark, sf):
    return table(spark, sf, "documents").select("doc_id", values.last_line(F.col("text")).alias("line"))


_STATUS = "CASE event_type WHEN 'view' THEN 'clean' WHEN 'click' THEN 'findings' WHEN 'signup' THEN 'llm' ELSE event_type END"


@query("status_class", f"SELECT event_id, CASE s WHEN 'clean' THEN 'pass' WHEN 'findings' THEN 'fail' WHEN 'error' THEN 'fail' WHEN 'llm' THEN 'warn' ELSE 'skip' END AS class "
                       f"FROM (SELECT event_id, {_STATUS} AS s FROM events)")
def status_class(spark, sf):
    return table(spark, sf, "events").select("event_id", values.status_class(F.expr(_STATUS)).alias("class"))


@query("html_escape", """SELECT page_id, md5(e) AS digest, length(e) AS n FROM (SELECT page_id, replace(replace(replace(replace(replace(html,
'&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS e FROM pages)""")
def html_escape(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", values.html_escape(F.col("html")).alias("e"))
    return rows.select("page_id", F.md5("e").alias("digest"), F.length("e").cast("bigint").alias("n"))


_FENCED = "CASE turn % 3 WHEN 0 THEN concat('```python\n', text, '\n```  ') WHEN 1 THEN concat('```', text) ELSE text END"


@query("strip_code_fence", r"""SELECT conv_id, turn, role, md5(regexp_replace(regexp_replace(f, '^\s+|\s+$', '', 'g'), '^```(?:python)?\s*|\s*```\s*$', '', 'g')) AS digest
FROM (SELECT conv_id, turn, role, """ + _FENCED.replace("\n", "' || chr(10) || '") + " AS f FROM conversations)")
def strip_code_fence(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.expr(_FENCED).alias("f"))
    return rows.select("conv_id", "turn", "role", F.md5(values.strip_code_fence(F.col("f"))).alias("digest"))


_TEMPLATE = "concat('/', p_type, '/{part_id}/', replace(p_name, ' ', '/{'), CASE WHEN p_name LIKE '% %' THEN '}' ELSE '' END)"


@query("route_pattern", rf"""SELECT p_partkey, '^' || regexp_replace(t, '\{{\w+\}}', '[^/]+', 'g') || '/?$' AS pattern,
array_to_string(regexp_extract_all(t, '\{{(\w+)\}}', 1), ',') AS vars FROM (SELECT p_partkey, {_TEMPLATE} AS t FROM part)""")
def route_pattern(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.expr(_TEMPLATE).alias("t"))
    return rows.select("p_partkey", paths.route_pattern(F.col("t")).alias("pattern"), F.array_join(paths.path_vars(F.col("t")), ",").alias("vars"))


@query("request_path", "SELECT page_id, regexp_replace(regexp_replace(url, '^https?://[^/?#]*', ''), '[?#].*$', '') AS path FROM pages")
def request_path(spark, sf):
    return table(spark, sf, "pages").select("page_id", paths.request_path(F.col("url")).alias("path"))


_PREFIX = "CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN concat('/', p_type, '/') ELSE p_type END"
_SUB = "CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN concat('/', p_size, '/{id}/') ELSE '/' END"


@query("join_path", f"""SELECT p_partkey, '/' || array_to_string(list_filter([trim(coalesce(a, ''), '/'), trim(b, '/')], lambda x: x <> ''), '/') AS path
FROM (SELECT p_partkey, {_PREFIX} AS a, {_SUB} AS b FROM part)""")
def join_path(spark, sf):
    return table(spark, sf, "part").select("p_partkey", paths.join_path(F.expr(_PREFIX), F.expr(_SUB)).alias("path"))


@query("param_location", f"""WITH {CATALOG_SQL} SELECT service, entity, name, CASE WHEN name = 'orderId' OR name = 'status' THEN 'path'
WHEN type LIKE 'ref:%' THEN 'body' ELSE 'query' END AS location FROM flds""")
def param_location(spark, sf):
    place = paths.param_location(F.col("name"), F.col("type"), F.lit("/api/{orderId}/by/{status}"))
    return fields(spark, sf).select("service", "entity", "name", place.alias("location"))


@query("drop_null_params", """SELECT o_orderkey, '{' || array_to_string(list_filter([CASE WHEN o_custkey % 2 = 0 THEN '"customer":"' || o_custkey || '"' END,
'"status":"' || o_orderstatus || '"', CASE WHEN o_orderkey % 3 = 0 THEN '"priority":"' || o_orderpriority || '"' END], lambda x: x IS NOT NULL), ',') || '}' AS params,
'{' || array_to_string(list_filter([CASE WHEN o_custkey % 2 = 0 THEN '"customer":' || o_custkey END, '"order":{"status":"' || o_orderstatus || '"}'],
lambda x: x IS NOT NULL), ',') || '}' AS body FROM orders""")
def drop_null_params(spark, sf):
    params = F.expr("map('customer', IF(o_custkey % 2 = 0, cast(o_custkey AS STRING), NULL), 'status', o_orderstatus, "
                    "'priority', IF(o_orderkey % 3 = 0, o_orderpriority, NULL))")
    body = F.expr("named_struct('customer', IF(o_custkey % 2 = 0, o_custkey, NULL), 'order', named_struct('status', o_orderstatus, 'note', cast(NULL AS STRING)))")
    return table(spark, sf, "orders").select("o_orderkey", F.to_json(values.drop_null_params(params)).alias("params"),
                                             values.body_json(body).alias("body"))
