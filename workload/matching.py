"""Field matching: candidates, assignment, proposals, plans, entity choice."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosswalk.operators import match
from crosswalk.operators.assign import assign_one_to_one
from crosswalk.plans.mapping_plan import build_plan
from workload.base import (CATALOG_SQL, HEURISTIC_SQL, PLAN_CANDIDATES_SQL, entities, fields, pairings, plans, proposals, query,
                           sql_compat, sql_base, sql_greedy, sql_list_similarity, sql_round3, sql_scored, sql_significant,
                           sql_tagged, sql_tokens)

SCOPE = ["plan_id"]
PAIR = ["consumer_field", "provider_field"]


def _candidates(spark, sf):
    return match.candidate_pairs(plans(spark, sf), fields(spark, sf), entities(spark, sf), SCOPE)


def _heuristic(spark, sf):
    return match.heuristic_pairs(_candidates(spark, sf), SCOPE)


@query("candidate_pairs", f"WITH {PLAN_CANDIDATES_SQL} SELECT plan_id, consumer_field, provider_field, provider_json, c_ord, p_ord, "
                          "score FROM cand")
def candidate_pairs(spark, sf):
    return _candidates(spark, sf).select(*SCOPE, *PAIR, "provider_json", "c_ord", "p_ord", "score")


@query("rank_candidates", f"WITH {PLAN_CANDIDATES_SQL} SELECT plan_id, c_ord, p_ord, score FROM cand ORDER BY ALL")
def rank_candidates(spark, sf):
    return match.rank_candidates(_candidates(spark, sf), SCOPE).select("plan_id", "c_ord", "p_ord", "score")


@query("score_threshold", f"WITH {PLAN_CANDIDATES_SQL} SELECT plan_id, count(*) AS n, max(score) AS best FROM cand "
                          "WHERE score >= 0.8::DOUBLE GROUP BY plan_id")
def score_threshold(spark, sf):
    kept = match.score_threshold(_candidates(spark, sf), 0.8)
    return kept.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"))


@query("resolve_enum", f"""WITH {CATALOG_SQL} SELECT f.service, f.entity, f.name, k.kind AS ref_kind FROM flds f
LEFT JOIN ents k ON k.service = f.service AND 'ref:' || k.entity = f.type""")
def resolve_enum(spark, sf):
    return match.resolve_enum(fields(spark, sf), entities(spark, sf)).select("service", "entity", "name", "ref_kind")


@query("assign_one_to_one", f"WITH RECURSIVE {HEURISTIC_SQL} SELECT plan_id, consumer_field, provider_field, score FROM heur")
def one_to_one(spark, sf):
    chosen = assign_one_to_one(_candidates(spark, sf), SCOPE, *PAIR, [-F.col("score"), F.col("c_ord"), F.col("p_ord")])
    return chosen.select("plan_id", *PAIR, "score")


_TOKEN_TEXT = "'[''' || array_to_string({0}, ''', ''') || ''']'"


@query("heuristic_pairs", f"""WITH RECURSIVE {HEURISTIC_SQL} SELECT plan_id, consumer_field, provider_field, provider_json,
{sql_round3('score')} AS confidence, 'tokens ' || {_TOKEN_TEXT.format(sql_tokens('provider_field'))} || ' ~ ' ||
{_TOKEN_TEXT.format(sql_tokens('consumer_field'))} AS reason FROM heur""")
def heuristic_pairs(spark, sf):
    return _heuristic(spark, sf).select("plan_id", *PAIR, "provider_json", "confidence", "reason")


_ENTITY_PAIRS_SQL = f"""{CATALOG_SQL},{sql_scored('pairings', 'pairing_id', False)},
sides AS (SELECT s.pairing_id, p.entity AS provider_entity, p.entity_ord AS p_o, c.entity AS consumer_entity, c.entity_ord AS c_o,
  {sql_significant(sql_tagged('p.entity'))} AS pw, {sql_significant(sql_tagged('c.entity'))} AS cw, s.consumer_service
  FROM pairings s JOIN ents p ON p.service = s.provider_service AND p.kind <> 'enum'
  JOIN ents c ON c.service = s.consumer_service AND c.kind <> 'enum'),
named AS (SELECT *, {sql_list_similarity('pw', 'cw')} AS name_score FROM sides)"""


@query("entity_pairs", f"""WITH {_ENTITY_PAIRS_SQL} SELECT pairing_id, provider_entity, consumer_entity, name_score FROM named n
WHERE name_score > 0 OR (p_o = 0 AND c_o = 0) OR EXISTS (SELECT 1 FROM cand x WHERE x.pairing_id = n.pairing_id
  AND x.provider_entity = n.provider_entity AND x.consumer_entity = n.consumer_entity)""")
def entity_pairs(spark, sf):
    ents, scope = entities(spark, sf), ["pairing_id"]
    cands = match.candidate_pairs(pairings(spark, sf), fields(spark, sf), ents, scope)
    return match.entity_pairs(pairings(spark, sf), ents, cands, scope).select(
        "pairing_id", "provider_entity", "consumer_entity", "name_score")


@query("choose_pair", f"""WITH RECURSIVE {_ENTITY_PAIRS_SQL},
{sql_greedy('cand', 'pairing_id, provider_entity, consumer_entity', 'score DESC, c_ord, p_ord', 'heur')},
mapped AS (SELECT pairing_id, provider_entity, consumer_entity, count(*) AS n FROM heur GROUP BY ALL),
sizes AS (SELECT service, entity, count(*) AS k FROM flds GROUP BY ALL),
total AS (SELECT n.pairing_id, n.provider_entity, n.consumer_entity, n.p_o, n.c_o,
  coalesce(m.n, 0)::DOUBLE / greatest(coalesce(z.k, 0), 1) + 0.25::DOUBLE * n.name_score AS score
  FROM named n LEFT JOIN mapped m USING (pairing_id, provider_entity, consumer_entity)
  LEFT JOIN sizes z ON z.service = n.consumer_service AND z.entity = n.consumer_entity)
SELECT pairing_id, provider_entity, consumer_entity, score FROM total
QUALIFY row_number() OVER (PARTITION BY pairing_id ORDER BY score DESC, p_o, c_o) = 1""")
def choose_pair(spark, sf):
    return match.choose_pair(pairings(spark, sf), fields(spark, sf), entities(spark, sf), ["pairing_id"])


_P_BASE = f"CASE WHEN p.type LIKE 'ref:%' THEN CASE WHEN k.kind = 'enum' THEN 'string' ELSE 'object' END ELSE {sql_base('p.type')} END"
_JUDGED_SQL = f"""
known AS (SELECT q.*, c.type AS c_type, p.type AS p_type, c.field_ord AS c_ord, p.field_ord AS p_ord, p.json_name AS provider_json,
  c.name IS NOT NULL AND p.name IS NOT NULL AS known, ({sql_compat('(' + _P_BASE + ')', '(' + sql_base('c.type') + ')')}) >= 0.5 AS fits
  FROM props q JOIN plans s USING (plan_id)
  LEFT JOIN flds c ON c.service = s.consumer_service AND c.entity = s.consumer_entity AND c.name = q.consumer_field
  LEFT JOIN flds p ON p.service = s.provider_service AND p.entity = s.provider_entity AND p.name = q.provider_field
  LEFT JOIN ents k ON k.service = p.service AND 'ref:' || k.entity = p.type),
valid AS (SELECT plan_id, ord, consumer_field, provider_field FROM known WHERE known AND fits),
{sql_greedy('valid', 'plan_id', 'ord', 'acc')},
judged AS (SELECT n.*, CASE WHEN NOT known THEN 'unknown'
  WHEN EXISTS (SELECT 1 FROM acc a WHERE a.plan_id = n.plan_id AND a.ord = n.ord) THEN 'accepted'
  WHEN EXISTS (SELECT 1 FROM acc a WHERE a.plan_id = n.plan_id AND a.ord < n.ord AND (a.consumer_field = n.consumer_field
    OR a.provider_field = n.provider_field)) THEN 'duplicate' ELSE 'type_clash' END AS outcome,
  {sql_round3('coalesce(n.confidence, 0.8::DOUBLE)')} AS conf FROM known n)"""


@query("validate_proposals", f"""WITH RECURSIVE {CATALOG_SQL},{_JUDGED_SQL}
SELECT plan_id, ord, outcome, conf AS confidence, CASE outcome
  WHEN 'unknown' THEN 'rejected LLM pair with unknown field: ' || consumer_field || ' <- ' || provider_field
  WHEN 'duplicate' THEN 'rejected duplicate LLM pair: ' || consumer_field || ' <- ' || provider_field
  WHEN 'type_clash' THEN 'rejected type clash: ' || consumer_field || ' (' || c_type || ') <- ' || provider_field || ' (' || p_type || ')'
  END AS note FROM judged""")
def validate_proposals(spark, sf):
    return match.validate_proposals(proposals(spark, sf), plans(spark, sf), fields(spark, sf), entities(spark, sf), SCOPE).select(
        "plan_id", "ord", "outcome", "confidence", "note")


_PLAN_SQL = f"""{HEURISTIC_SQL},{_JUDGED_SQL},
accepted AS (SELECT plan_id, c_ord, consumer_field, provider_field, provider_json, conf AS confidence, 'llm' AS source FROM judged
  WHERE outcome = 'accepted'),
pairs AS (SELECT * FROM accepted UNION ALL
  SELECT plan_id, c_ord, consumer_field, provider_field, provider_json, {sql_round3('score')}, 'heuristic' FROM heur h
  WHERE NOT EXISTS (SELECT 1 FROM accepted a WHERE a.plan_id = h.plan_id AND a.consumer_field = h.consumer_field)
    AND NOT EXISTS (SELECT 1 FROM accepted a WHERE a.plan_id = h.plan_id AND a.provider_field = h.provider_field)),
cf AS (SELECT plan_id, field_ord AS ord, name, type, source_type FROM plans s JOIN flds f ON f.service = s.consumer_service
  AND f.entity = s.consumer_entity),
pf AS (SELECT plan_id, field_ord AS ord, name, type, source_type FROM plans s JOIN flds f ON f.service = s.provider_service
  AND f.entity = s.provider_entity),
unmapped AS (SELECT * FROM cf WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.plan_id = cf.plan_id AND p.consumer_field = cf.name)),
unused AS (SELECT * FROM pf WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.plan_id = pf.plan_id AND p.provider_field = pf.name)),
cov AS (SELECT plan_id, coalesce(m, 0) AS mapped, coalesce(u, 0) AS unmapped,
  coalesce(coalesce(m, 0)::DOUBLE / nullif(coalesce(m, 0) + coalesce(u, 0), 0), 0.0::DOUBLE) AS coverage FROM plans
  LEFT JOIN (SELECT plan_id, count(*) AS m FROM pairs GROUP BY ALL) USING (plan_id)
  LEFT JOIN (SELECT plan_id, count(*) AS u FROM unmapped GROUP BY ALL) USING (plan_id)),
eng AS (SELECT plan_id, CASE WHEN a AND b THEN 'model-x' WHEN a THEN 'model-x + heuristic' ELSE 'heuristic (fallback from model-x)' END
  AS engine FROM plans LEFT JOIN (SELECT plan_id, bool_or(source = 'llm') AS a, bool_and(source = 'llm') AS b FROM pairs GROUP BY ALL)
  USING (plan_id))"""


def _plan(spark, sf):
    return build_plan(plans(spark, sf), fields(spark, sf), entities(spark, sf), SCOPE, proposals(spark, sf), "model-x")


@query("fill_gaps", f"WITH RECURSIVE {_PLAN_SQL} SELECT plan_id, consumer_field, provider_field, provider_json, confidence, source FROM pairs")
def fill_gaps(spark, sf):
    return _plan(spark, sf).pairs.select("plan_id", *PAIR, "provider_json", "confidence", "source")


@query("order_pairs", f"WITH RECURSIVE {_PLAN_SQL} SELECT plan_id, c_ord, consumer_field FROM pairs ORDER BY plan_id, c_ord")
def order_pairs(spark, sf):
    return match.order_pairs(_plan(spark, sf).pairs, SCOPE).select("plan_id", "c_ord", "consumer_field")


@query("unmapped_consumer", f"WITH RECURSIVE {_PLAN_SQL} SELECT plan_id, ord, name FROM unmapped")
def unmapped_consumer(spark, sf):
    return _plan(spark, sf).unmapped()


@query("unused_provider", f"WITH RECURSIVE {_PLAN_SQL} SELECT plan_id, ord, name FROM unused")
def unused_provider(spark, sf):
    return _plan(spark, sf).unused()


@query("pair_types", f"""WITH RECURSIVE {_PLAN_SQL} SELECT p.plan_id, p.consumer_field, p.provider_field,
coalesce(nullif(c.source_type, ''), c.type) AS consumer_type, coalesce(nullif(v.source_type, ''), v.type) AS provider_type FROM pairs p
LEFT JOIN cf c ON c.plan_id = p.plan_id AND c.name = p.consumer_field LEFT JOIN pf v ON v.plan_id = p.plan_id AND v.name = p.provider_field""")
def pair_types(spark, sf):
    return _plan(spark, sf).types().select("plan_id", *PAIR, "consumer_type", "provider_type")


@query("coverage", f"WITH RECURSIVE {_PLAN_SQL} SELECT plan_id, mapped, unmapped, coverage FROM cov")
def coverage(spark, sf):
    return _plan(spark, sf).coverage()


@query("engine_label", f"WITH RECURSIVE {_PLAN_SQL} SELECT plan_id, engine FROM eng")
def engine_label(spark, sf):
    return _plan(spark, sf).engines()


@query("build_plan", f"""WITH RECURSIVE {_PLAN_SQL} SELECT s.plan_id, s.provider_entity, s.consumer_entity, e.engine,
{sql_round3('c.coverage')} AS coverage,
coalesce((SELECT string_agg(consumer_field || '<-' || provider_json || ':' || source, ', ' ORDER BY c_ord) FROM pairs p WHERE p.plan_id = s.plan_id), '') AS pairs,
coalesce((SELECT string_agg(name, ', ' ORDER BY ord) FROM unmapped u WHERE u.plan_id = s.plan_id), '') AS unmapped_consumer,
coalesce((SELECT string_agg(name, ', ' ORDER BY ord) FROM unused u WHERE u.plan_id = s.plan_id), '') AS unused_provider,
(SELECT count(*) FROM judged j WHERE j.plan_id = s.plan_id AND outcome <> 'accepted') AS n_notes
FROM plans s JOIN eng e USING (plan_id) JOIN cov c USING (plan_id)""")
def build_plan_documents(spark, sf):
    docs = _plan(spark, sf).documents()
    pair_text = F.transform("pairs", lambda p: F.concat(p["consumer_field"], F.lit("<-"), p["provider_json"], F.lit(":"), p["source"]))
    return docs.select("plan_id", "provider_entity", "consumer_entity", "engine", "coverage",
                       F.array_join(pair_text, ", ").alias("pairs"),
                       F.array_join("unmapped_consumer", ", ").alias("unmapped_consumer"),
                       F.array_join("unused_provider", ", ").alias("unused_provider"),
                       F.size("notes").cast("bigint").alias("n_notes"))
