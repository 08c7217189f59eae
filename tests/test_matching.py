import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from crosswalk import model
from crosswalk.functions import names as N
from crosswalk.operators import match
from crosswalk.operators.assign import assign_one_to_one
from crosswalk.operators.skew import salted_join
from crosswalk.plans.mapping_plan import build_plan
from services import entities, entity_pairing, fields, service_pairing

EXPECTED = {"order_ref": ("orderId", 0.8), "client_id": ("customerId", 0.9), "amount_due": ("totalAmount", 0.9),
            "currency": ("currencyCode", 1.0), "placed_at": ("createdAt", 0.8), "status": ("orderStatus", 1.0), "city": ("shippingCity", 0.667)}


def test_example_maps_completely(spark):
    plan = build_plan(entity_pairing(spark), fields(spark), entities(spark), ["plan_id"])
    got = {r["consumer_field"]: (r["provider_field"], r["confidence"]) for r in plan.pairs.collect()}
    assert got == EXPECTED
    (doc,) = plan.documents().collect()
    assert (doc["coverage"], doc["engine"], doc["unused_provider"], doc["unmapped_consumer"]) == (1.0, "heuristic", ["items"], [])


def test_entity_choice(spark):
    (best,) = match.choose_pair(service_pairing(spark), fields(spark), entities(spark), ["pairing_id"]).collect()
    assert (best["provider_entity"], best["consumer_entity"], round(best["score"], 3)) == ("Order", "OrderRecord", 1.167)
    assert match.pairings_without_entities(service_pairing(spark), entities(spark).filter("kind = 'enum'")).count() == 1


def test_proposals_are_checked_and_gaps_filled(spark):
    rows = [(1, 0, "client_id", "customerId", 0.97, None), (1, 1, "order_ref", "invented", 0.9, None), (1, 2, "placed_at", "totalAmount", 0.9, None),
            (1, 3, "order_ref", "customerId", 0.9, None), (1, 4, "city", "shippingCity", None, "said so")]
    proposals = spark.createDataFrame(rows, "plan_id INT, ord INT, consumer_field STRING, provider_field STRING, confidence DOUBLE, reason STRING")
    plan = build_plan(entity_pairing(spark), fields(spark), entities(spark), ["plan_id"], proposals, "fake")
    pairs = {r["consumer_field"]: r for r in plan.pairs.collect()}
    assert (pairs["client_id"]["source"], pairs["client_id"]["confidence"]) == ("llm", 0.97)
    assert (pairs["city"]["source"], pairs["city"]["confidence"], pairs["city"]["reason"]) == ("llm", 0.8, "said so")
    assert (pairs["order_ref"]["provider_field"], pairs["order_ref"]["source"]) == ("orderId", "heuristic")
    assert pairs["placed_at"]["provider_field"] == "createdAt"
    assert sorted(r["note"].split(":")[0] for r in plan.notes.collect()) == [
        "rejected LLM pair with unknown field", "rejected duplicate LLM pair", "rejected type clash"]
    assert plan.engines().first()["engine"] == "fake + heuristic"


def test_fallback_label(spark):
    none = spark.createDataFrame([], "plan_id INT, ord INT, consumer_field STRING, provider_field STRING, confidence DOUBLE, reason STRING")
    plan = build_plan(entity_pairing(spark), fields(spark), entities(spark), ["plan_id"], none, "fake")
    assert plan.engines().first()["engine"] == "heuristic (fallback from fake)"
    assert plan.coverage().first()["coverage"] == 1.0


def test_worked_similarities(spark):
    """By hand: words in both names count fully, synonyms 0.8, a word that begins with the other 0.7; noise words and the
    stripped ones do not count."""
    worked = [("customerId", "clientId", [], 0.9), ("orderId", "order_ref", ["order"], 0.8), ("city", "shippingCity", [], 2 / 3), ("x", "y", [], 0.0),
              ("statuses", "status", [], 0.7)]
    df = spark.createDataFrame(worked, "a STRING, b STRING, strip ARRAY<STRING>, want DOUBLE")
    for r in df.withColumns({"got": N.name_similarity("a", "b", "strip"), "back": N.name_similarity("b", "a", "strip")}).collect():
        assert abs(r["got"] - r["want"]) < 1e-3 and r["got"] == r["back"], r


def test_keys_lose_no_pair(spark):
    """The blocked join against every pair, on random names."""
    rng = random.Random(7)
    stems = ["order", "id", "ref", "customer", "clientele", "client", "amount", "amounts", "price", "created", "at", "code", "status", "state",
             "city", "cityline", "qty", "name", "zip", "on", "x"]
    name = lambda: "".join(w if i == 0 else w.title() for i, w in enumerate(rng.sample(stems, rng.randint(1, 3))))
    p = list(dict.fromkeys(name() for _ in range(60)))
    c = list(dict.fromkeys(name() for _ in range(60)))
    rows = [("p", "Order", i, n, n, "string", "", False) for i, n in enumerate(p)] + [("c", "ClientRef", i, n, n, "string", "", False) for i, n in enumerate(c)]
    flds = spark.createDataFrame(rows, model.FIELDS_DDL)
    ents = spark.createDataFrame([("p", 0, "Order", "class", "", 1, []), ("c", 0, "ClientRef", "class", "", 1, [])], model.ENTITIES_DDL)
    pairing = spark.createDataFrame([(1, "p", "Order", "c", "ClientRef")],
                                    "plan_id INT, provider_service STRING, provider_entity STRING, consumer_service STRING, consumer_entity STRING")
    got = {(r["consumer_field"], r["provider_field"]): r["score"] for r in match.candidate_pairs(pairing, flds, ents, ["plan_id"]).collect()}
    every = (spark.createDataFrame([(n,) for n in c], "a STRING").crossJoin(spark.createDataFrame([(n,) for n in p], "b STRING"))
             .withColumn("strip", F.array(*map(F.lit, ["order", "client", "ref"]))).withColumn("score", N.name_similarity("a", "b", "strip")))
    want = {(r["a"], r["b"]): r["score"] for r in every.filter("score >= 0.5").collect()}
    assert got == want and len(want) > 200


@pytest.mark.parametrize("folded", [0, 30, 1024])
def test_folds_and_rounds_equal_the_greedy_walk(spark, folded):
    rng = random.Random(3)
    rows = [(g, f"c{c}", f"p{p}", c, p, rng.choice([0.5, 0.7, 0.8, 0.9, 1.0]))
            for g in range(30) for c in range(7) for p in range(7) if rng.random() < 0.6]
    want, used = set(), set()
    for g, c, p, co, po, s in sorted(rows, key=lambda r: (r[0], -r[5], r[3], r[4])):
        if (g, c) not in used and (g, p) not in used:
            used |= {(g, c), (g, p)}
            want.add((g, c, p))
    df = spark.createDataFrame(rows, "g INT, c STRING, p STRING, c_ord INT, p_ord INT, score DOUBLE")
    order = [-F.col("score"), F.col("c_ord"), F.col("p_ord")]
    got = assign_one_to_one(df, ["g"], "c", "p", order, folded=folded)
    assert got.columns == df.columns and {(r["g"], r["c"], r["p"]) for r in got.collect()} == want
    one = assign_one_to_one(df.filter("g = 4"), [], "c", "p", order, folded=folded).collect()
    assert {(r["g"], r["c"], r["p"]) for r in one} == {w for w in want if w[0] == 4}
    assert assign_one_to_one(df.filter("false"), ["g"], "c", "p", order, folded=folded).count() == 0


def test_salted_join_splits_hot_keys_and_keeps_every_row(spark):
    left = spark.range(1000).select(F.col("id").alias("l"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    right = spark.range(120).select(F.col("id").alias("r"), F.when(F.col("id") > 60, 7).otherwise(F.col("id") % 50).alias("k"))
    plain = left.join(right, ["k"]).select("l", "r", "k")
    salted = salted_join(left, right, ["k"], ["l"], ["r"], rows_per_salt=25).select("l", "r", "k")
    assert salted.exceptAll(plain).count() == 0 and plain.exceptAll(salted).count() == 0


def test_no_table_of_a_plan_is_broadcast(spark):
    """Small as they look to the planner, all of these grow with the input."""
    rows = [(1, 0, "client_id", "customerId", 0.97, None)]
    proposals = spark.createDataFrame(rows, "plan_id INT, ord INT, consumer_field STRING, provider_field STRING, confidence DOUBLE, reason STRING")
    plan = build_plan(entity_pairing(spark), fields(spark), entities(spark), ["plan_id"], proposals, "fake")
    tables = [match.resolve_enum(fields(spark), entities(spark)), plan.documents(), plan.coverage(), plan.unmapped(), plan.unused(), plan.engines(),
              match.pair_types(plan.pairings, plan.fields, plan.pairs, ["plan_id"]), match.fill_gaps(plan.pairs, plan.pairs, ["plan_id"]),
              match.validate_proposals(proposals, plan.pairings, fields(spark), entities(spark), ["plan_id"])]
    for table in tables:
        assert "Broadcast" not in table._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("pairs_per_scope", [10, 4096])
def test_candidates_by_scope_and_by_key_are_the_same(spark, pairs_per_scope):
    """Two pairings; rows that occur twice count twice, a pairing without a key matches nothing."""
    pairing = service_pairing(spark)
    wide = pairing.unionByName(pairing.selectExpr("2 AS pairing_id", "provider_service", "consumer_service"))
    wide = wide.unionByName(pairing.selectExpr("cast(NULL AS INT) AS pairing_id", "provider_service", "consumer_service"))
    twice = fields(spark).unionByName(fields(spark).filter("name = 'orderId'"))
    got = match.candidate_pairs(wide, twice, entities(spark), ["pairing_id"], pairs_per_scope=pairs_per_scope).collect()
    first = sorted((r["consumer_field"], r["provider_field"]) for r in got if r["pairing_id"] == 1)
    assert first.count(("order_ref", "orderId")) == 4 and len(first) == sum(r["pairing_id"] == 2 for r in got) == len(got) / 2


def test_candidates_are_not_shuffled_by_their_keys(spark):
    """A row has several blocking keys; where a scope is small, it is sent once."""
    plan = match.candidate_pairs(entity_pairing(spark), fields(spark), entities(spark), ["plan_id"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(plan_id" in plan and "explode(" not in plan


def test_planning_names_stays_cheap_for_the_driver(spark):
    """The first ``str_to_map`` of a session costs whoever calls it gigabytes, and the planner calls it on the driver where its text is fixed."""
    candidates = match.candidate_pairs(entity_pairing(spark), fields(spark), entities(spark), ["plan_id"])
    names = spark.createDataFrame([("orderId", "mail_x", "")], "a STRING, b STRING, none STRING").select(*map(N.tagged, ["a", "b", "none"]))
    for table in (candidates, names):
        assert "str_to_map" not in table._jdf.queryExecution().analyzed().toString()
    assert [[tuple(w) for w in words] for words in names.first()] == [[("order", None), ("id", 0)], [("mail", 8), ("x", None)], []]


def test_tables_of_a_plan_are_computed_once(spark):
    """What the tables of a plan are made from is written once; a checkpoint computes it twice."""
    rows = [(1, 0, "client_id", "customerId", 0.97, None)]
    proposals = spark.createDataFrame(rows, "plan_id INT, ord INT, consumer_field STRING, provider_field STRING, confidence DOUBLE, reason STRING")
    plan = build_plan(entity_pairing(spark), fields(spark), entities(spark), ["plan_id"], proposals, "fake")
    for table in (plan.pairs, plan.notes):
        assert "Scan ExistingRDD" not in table._jdf.queryExecution().executedPlan().toString()
    assert plan.pairs.count() == 7 and plan.notes.count() == 0


def proposed_plan(spark, tally=None):
    rows = [(1, 0, "client_id", "customerId", 0.97, None), (1, 1, "client_id", "orderId", 0.9, None), (1, 2, "city", "invented", None, "said so")]
    proposals = spark.createDataFrame(rows, "plan_id INT, ord INT, consumer_field STRING, provider_field STRING, confidence DOUBLE, reason STRING")
    if tally is not None:
        proposals = proposals.withColumn("reason", F.udf(lambda text: tally.add(1) or text, "string")("reason"))
    return build_plan(entity_pairing(spark), fields(spark), entities(spark), ["plan_id"], proposals, "fake")


@pytest.mark.parametrize("wanted, most, rows", [
    (lambda plan: plan.engines(), 44, [(1, "fake + heuristic")]),
    (lambda plan: match.order_pairs(plan.pairs, ["plan_id"]).select("consumer_field"), 44, None),
    (lambda plan: match.pair_types(plan.pairings, plan.fields, plan.pairs, ["plan_id"]).select("consumer_field"), 49, None),
    (lambda plan: plan.pairs.select("consumer_field"), 42, None),
    (lambda plan: plan.unmapped(), 46, []),
    (lambda plan: plan.unused().select("plan_id", "name"), 46, [(1, "items")]),
], ids=["engine_label", "order_pairs", "pair_types", "fill_gaps", "unmapped_consumer", "unused_provider"])
def test_a_table_of_a_plan_takes_few_jobs(spark, wanted, most, rows):
    """Each job leaves threads, generated classes and compiled code in the driver, so what a plan is made from is joined once."""
    group = f"plan-{most}-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    got = sorted(map(tuple, wanted(proposed_plan(spark)).collect()))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == (sorted((name,) for name in EXPECTED) if rows is None else rows)
    assert 0 < jobs <= most


def test_proposals_are_joined_to_the_catalogs_once(spark):
    """The assignment and the verdict read the same rows."""
    tally = spark.sparkContext.accumulator(0)
    plan = proposed_plan(spark, tally)
    assert sorted(r["note"].split(":")[0] for r in plan.notes.collect()) == ["rejected LLM pair with unknown field", "rejected duplicate LLM pair"]
    assert tally.value == 3


@pytest.mark.parametrize("wanted, most", [
    (lambda plan: plan.types().select("plan_id", "consumer_field"), 30),
    (lambda plan: plan.pairs.select("plan_id", "consumer_field"), 24),
    (lambda plan: plan.unmapped(), 28),
    (lambda plan: plan.unused(), 28),
], ids=["pair_types", "fill_gaps", "unmapped_consumer", "unused_provider"])
def test_tables_of_small_scopes_take_one_shuffle_by_scope(spark, wanted, most):
    """Proposals, candidates and gaps of a scope meet in one place, and the leftovers read the fields that the plan has written."""
    group = f"scopes-{most}-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    wanted(proposed_plan(spark)).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs <= most


def odd_plan(spark):
    """Pairings that occur twice or are null, entities and fields that do too, and proposals of one ordinal that differ."""
    rng = random.Random(11)
    pairing = entity_pairing(spark)
    other = pairing.selectExpr("2 AS plan_id", "provider_service", "'OrderItem' AS provider_entity", "consumer_service", "'Invoice' AS consumer_entity")
    pairings = pairing.unionByName(pairing).unionByName(other).unionByName(pairing.selectExpr("cast(NULL AS INT) AS plan_id", *pairing.columns[1:]))
    flds = fields(spark).unionByName(fields(spark).filter("name IN ('orderId', 'city')")).unionByName(
        fields(spark).filter("name = 'status'").withColumns({"name": F.lit(None).cast("string"), "field_ord": F.lit(90).cast("bigint")})).unionByName(
        fields(spark).filter("name = 'currency'").withColumn("type", F.lit("boolean")))
    left = ["client_id", "order_ref", "city", "currency", "status", "sku", "invented", None]
    right = ["customerId", "orderId", "shippingCity", "currencyCode", "quantity", "invented", None]
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([0, 1, 2, 3, 4, None]), rng.choice(left), rng.choice(right), rng.choice([0.5, 0.75, None]), None) for _ in range(80)]
    proposals = spark.createDataFrame(rows, "plan_id INT, ord INT, consumer_field STRING, provider_field STRING, confidence DOUBLE, reason STRING")
    return pairings, flds, entities(spark), proposals


def test_small_and_large_scopes_make_the_same_plan(spark):
    scope, (pairings, flds, ents, proposals) = ["plan_id"], odd_plan(spark)
    sides = match.field_sides(pairings, flds, ents, scope)
    most = match.most_of_scope(scope, sides, pairings, proposals)
    of_scope = Counter(r["plan_id"] for r in proposals.collect())
    assert most.folds() and most.proposals == max(2 * of_scope[1], of_scope[2]) and not match.Most().folds()

    def rows(df):
        return sorted(map(repr, df.select(*sorted(df.columns)).collect()))
    small, large = (match.judge_proposals(proposals, pairings, sides, scope, m) for m in (most, match.Most()))
    assert rows(small) == rows(large) and {r["outcome"] for r in small.collect()} == {"accepted", "unknown", "duplicate", "type_clash"}
    candidates = match.candidates_of(sides, scope, most=most.pairs)
    assert rows(candidates) == rows(match.candidates_of(sides, scope))
    walked = match.heuristic_pairs(candidates, scope, most.pairs)
    assert rows(walked) == rows(match.heuristic_pairs(candidates, scope)) and walked.count() > 5
    accepted = match.accepted_pairs(small, scope)
    assert rows(match.fill_gaps(accepted, walked, scope, most)) == rows(match.fill_gaps(accepted, walked, scope))
    pairs = match.fill_gaps(accepted, walked, scope, most).filter("c_ord < 4")
    for table in (match.unmapped_consumer, match.unused_provider, match.pair_types, match.coverage):
        assert rows(table(pairings, flds, pairs, scope, sides)) == rows(table(pairings, flds, pairs, scope))


def test_a_scope_that_no_array_holds_takes_the_larger_path(spark):
    """The same plan where a scope has more than 1,024 proposals."""
    rows = [(1, i, "client_id" if i % 2 else "city", f"invented{i}" if i != 1200 else "customerId", 0.9, None) for i in range(1300)] + [
        (1, 1301, "client_id", "customerId", 0.9, None)]
    proposals = spark.createDataFrame(rows, "plan_id INT, ord INT, consumer_field STRING, provider_field STRING, confidence DOUBLE, reason STRING")
    plan = build_plan(entity_pairing(spark), fields(spark), entities(spark), ["plan_id"], proposals, "fake")
    assert {r["consumer_field"]: r["source"] for r in plan.pairs.collect()} == {
        c: "llm" if c == "client_id" else "heuristic" for c in EXPECTED}
    assert plan.notes.count() == 1300
