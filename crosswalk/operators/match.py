"""Scoring which fields of one entity mean the same as fields of another."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosswalk.functions import names, types
from crosswalk.operators.assign import FOLDED, assign_one_to_one, ends_taken, first_wins
from crosswalk.operators.skew import salted_join, spread_missing, unbounded
from crosswalk.session import cut_lineage, written

THRESHOLD = 0.5
ENTITY_NAME_WEIGHT = 0.25
DEFAULT_CONFIDENCE = 0.8
#: Pairs of a scope up to which all of them are looked at; of larger scopes only rows that share a blocking key meet.
PAIRS_PER_SCOPE = 4096


def lookup_entity(entities: DataFrame) -> DataFrame:
    """One row per (service, entity): the first one declared under that name."""
    return first_wins(entities, ["service", "entity"], ["entity_ord"])


def lookup_field(fields: DataFrame) -> DataFrame:
    """One row per (service, entity, name): the first field with that name."""
    return first_wins(fields, ["service", "entity", "name"], ["field_ord"])


def non_enum_entities(entities: DataFrame) -> DataFrame:
    return entities.filter(F.col("kind") != "enum")


def resolve_enum(fields: DataFrame, entities: DataFrame) -> DataFrame:
    """Adds ``ref_kind``: the kind of the entity a ``ref:`` type points to, null where there is none."""
    kinds = lookup_entity(entities.select("service", "entity", "entity_ord", "kind")).select(
        "service", F.col("entity").alias("_ref"), F.col("kind").alias("ref_kind"))
    ref = F.when(F.col("type").startswith("ref:"), F.substr(F.col("type"), F.lit(5)))
    keyed = fields.withColumn("_ref", spread_missing(ref, F.col("service"), F.col("entity"), F.col("name")))
    return keyed.join(unbounded(kinds), ["service", "_ref"], "left").drop("_ref")


def field_sides(pairings: DataFrame, fields: DataFrame, entities: DataFrame, scope: list[str], shown: bool = True) -> DataFrame:
    """Fields of the provider and of the consumer of each pairing in one table, written once: the scope columns, ``_role``, ``service``,
    ``entity``, ``ord``, ``name``, ``json_name``, ``type``, ``base`` and, if ``shown``, ``source_type``. Candidates, proposals and
    leftovers read this table, so the catalogs are scanned and joined to the pairings by one job of the driver for both roles.

    ``pairings`` names the two services, and optionally the two entities."""
    on = ["service", "entity"] if "provider_entity" in pairings.columns else ["service"]
    roles = F.array(*[F.struct(F.lit(role).alias("_role"), *[F.col(f"{role}_{c}").alias(c) for c in on]) for role in ("provider", "consumer")])
    wanted = pairings.select(*scope, F.explode(roles).alias("_side")).select(*scope, "_side.*")
    if len(on) == 1:
        records = non_enum_entities(lookup_entity(entities)).select("service", "entity")
        fields = fields.join(unbounded(records), ["service", "entity"], "left_semi")
    kept = ["json_name", "type"] + ["source_type"] * shown
    rows = fields.select("service", "entity", F.col("field_ord").alias("ord"), "name", *[c for c in fields.columns if c in kept])
    rows = resolve_enum(rows.join(unbounded(wanted), on), entities)
    base = (F.when(F.col("_role") == "provider", types.provider_base(F.col("type"), F.col("ref_kind")))
            .otherwise(types.base_type(F.col("type"))))
    return written(rows.withColumn("base", base).drop("ref_kind"), "sides")


def _side(sides: DataFrame, scope: list[str], role: str, **names: str) -> DataFrame:
    """The rows of one role: the scope columns, its service and entity, and the columns of ``names`` under these."""
    return sides.filter(F.col("_role") == role).select(
        *scope, *[F.col(c).alias(f"{role}_{c}") for c in ("service", "entity")], *[F.col(c).alias(n) for n, c in names.items()])


@dataclass(frozen=True)
class Most:
    """What no scope has more of. ``None`` for all where it was not counted."""

    pairs: int | None = None
    proposals: int | None = None
    fields: int | None = None

    def folds(self) -> bool:
        """May all rows of a scope be in one array?"""
        return self.pairs is not None and max(self.pairs, self.proposals, self.fields) <= FOLDED


def most_of_scope(scope: list[str], sides: DataFrame, pairings: DataFrame | None = None, proposals: DataFrame | None = None) -> Most:
    """Pairs of fields, proposals and fields of the largest scopes, counted in one job."""
    if not scope:
        return Most()
    consumer = (F.col("_role") == "consumer").cast("bigint")
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")

    def counted(df: DataFrame, *ones: Column) -> DataFrame:
        return df.select(*scope, *[c.alias(f"_n{i}") for i, c in enumerate(ones)])
    rows = counted(sides, consumer, 1 - consumer, none, none)
    if proposals is not None:  # a proposal counts for each pairing of its scope
        rows = rows.unionByName(counted(pairings, none, none, one, none)).unionByName(counted(proposals, none, none, none, one))
    n = [F.col(f"_n{i}") for i in range(4)]
    scopes = rows.dropna(subset=scope).groupBy(*scope).agg(*[F.sum(c).alias(f"_n{i}") for i, c in enumerate(n)])
    most = scopes.agg(F.max(n[0] * n[1]), F.max(n[2] * n[3]), F.max(n[0] + n[1])).first()
    return Most(*[x or 0 for x in most])


def _provider_words(rows: DataFrame) -> DataFrame:
    rows = rows.withColumns({"p_words": names.tagged("provider_field"), "p_wire": names.tagged("provider_json"),
                             "p_strip": names.tokens("provider_entity")})
    return rows.withColumn("p_keys", F.array_union(names.blocking_keys("p_words"), names.blocking_keys("p_wire")))


def _consumer_words(rows: DataFrame) -> DataFrame:
    rows = rows.withColumns({"c_words": names.tagged("consumer_field"), "c_strip": names.tokens("consumer_entity")})
    return rows.withColumn("c_keys", names.blocking_keys("c_words"))


def _met(consumers: DataFrame, providers: DataFrame, c_words: Callable[[DataFrame], DataFrame], p_words: Callable[[DataFrame], DataFrame],
         scope: list[str], c_spread: list[str], p_spread: list[str], fits: Column, pairs_per_scope: int, most: int | None = None) -> DataFrame:
    """Each pair of rows of a scope that ``fits`` and shares one of ``c_keys`` and ``p_keys``, once. ``c_words`` and ``p_words`` add these.

    The rows are shuffled by scope as they are, and names are taken apart behind that shuffle. Scopes of more than
    ``pairs_per_scope`` pairs are joined by key, where a pair sharing several is produced by the first of them. They are not looked
    for where no scope is known to have more than ``most`` pairs, and that is not more."""
    def by_scope(left: DataFrame, right: DataFrame) -> DataFrame:
        sides = c_words(left.repartition(*scope)), p_words(right.repartition(*scope))
        return sides[0].join(unbounded(sides[1]), scope).filter(fits & F.arrays_overlap("c_keys", "p_keys"))

    def by_key(left: DataFrame, right: DataFrame) -> DataFrame:
        # both sides are counted and joined; taking names apart twice would cost more than writing them down
        sides = cut_lineage(c_words(left)), cut_lineage(p_words(right))
        return salted_join(sides[0].withColumn("key", F.explode("c_keys")), sides[1].withColumn("key", F.explode("p_keys")),
                           [*scope, "key"], c_spread, p_spread).filter(
            (F.array_min(F.array_intersect("c_keys", "p_keys")) == F.col("key")) & fits).drop("key")

    if not scope:
        return by_key(consumers, providers)
    if most is not None and most <= pairs_per_scope:
        return by_scope(consumers, providers)
    # both sides are counted in one aggregation
    both = (consumers.select(*scope, F.lit(1).alias("_c"), F.lit(0).alias("_p"))
            .unionByName(providers.select(*scope, F.lit(0).alias("_c"), F.lit(1).alias("_p"))))
    large = (both.dropna(subset=scope).groupBy(*scope).agg(F.sum("_c").alias("_c"), F.sum("_p").alias("_p"))
             .filter(F.col("_c") * F.col("_p") > pairs_per_scope).select(*scope))
    if large.isEmpty():
        return by_scope(consumers, providers)
    met = by_scope(*(side.join(large, scope, "left_anti") for side in (consumers, providers)))
    return met.unionByName(by_key(*(side.join(large, scope, "left_semi") for side in (consumers, providers))))


def _score() -> Column:
    strip = "concat(p_strip, c_strip)"
    lists = ", ".join(f"'{k}', {names.significant_sql(col, strip)}"
                      for k, col in (("c", "c_words"), ("p", "p_words"), ("w", "p_wire")))
    by_name, by_wire = names.list_similarity_sql("s.c", "s.p"), names.list_similarity_sql("s.c", "s.w")
    likeness = F.expr(f"transform(array(named_struct({lists})), s -> "
                      f"IF(provider_field = provider_json, {by_name}, greatest({by_name}, {by_wire})))[0]")
    return likeness * types.type_compat(F.col("p_base"), F.col("c_base"))


def score_threshold(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return scored.filter(F.col("score") >= F.lit(threshold))


def candidate_pairs(pairings: DataFrame, fields: DataFrame, entities: DataFrame, scope: list[str],
                    threshold: float = THRESHOLD, pairs_per_scope: int = PAIRS_PER_SCOPE) -> DataFrame:
    """Consumer fields against provider fields of each pairing, scored and cut at the threshold.

    ``pairings`` names the two services, and optionally the two entities, that are matched with each other;
    ``scope`` are its key columns. Fields meet only where they share a blocking key: a pair without one has
    no two words alike and scores zero. Types that cannot reach the threshold are dropped before the names are compared."""
    sides = field_sides(pairings, fields, entities, scope, shown=False)
    return candidates_of(sides, scope, threshold, pairs_per_scope, most_of_scope(scope, sides).pairs)


def candidates_of(sides: DataFrame, scope: list[str], threshold: float = THRESHOLD, pairs_per_scope: int = PAIRS_PER_SCOPE,
                  most: int | None = None) -> DataFrame:
    """The same from the written ``field_sides``. ``most``: pairs that no scope has more of, if known."""
    consumers = _side(sides, scope, "consumer", c_ord="ord", consumer_field="name", c_base="base")
    providers = _side(sides, scope, "provider", p_ord="ord", provider_field="name", provider_json="json_name", p_base="base")
    fits = types.type_compat(F.col("p_base"), F.col("c_base")) >= F.lit(threshold)
    met = _met(consumers, providers, _consumer_words, _provider_words, scope, ["consumer_service", "consumer_entity", "consumer_field"],
               ["provider_service", "provider_entity", "provider_field"], fits, pairs_per_scope, most)
    scored = met.withColumn("score", _score())
    return score_threshold(scored, threshold).select(
        *scope, *[c for c in ("provider_entity", "consumer_entity") if c not in scope],
        "c_ord", "p_ord", "consumer_field", "provider_field", "provider_json", "score")


def rank_candidates(candidates: DataFrame, scope: list[str]) -> DataFrame:
    """Candidates of a scope from best to worst; equal scores stay in consumer, then provider field order."""
    return candidates.orderBy(*scope, F.desc("score"), "c_ord", "p_ord")


def _token_list_text(name: str) -> Column:
    words = names.tokens(name)
    return F.when(F.size(words) == 0, F.lit("[]")).otherwise(
        F.concat(F.lit("['"), F.array_join(words, "', '"), F.lit("']")))


def heuristic_pairs(candidates: DataFrame, scope: list[str], most: int | None = None) -> DataFrame:
    """One-to-one pairs from the candidates, best score first. Scores are rounded only for output. ``most``: candidates that no scope
    has more of, if known."""
    chosen = assign_one_to_one(candidates, scope, "consumer_field", "provider_field",
                               [-F.col("score"), F.col("c_ord"), F.col("p_ord")], most=most)
    reason = F.concat(F.lit("tokens "), _token_list_text("provider_field"), F.lit(" ~ "),
                      _token_list_text("consumer_field"))
    return chosen.select(*[c for c in chosen.columns if c != "score"],
                         types.round_half_even(F.col("score")).alias("confidence"),
                         F.lit("heuristic").alias("source"), reason.alias("reason"))


def entity_pairs(pairings: DataFrame, entities: DataFrame, candidates: DataFrame, scope: list[str]) -> DataFrame:
    """Provider and consumer entities of each pairing that can win the choice, with the likeness of their names.

    A pair without candidates and without likeness of names scores zero. Of those only the first provider
    entity with the first consumer entity can win, so it stands for all of them and no cross product is built."""
    usable = non_enum_entities(lookup_entity(entities)).select("service", "entity", "entity_ord")

    def side(prefix: str, role: str) -> DataFrame:
        return written(pairings.select(*scope, F.col(f"{role}_service").alias("service")).join(unbounded(usable), "service")
                       .select(*scope, F.col("entity").alias(f"{role}_entity"), F.col("entity_ord").alias(f"{prefix}_ent_ord")), f"{role}s")

    def with_words(prefix: str, role: str) -> Callable[[DataFrame], DataFrame]:
        return lambda rows: (rows.withColumn(f"{prefix}_words", names.tagged(f"{role}_entity"))
                             .withColumn(f"{prefix}_keys", names.blocking_keys(f"{prefix}_words")))

    p, c = side("p", "provider"), side("c", "consumer")
    first_p = p.groupBy(*scope).agg(F.min_by("provider_entity", "p_ent_ord").alias("provider_entity"))
    first_c = c.groupBy(*scope).agg(F.min_by("consumer_entity", "c_ent_ord").alias("consumer_entity"))
    alike = _met(c, p, with_words("c", "consumer"), with_words("p", "provider"), scope, ["consumer_entity"], ["provider_entity"],
                 F.lit(True), PAIRS_PER_SCOPE)
    keys = [*scope, "provider_entity", "consumer_entity"]
    wanted = (candidates.select(*keys).unionByName(alike.select(*keys))
              .unionByName(first_p.join(unbounded(first_c), scope).select(*keys)).distinct())
    return (wanted.join(unbounded(p), [*scope, "provider_entity"]).join(unbounded(c), [*scope, "consumer_entity"])
            .withColumns({"p_words": names.tagged("provider_entity"), "c_words": names.tagged("consumer_entity")})
            .withColumn("name_score", names.list_similarity("p_words", "c_words"))
            .select(*scope, "provider_entity", "consumer_entity", "p_ent_ord", "c_ent_ord", "name_score"))


def score_entity_pairs(pairings: DataFrame, fields: DataFrame, entities: DataFrame, scope: list[str]) -> DataFrame:
    """Entity pairs with ``coverage + 0.25 * likeness of the names``."""
    candidates = written(candidate_pairs(pairings, fields, entities, scope), "candidates")
    pair_scope = [*scope, "provider_entity", "consumer_entity"]
    mapped = heuristic_pairs(candidates, pair_scope).groupBy(*pair_scope).agg(F.count(F.lit(1)).alias("n_pairs"))
    sizes = (fields.groupBy("service", "entity").agg(F.count(F.lit(1)).alias("n_fields"))
             .withColumnsRenamed({"service": "consumer_service", "entity": "consumer_entity"}))
    pairs = (entity_pairs(pairings, entities, candidates, scope).join(unbounded(mapped), pair_scope, "left")
             .join(unbounded(pairings.select(*scope, "consumer_service")), scope)
             .join(unbounded(sizes), ["consumer_service", "consumer_entity"], "left"))
    covered = F.coalesce("n_pairs", F.lit(0)) / F.greatest(F.coalesce("n_fields", F.lit(0)), F.lit(1))
    return pairs.select(*pair_scope, "p_ent_ord", "c_ent_ord",
                        (covered + F.lit(ENTITY_NAME_WEIGHT) * F.col("name_score")).alias("score"))


def choose_pair(pairings: DataFrame, fields: DataFrame, entities: DataFrame, scope: list[str]) -> DataFrame:
    """The entity pair of each pairing that maps best. Ties go to the first provider, then the first consumer
    entity. A pairing without entities gives no row; ``pairings_without_entities`` lists those."""
    scored = score_entity_pairs(pairings, fields, entities, scope)
    best = scored.groupBy(*scope).agg(F.max_by(
        F.struct("provider_entity", "consumer_entity", "score"),
        F.struct("score", -F.col("p_ent_ord"), -F.col("c_ent_ord"))).alias("_b"))
    return best.select(*scope, "_b.provider_entity", "_b.consumer_entity", "_b.score")


def pairings_without_entities(pairings: DataFrame, entities: DataFrame) -> DataFrame:
    """Pairings that cannot be mapped because one of the services declares nothing to map."""
    having = non_enum_entities(entities).select("service").distinct()
    ok = (pairings.join(having.withColumnRenamed("service", "provider_service"), "provider_service", "left_semi")
          .join(having.withColumnRenamed("service", "consumer_service"), "consumer_service", "left_semi"))
    return pairings.join(ok.select(*pairings.columns), pairings.columns, "left_anti")


def validate_proposals(proposals: DataFrame, pairings: DataFrame, fields: DataFrame, entities: DataFrame,
                       scope: list[str]) -> DataFrame:
    """Check pairs proposed from outside against both catalogs.

    ``proposals`` has the scope columns, ``ord``, ``consumer_field``, ``provider_field``, ``confidence``, ``reason``.
    Adds ``outcome``: accepted, unknown, duplicate or type_clash. A rejected proposal does not use up its fields,
    so the accepted ones are the one-to-one assignment, in proposal order, of those that are known and fit."""
    sides = field_sides(pairings, fields, entities, scope)
    return judge_proposals(proposals, pairings, sides, scope, most_of_scope(scope, sides, pairings, proposals))


def judge_proposals(proposals: DataFrame, pairings: DataFrame, sides: DataFrame, scope: list[str], most: Most = Most()) -> DataFrame:
    """The same from the written ``field_sides``. Where scopes are known to be small, a proposal finds its fields in an array of those
    of its scope, and everything is shuffled by scope alone."""
    wide = pairings.select(*scope, "provider_service", "provider_entity", "consumer_service", "consumer_entity")
    known = proposals.join(unbounded(wide), scope)
    found = ["ord", *[c for c in ("json_name", "type", "source_type") if c in sides.columns], "base"]
    if scope and most.folds():
        item = F.struct(*found, "_role", "service", "entity", "name")
        known = known.join(unbounded(sides.groupBy(*scope).agg(F.array_sort(F.collect_list(item)).alias("_fields"))), scope, "left")

        def first(role: str) -> Column:
            return F.get(F.filter("_fields", lambda f: (f["_role"] == role) & (f["service"] == F.col(f"{role}_service"))
                                  & (f["entity"] == F.col(f"{role}_entity")) & (f["name"] == F.col(f"{role}_field"))), F.lit(0))
        known = known.withColumns({"_c": first("consumer"), "_p": first("provider")})
    else:
        for role, name in (("consumer", "_c"), ("provider", "_p")):
            keys = [*scope, f"{role}_service", f"{role}_entity", f"{role}_field"]
            rows = sides.filter(F.col("_role") == role).select(
                *scope, *[F.col(c).alias(f"{role}_{k}") for c, k in (("service", "service"), ("entity", "entity"), ("name", "field"))],
                F.struct(*found).alias(name))
            known = known.join(unbounded(rows.groupBy(*keys).agg(F.min(name).alias(name))), keys, "left")
    known = (known.select("*", F.col("_c.ord").alias("c_ord"), F.col("_c.type").alias("c_type"), F.col("_p.ord").alias("p_ord"),
                          F.col("_p.type").alias("p_type"), F.col("_p.json_name").alias("provider_json"))
             .withColumn("known", F.col("c_ord").isNotNull() & F.col("p_ord").isNotNull())
             .withColumn("fits", F.col("known") & (types.type_compat(F.col("_p.base"), F.col("_c.base")) >= F.lit(THRESHOLD))))
    confidence = types.round_half_even(F.coalesce("confidence", F.lit(DEFAULT_CONFIDENCE)))
    known = known.select(
        *scope, "ord", "c_ord", "p_ord", "consumer_field", "provider_field", "provider_json",
        confidence.alias("confidence"), F.coalesce("reason", F.lit("")).alias("reason"), "c_type", "p_type", "known", "fits")
    judged = ends_taken(known, scope, "consumer_field", "provider_field", "ord", "fits", ("_c_ord", "_p_ord"),
                        most=most.proposals)
    taken = F.coalesce(F.col("_c_ord") < F.col("ord"), F.lit(False)) | F.coalesce(F.col("_p_ord") < F.col("ord"), F.lit(False))
    is_accepted = F.col("_c_ord").eqNullSafe(F.col("ord")) & F.col("_p_ord").eqNullSafe(F.col("ord"))
    outcome = (F.when(~F.col("known"), F.lit("unknown")).when(is_accepted, F.lit("accepted"))
               .when(taken, F.lit("duplicate")).otherwise(F.lit("type_clash")))
    pair_text = F.concat(F.coalesce("consumer_field", F.lit("None")), F.lit(" <- "), F.coalesce("provider_field", F.lit("None")))
    note = (F.when(F.col("outcome") == "unknown", F.concat(F.lit("rejected LLM pair with unknown field: "), pair_text))
            .when(F.col("outcome") == "duplicate", F.concat(F.lit("rejected duplicate LLM pair: "), pair_text))
            .when(F.col("outcome") == "type_clash",
                  F.concat(F.lit("rejected type clash: "), "consumer_field", F.lit(" ("), "c_type", F.lit(") <- "),
                           "provider_field", F.lit(" ("), "p_type", F.lit(")"))))
    return (judged.withColumn("outcome", outcome)
            .select(*scope, "ord", "c_ord", "p_ord", "consumer_field", "provider_field", "provider_json", "confidence", "reason",
                    "outcome", note.alias("note")))


def accepted_pairs(validated: DataFrame, scope: list[str]) -> DataFrame:
    return validated.filter(F.col("outcome") == "accepted").select(
        *scope, "c_ord", "p_ord", "consumer_field", "provider_field", "provider_json", "confidence",
        F.lit("llm").alias("source"), "reason")


def fill_gaps(pairs: DataFrame, heuristic: DataFrame, scope: list[str], most: Most = Most()) -> DataFrame:
    """Heuristic pairs whose consumer and provider field are both free, added to the given pairs. Where scopes are known to be small,
    the ends that a scope has given away come as two arrays, so the heuristic pairs stay where they were made."""
    if scope and most.folds():
        ends = {"consumer_field": "_c_taken", "provider_field": "_p_taken"}
        taken = pairs.groupBy(*scope).agg(*[F.collect_set(end).alias(name) for end, name in ends.items()])
        free = heuristic.join(unbounded(taken), scope, "left")
        for end, name in ends.items():
            free = free.filter(~F.coalesce(F.array_contains(name, F.col(end)), F.lit(False)))
    else:
        free = (heuristic.join(unbounded(pairs.select(*scope, "consumer_field")), [*scope, "consumer_field"], "left_anti")
                .join(unbounded(pairs.select(*scope, "provider_field")), [*scope, "provider_field"], "left_anti"))
    return pairs.unionByName(free.select(*pairs.columns))


def side_fields(pairings: DataFrame, fields: DataFrame, scope: list[str], role: str, sides: DataFrame | None = None) -> DataFrame:
    """Fields of the provider or consumer entity of each pairing: scope columns, ``ord``, ``name``. Read from the ``field_sides`` of
    the pairings where these are written already."""
    if sides is not None:
        kept = [c for c in ("ord", "name", "type", "source_type") if c in sides.columns]
        return _side(sides, scope, role, **{c: c for c in kept})
    keyed = fields.select(F.col("service").alias(f"{role}_service"), F.col("entity").alias(f"{role}_entity"),
                          F.col("field_ord").alias("ord"), "name", "type", "source_type")
    return pairings.select(*scope, f"{role}_service", f"{role}_entity").join(
        unbounded(keyed), [f"{role}_service", f"{role}_entity"])


def unmapped_consumer(pairings: DataFrame, fields: DataFrame, pairs: DataFrame, scope: list[str],
                      sides: DataFrame | None = None) -> DataFrame:
    """Consumer fields in no pair."""
    mapped = pairs.select(*scope, F.col("consumer_field").alias("name"))
    return side_fields(pairings, fields, scope, "consumer", sides).join(unbounded(mapped), [*scope, "name"], "left_anti").select(
        *scope, "ord", "name")


def unused_provider(pairings: DataFrame, fields: DataFrame, pairs: DataFrame, scope: list[str],
                    sides: DataFrame | None = None) -> DataFrame:
    """Provider fields in no pair."""
    mapped = pairs.select(*scope, F.col("provider_field").alias("name"))
    return side_fields(pairings, fields, scope, "provider", sides).join(unbounded(mapped), [*scope, "name"], "left_anti").select(
        *scope, "ord", "name")


def order_pairs(pairs: DataFrame, scope: list[str]) -> DataFrame:
    return pairs.orderBy(*scope, "c_ord")


def pair_types(pairings: DataFrame, fields: DataFrame, pairs: DataFrame, scope: list[str], sides: DataFrame | None = None) -> DataFrame:
    """Pairs with the type both fields have in their source, or the canonical type where there is none."""
    shown = F.coalesce(F.nullif(F.col("source_type"), F.lit("")), F.col("type"))

    def typed(role: str) -> DataFrame:
        rows = side_fields(pairings, fields, scope, role, sides).withColumn("shown", shown)
        last = rows.groupBy(*scope, "name").agg(F.max_by("shown", "ord").alias(f"{role}_type"))
        return last.withColumnRenamed("name", f"{role}_field")

    return (pairs.join(unbounded(typed("consumer")), [*scope, "consumer_field"], "left")
            .join(unbounded(typed("provider")), [*scope, "provider_field"], "left"))


def coverage(pairings: DataFrame, fields: DataFrame, pairs: DataFrame, scope: list[str], sides: DataFrame | None = None) -> DataFrame:
    """Share of mapped consumer fields per pairing, 0.0 where there are none."""
    mapped = pairs.groupBy(*scope).agg(F.count(F.lit(1)).alias("mapped"))
    missing = unmapped_consumer(pairings, fields, pairs, scope, sides).groupBy(*scope).agg(F.count(F.lit(1)).alias("unmapped"))
    n, m = F.coalesce("mapped", F.lit(0)), F.coalesce("unmapped", F.lit(0))
    share = F.coalesce(F.try_divide(n.cast("double"), n + m), F.lit(0.0))
    return (pairings.select(*scope).join(unbounded(mapped), scope, "left").join(unbounded(missing), scope, "left")
            .select(*scope, n.alias("mapped"), m.alias("unmapped"), share.alias("coverage")))


def engine_label(engine: Column, has_proposed: Column, all_proposed: Column) -> Column:
    """Who the pairs of a plan come from. ``engine`` is null where nothing was proposed from outside."""
    return (F.when(engine.isNull(), F.lit("heuristic"))
            .when(F.coalesce(has_proposed, F.lit(False)) & F.coalesce(all_proposed, F.lit(False)), engine)
            .when(F.coalesce(has_proposed, F.lit(False)), F.concat(engine, F.lit(" + heuristic")))
            .otherwise(F.concat(F.lit("heuristic (fallback from "), engine, F.lit(")"))))
