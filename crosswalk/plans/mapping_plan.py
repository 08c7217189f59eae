"""A whole mapping plan: validated proposals, heuristic filling, leftovers and coverage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosswalk.functions.types import round_half_even
from crosswalk.operators import match
from crosswalk.operators.skew import unbounded
from crosswalk.session import written

PAIR_COLUMNS = ["consumer_field", "provider_field", "provider_json", "confidence", "source", "reason"]


@dataclass
class MappingPlan:
    """The tables of a plan. All carry the scope columns of the pairings they were built from."""

    pairings: DataFrame
    fields: DataFrame
    pairs: DataFrame
    notes: DataFrame | None
    engine: str | None
    scope: list[str]
    sides: DataFrame | None = None

    def unmapped(self) -> DataFrame:
        return match.unmapped_consumer(self.pairings, self.fields, self.pairs, self.scope, self.sides)

    def unused(self) -> DataFrame:
        return match.unused_provider(self.pairings, self.fields, self.pairs, self.scope, self.sides)

    def types(self) -> DataFrame:
        return match.pair_types(self.pairings, self.fields, self.pairs, self.scope, self.sides)

    def coverage(self) -> DataFrame:
        return match.coverage(self.pairings, self.fields, self.pairs, self.scope, self.sides)

    def engines(self) -> DataFrame:
        """``engine`` label per pairing."""
        proposed = F.col("source") == "llm"
        who = self.pairs.groupBy(*self.scope).agg(F.bool_or(proposed).alias("_any"), F.bool_and(proposed).alias("_all"))
        label = match.engine_label(F.lit(self.engine).cast("string"), F.col("_any"), F.col("_all"))
        return self.pairings.select(*self.scope).join(unbounded(who), self.scope, "left").select(*self.scope, label.alias("engine"))

    def documents(self) -> DataFrame:
        """One row per pairing with its lists in field order. A list is as long as an entity is wide."""
        def listed(df: DataFrame, order: str, columns: list[str], name: str) -> DataFrame:
            item = F.struct(F.col(order).alias("_o"), F.struct(*columns).alias("v"))
            pick = (lambda x: x["v"]) if len(columns) > 1 else (lambda x: x["v"][columns[0]])
            return unbounded(df.groupBy(*self.scope).agg(F.transform(F.array_sort(F.collect_list(item)), pick).alias(name)))

        scope = self.scope
        out = self.pairings.select(*scope, "provider_service", "consumer_service", "provider_entity", "consumer_entity")
        out = out.join(listed(self.pairs, "c_ord", PAIR_COLUMNS, "pairs"), scope, "left")
        out = out.join(listed(self.unmapped(), "ord", ["name"], "unmapped_consumer"), scope, "left")
        out = out.join(listed(self.unused(), "ord", ["name"], "unused_provider"), scope, "left")
        if self.notes is not None:
            out = out.join(listed(self.notes, "ord", ["note"], "notes"), scope, "left")
        else:
            out = out.withColumn("notes", F.lit(None).cast("array<string>"))
        out = out.join(unbounded(self.engines()), scope).join(
            unbounded(self.coverage().select(*scope, round_half_even(F.col("coverage")).alias("coverage"))), scope)
        empty = {c: F.coalesce(F.col(c), F.array().cast("array<string>"))
                 for c in ("unmapped_consumer", "unused_provider", "notes")}
        pair_type = out.schema["pairs"].dataType.simpleString()
        return out.withColumns({**empty, "pairs": F.coalesce("pairs", F.array().cast(pair_type))})


def build_plan(pairings: DataFrame, fields: DataFrame, entities: DataFrame, scope: list[str],
               proposals: DataFrame | None = None, engine: str | None = None) -> MappingPlan:
    """Plan for every pairing. The heuristic assignment is computed for the whole entity first and fills what
    the accepted proposals leave open; it is not run again on the rest."""
    sides = match.field_sides(pairings, fields, entities, scope)
    most = match.most_of_scope(scope, sides, pairings, proposals)
    candidates = match.candidates_of(sides, scope, most=most.pairs)
    heuristic = match.heuristic_pairs(candidates, scope, most.pairs).select(*scope, "c_ord", "p_ord", *PAIR_COLUMNS)
    if proposals is None:
        return MappingPlan(pairings, fields, heuristic, None, engine, scope, sides)
    validated = written(match.judge_proposals(proposals, pairings, sides, scope, most), "validated")
    accepted = match.accepted_pairs(validated, scope).select(*heuristic.columns)
    notes = validated.filter(F.col("note").isNotNull()).select(*scope, "ord", "note")
    pairs = written(match.fill_gaps(accepted, heuristic, scope, most), "pairs")  # read by every table of the plan
    return MappingPlan(pairings, fields, pairs, notes, engine, scope, sides)
