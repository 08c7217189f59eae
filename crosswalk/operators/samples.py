"""Deterministic sample records of catalog entities, as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosswalk.functions.values import json_text, name_seed, sample_scalar
from crosswalk.operators.match import lookup_entity
from crosswalk.operators.skew import spread_missing, unbounded
from crosswalk.session import written

MAX_DEPTH = 3


def sample_fields(fields: DataFrame, entities: DataFrame) -> DataFrame:
    """What the sample of a field depends on: its seed, its list nesting, and what its innermost type refers to."""
    inner = F.regexp_replace(F.regexp_replace("type", "^(list<)+", ""), ">+$", "")
    nesting = F.size(F.split("type", "list<")) - 1
    known = lookup_entity(entities).select("service", F.col("entity").alias("_ref"), F.col("kind").alias("ref_kind"),
                                           F.col("values").alias("ref_values"))
    ref = F.when(F.col("inner").startswith("ref:"), F.substr(F.col("inner"), F.lit(5)))
    return (fields.withColumn("inner", inner).withColumn("nesting", nesting).withColumn("seed", name_seed(F.col("name")))
            .withColumn("ref", ref).withColumn("_ref", spread_missing(ref, F.col("service"), F.col("entity"), F.col("name")))
            .join(unbounded(known), ["service", "_ref"], "left").drop("_ref"))


def sample_values(fields: DataFrame, entities: DataFrame) -> DataFrame:
    """Sample of every field whose type is a scalar, an enum or a list of these, as JSON text in ``sample``."""
    rows = sample_fields(fields, entities)
    return rows.filter(~_is_record()).select("service", "entity", "field_ord", "name", "json_name",
                                             _in_lists(_flat_value()).alias("sample"))


def _is_record():
    return F.coalesce(F.col("ref_kind") != "enum", F.lit(False))


def _flat_value():
    """Value of a type that is no record: an enum constant chosen by the seed, or a scalar."""
    count = F.size("ref_values")
    pick = F.try_element_at("ref_values", (F.pmod(F.col("seed"), F.greatest(count, F.lit(1))) + 1).cast("int"))
    enum = F.when(count > 0, json_text(pick))
    return (F.when(F.col("ref_kind") == "enum", F.coalesce(enum, F.lit("null")))
            .when(F.col("ref").isNotNull(), F.lit("null"))
            .otherwise(sample_scalar(F.col("inner"), F.col("name"), F.col("seed"))))


def _in_lists(value):
    return F.concat(F.repeat(F.lit("["), F.col("nesting")), value, F.repeat(F.lit("]"), F.col("nesting")))


def sample_entities(fields: DataFrame, entities: DataFrame) -> DataFrame:
    """One sample record per class or record: ``service, entity, sample``. Records nest three levels deep; a reference
    below that is null. Each level is built from the finished records of the level under it; only fields that refer to records are
    joined with these, the others are the same at every level."""
    rows = written(sample_fields(fields, entities), "samples")  # read by every level
    declared = lookup_entity(entities).filter(F.col("kind") != "enum").select("service", "entity")
    built: dict[int, DataFrame] = {}

    def items(some: DataFrame, value: Column) -> DataFrame:
        return some.select("service", "entity", "field_ord", F.concat(json_text(F.col("json_name")), F.lit(": "), _in_lists(value)).alias("kv"))

    flat = items(rows.filter(~_is_record()), _flat_value())
    for depth in range(MAX_DEPTH, -1, -1):
        # a list uses up a level of its own, so the level a reference finds depends on its nesting
        inner_depth = F.col("nesting") + depth + 1
        staged = rows.filter(_is_record()).withColumns({"_at": inner_depth, "_ref": F.col("ref")})
        if built:
            below = None
            for d, records in built.items():
                part = records.select("service", F.col("entity").alias("_ref"), F.lit(d).alias("_at"),
                                      F.col("sample").alias("_inner"))
                below = part if below is None else below.unionByName(part)
            staged = staged.join(unbounded(below), ["service", "_ref", "_at"], "left")
        else:
            staged = staged.withColumn("_inner", F.lit(None).cast("string"))
        joined = (flat.unionByName(items(staged, F.coalesce("_inner", F.lit("null")))).groupBy("service", "entity")
                  .agg(F.array_sort(F.collect_list(F.struct("field_ord", "kv"))).alias("_kv"))
                  .select("service", "entity", F.concat(F.lit("{"), F.array_join(F.transform("_kv", lambda x: x["kv"]), ", "),
                                                        F.lit("}")).alias("sample")))
        records = declared.join(unbounded(joined), ["service", "entity"], "left").select(
            "service", "entity", F.coalesce("sample", F.lit("{}")).alias("sample"))
        built[depth] = written(records, "records") if depth else records
    return built[0]
