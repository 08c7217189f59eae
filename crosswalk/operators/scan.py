"""Scanning the changed rows of a table: delta scope, text rules, and package advisories."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from crosswalk.functions.names import package_key
from crosswalk.operators.places import with_places
from crosswalk.operators.rules import Rules
from crosswalk.operators.skew import key_counts, salted_join

#: Rules of one automaton, and so of one broadcast; texts whose hits are handed on at once.
RULES_PER_AUTOMATON, TEXTS_AT_ONCE = 100_000, 256
#: Places of the order of versions that are joined together.
BLOCK = 512


def delta_scope(df: DataFrame, delta: DataFrame | None, keys: list[str]) -> DataFrame:
    """Only the rows of the delta; all rows where no delta is given."""
    return df if delta is None else df.join(delta.select(*keys).distinct(), keys, "left_semi")


def changed_rows(current: DataFrame, previous: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``current`` that are new or differ from the row with the same key in ``previous``."""
    content = F.sha2(F.to_json(F.struct(*[c for c in current.columns if c not in keys])), 256)
    seen = previous.select(*keys, content.alias("_content"))
    return current.withColumn("_content", content).join(seen, [*keys, "_content"], "left_anti").drop("_content")


def scan_rules(texts: DataFrame, rules: Sequence[tuple[str, str]] | DataFrame, keys: list[str], text: str = "text",
               rules_per_automaton: int = RULES_PER_AUTOMATON) -> DataFrame:
    """Every (rule, line) hit of regular-expression rules in a text column: key columns, ``rule``, ``line`` from 1.

    From each pattern a literal is taken that every match must have; each task finds the literals of all rules in one pass over a
    text (Aho-Corasick) and asks a rule only where its literal stands. Rules without one are asked of every line of the texts
    they match. However many rules there are, texts are read once and not shuffled: the rules, which are configuration, pass the
    driver, and come to the tasks in automata of ``rules_per_automaton`` rules. Whole texts are looked at; null texts have no
    lines, keys may repeat or be null. A stateless step, so it runs on streams too. Patterns are Python's, with ASCII classes."""
    listed = [tuple(r) for r in rules.select("rule", "pattern").collect()] if isinstance(rules, DataFrame) else list(rules)
    spark, n = texts.sparkSession, len(keys)
    parts = [spark.sparkContext.broadcast(listed[at:at + rules_per_automaton]) for at in range(0, len(listed), rules_per_automaton)]
    rows = texts.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(text).cast("string").alias("text"))
    schema = StructType([*rows.schema.fields[:n], StructField("rule", StringType()), StructField("line", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [Rules(part.value) for part in parts]
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                some = batch.slice(at, TEXTS_AT_ONCE)
                found = [(i, *hit) for i, t in enumerate(some.column(n)) if t.is_valid for text_ in [t.as_py()] for part in ready for hit in part(text_)]
                if found:
                    row = pa.array([f[0] for f in found])
                    yield pa.RecordBatch.from_arrays([*[c.take(row) for c in some.columns[:n]], pa.array([f[1] for f in found], pa.string()),
                                                      pa.array([f[2] for f in found], pa.int32())], schema.names)
    return rows.mapInArrow(run, schema).select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "rule", "line")


_PRE = r"(?i)(?<=[0-9])[-._]?(dev|alpha|a|beta|b|preview|pre|rc|c)[-._]?(\d*)([-+.].*)?$"


def version_parts(version: Column) -> Column:
    """``1.10.2`` as numbers, so that versions compare number by number; null stays null. Zeros at the end do not count
    (``1.0`` is ``1.0.0``), parts that are no number are 0, numbers may have 38 digits, and dev, alpha, beta and release
    candidates come in this order before their release."""
    none = F.lit(0).cast("decimal(38,0)")

    def number(part: Column) -> Column:
        return F.coalesce(part.try_cast("decimal(38,0)"), none)

    def parts(numbers: Column, rank: Column, count: Column) -> Column:
        def made(n: Column) -> Column:
            used = F.coalesce(F.array_max(F.transform(n, lambda x, i: F.when(x != 0, i + 1))), F.lit(0))
            return F.struct(F.filter(n, lambda x, i: i < used).alias("numbers"), rank.alias("rank"), count.alias("count"))
        return F.get(F.transform(F.array(numbers), made), F.lit(0))
    kind = F.lower(F.regexp_extract(version, _PRE, 1))
    rank = (F.when(kind == "", F.lit(0)).when(kind == "dev", F.lit(-4)).when(kind.startswith("a"), F.lit(-3))
            .when(kind.startswith("b"), F.lit(-2)).otherwise(F.lit(-1)))
    mixed = parts(F.transform(F.split(F.regexp_replace(version, _PRE, ""), r"\."), lambda p: number(F.regexp_extract(p, r"^\d+", 0))), rank,
                  number(F.regexp_extract(version, _PRE, 2)))
    plain = parts(F.transform(F.split(version, r"\."), number), F.lit(0), none)
    return F.when(version.rlike(r"^[0-9]+(?:\.[0-9]+)*$"), plain).when(version.isNotNull(), mixed)


def match_advisories(packages: DataFrame, advisories: DataFrame, keys: list[str]) -> DataFrame:
    """Packages with an affected version and the advisory: key columns, ``advisory``, ``item``.

    ``packages`` has ``name`` and ``version``; ``advisories`` has ``advisory``, ``name``, ``introduced`` (null: from
    the first version on) and ``fixed`` (null: never). Distinct (name, version) and the two ends of every range are sorted together, package
    by package, so that a range is a run of places, and the versions in it are found by place: ranges meet no version outside them but
    in their first and last block, however many a package has. Only the affected versions meet the package rows again, with popular
    ones split. Rows without name or version match nothing; repeated rows and advisories stay repeated."""
    counted = key_counts(packages, ["name", "version"])
    versions = counted.filter("name IS NOT NULL AND version IS NOT NULL").select(
        package_key(F.col("name")).alias("_key"), F.lit(False).alias("_open"), version_parts(F.col("version")).alias("_v"), F.lit(1).alias("_side"),
        F.lit(1).cast("bigint").alias("_copies"), F.struct("name", "version", *[F.lit(None).cast("string").alias(c) for c in ("advisory", "introduced", "fixed")]).alias("_what"))
    known = (advisories.filter("name IS NOT NULL").groupBy(package_key(F.col("name")).alias("_key"), "advisory", "introduced", "fixed")
             .agg(F.count(F.lit(1)).alias("_copies")))
    what = F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("version"), "advisory", "introduced", "fixed")
    # an end stands before the versions that are equal to it; no first version is before all others, no fixed one behind all
    ends = F.explode(F.array(*[F.struct(open_.alias("_open"), version_parts(F.col(c)).alias("_v"), F.lit(side).alias("_side")) for c, open_, side in (
        ("introduced", F.lit(False), -1), ("fixed", F.col("fixed").isNull(), 0))]))
    ranges = known.select("_key", ends.alias("_end"), "_copies", what.alias("_what")).select("_key", "_end.*", "_copies", "_what")
    placed = with_places(versions.unionByName(ranges), [F.col("_key"), F.col("_open"), F.col("_v"), F.col("_side")], "_place")
    runs = (placed.filter("_side < 1").groupBy("_key", "_what", "_copies").agg(F.min(F.when(F.col("_side") < 0, F.col("_place"))).alias("_from"),
                                                                            F.max(F.when(F.col("_side") == 0, F.col("_place"))).alias("_to")))
    blocks = runs.filter("_from < _to").select(F.col("_what.advisory").alias("advisory"), "_copies", "_from", "_to", F.explode(
        F.sequence(F.floor(F.col("_from") / BLOCK), F.floor(F.col("_to") / BLOCK))).alias("_block"))
    found = placed.filter("_side = 1").select("_what.name", "_what.version", "_place", F.floor(F.col("_place") / BLOCK).alias("_block"))
    affected = (found.join(blocks, "_block").filter("_from < _place AND _place < _to")
                .select("name", "version", F.explode(F.array_repeat("advisory", F.col("_copies").cast("int"))).alias("advisory")))
    # one version of one package has few advisories, however many packages use it: only the package side can be hot
    hits = salted_join(packages, affected, ["name", "version"], keys, ["advisory"], left_counts=counted, split_right=False)
    return hits.select(*keys, "advisory", F.concat("advisory", F.lit(" "), "name", F.lit("@"), "version").alias("item"))
