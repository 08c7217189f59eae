"""Walks over edge tables: everything reachable, and dependencies in an order that can be built."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosswalk.functions.names import package_key, requirement_name
from crosswalk.operators.match import lookup_entity
from crosswalk.session import cut_lineage


def reachable(edges: DataFrame, roots: DataFrame, scope: list[str] = ()) -> DataFrame:
    """Nodes reachable from the roots of each scope over ``edges(src, dst)``, the roots included.

    Only nodes first seen in the last step look for neighbours in the next one. As many steps as the longest
    shortest path; cycles end by themselves because seen nodes are not visited again."""
    scope = list(scope)
    edges = cut_lineage(edges.select("src", "dst").distinct())  # read once per step
    frontier = cut_lineage(roots.select(*scope, "node").distinct())
    steps = [frontier]
    seen = frontier
    while True:
        found = (frontier.withColumnRenamed("node", "src").join(edges, "src")
                 .select(*scope, F.col("dst").alias("node")).distinct()
                 .join(seen, [*scope, "node"], "left_anti"))
        frontier = cut_lineage(found)
        if frontier.isEmpty():
            return reduce(DataFrame.unionByName, steps)
        steps.append(frontier)
        # a long chain of small steps is folded, so that the list of files to read stays short
        if len(steps) >= 16:
            steps = [cut_lineage(reduce(DataFrame.unionByName, steps))]
        seen = reduce(DataFrame.unionByName, steps)


def requirement_edges(requirements: DataFrame) -> DataFrame:
    """Edges between package keys from ``(name, requirement)`` lines; lines of extras and unreadable lines drop out."""
    return (requirements.select(package_key(F.col("name")).alias("src"),
                                package_key(requirement_name(F.col("requirement"))).alias("dst"))
            .filter(F.col("dst").isNotNull()))


def dependency_closure(packages: DataFrame, requirements: DataFrame, roots: DataFrame, scope: list[str] = ()) -> DataFrame:
    """Packages and versions needed by the roots, directly or not: scope columns, ``name``, ``version``.

    ``packages`` are the known ones (name, version). An unknown package is left out with everything only it needs."""
    known = packages.groupBy(package_key(F.col("name")).alias("node")).agg(F.min("version").alias("version"))
    edges = requirement_edges(requirements).join(known.select(F.col("node").alias("dst")), "dst", "left_semi")
    start = roots.select(*scope, package_key(F.col("name")).alias("node")).join(known.select("node"), "node", "left_semi")
    return reachable(edges, start, scope).join(known, "node").select(*scope, F.col("node").alias("name"), "version")


def sorted_pins(closure: DataFrame, scope: list[str] = ()) -> DataFrame:
    """``name==version`` lines in name order."""
    return closure.orderBy(*scope, "name").select(*scope, "name", F.format_string("%s==%s", "name", "version").alias("pin"))


def entity_references(fields: DataFrame) -> DataFrame:
    """Edges between entities from ``ref:`` anywhere in a field type; references to the entity itself are left out."""
    refs = F.regexp_extract_all(F.col("type"), F.lit(r"ref:(\w+)"), F.lit(1))
    return (fields.select("service", F.col("entity").alias("src"), F.explode(refs).alias("dst"))
            .filter(F.col("src") != F.col("dst")).distinct())


def entity_closure(entities: DataFrame, fields: DataFrame, roots: DataFrame) -> DataFrame:
    """Entities a root needs, enums left out, dependencies first: ``service, root, entity, level``.

    ``roots`` has ``service`` and ``root``. An entity is one level above the highest one it refers to. Entities on a
    reference cycle have no such order; they and what depends on them get no level."""
    kept = lookup_entity(entities).filter(F.col("kind") != "enum").select("service", "entity")
    refs = entity_references(fields)
    usable = (refs.join(kept.withColumnRenamed("entity", "dst"), ["service", "dst"], "left_semi")
              .join(kept.withColumnRenamed("entity", "src"), ["service", "src"], "left_semi"))
    edges = usable.select(F.struct("service", F.col("src").alias("entity")).alias("src"),
                          F.struct("service", F.col("dst").alias("entity")).alias("dst"))
    start = (roots.select("service", "root", F.col("root").alias("entity")).join(kept, ["service", "entity"], "left_semi")
             .select("service", "root", F.struct("service", "entity").alias("node")))
    nodes = reachable(edges, start, ["service", "root"]).select("service", "root", F.col("node.entity").alias("entity"))
    inner = (usable.select("service", F.col("src").alias("entity"), "dst").join(nodes, ["service", "entity"])
             .select("service", "root", "entity", "dst"))
    keys = ["service", "root", "entity"]
    waiting, needs, level, done = cut_lineage(nodes), cut_lineage(inner), 0, []
    while True:
        ready = waiting.join(needs, keys, "left_anti")
        placed = cut_lineage(ready.withColumn("level", F.lit(level)))
        if placed.isEmpty():
            rest = waiting.withColumn("level", F.lit(None).cast("int"))
            return reduce(DataFrame.unionByName, [*done, rest])
        done.append(placed)
        waiting = cut_lineage(waiting.join(placed, keys, "left_anti"))
        needs = cut_lineage(needs.join(placed.select("service", "root", F.col("entity").alias("dst")),
                                       ["service", "root", "dst"], "left_anti"))
        level += 1
