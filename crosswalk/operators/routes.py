"""Requests against path templates, by a trie of their segments."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from crosswalk.functions.paths import request_path
from crosswalk.session import written

#: Routes of one trie, and so of one broadcast. More routes are more tries, asked one after the other.
ROUTES_PER_TRIE = 100_000
_PLAIN = re.compile(r"[A-Za-z0-9_~-]*", re.ASCII)
_VARIABLE = re.compile(r"\{\w+\}", re.ASCII)
#: What may stand in a template without moving the bounds of the segments before it.
_TAME = re.compile(r"(?:[A-Za-z0-9_~/.-]|\{\w+\})*", re.ASCII)
_ANY = None


def order(route: tuple) -> tuple:
    """Routes ``(ep_ord, path, handler)`` in the order of their declaration, those without a number first."""
    number, path, handler = route
    return number is not None, number or 0, path, handler or ""


class Trie:
    """Nodes have children by segment (``_ANY``: a whole variable), the first route that ends there, and the routes whose next segment
    is a pattern of its own; those are asked as whole patterns."""

    def __init__(self, routes: list[tuple]):
        self.roots: dict[str, list] = {}
        for method, *route in sorted(routes, key=lambda r: order(r[1:])):
            node, route = self.roots.setdefault(method, self._node()), tuple(route)
            path = route[1]
            if not _TAME.fullmatch(path):
                node[2].append((self._pattern(path), route))
                continue
            for segment in path.split("/"):
                if _PLAIN.fullmatch(segment):
                    node = node[0].setdefault(segment, self._node())
                elif _VARIABLE.fullmatch(segment):
                    node = node[0].setdefault(_ANY, self._node())
                else:
                    node[2].append((self._pattern(path), route))
                    break
            else:
                node[1] = node[1] or route

    @staticmethod
    def _pattern(path: str) -> re.Pattern:
        return re.compile("^" + _VARIABLE.sub("[^/]+", path) + r"/?\Z")

    @staticmethod
    def _node() -> list:
        return [{}, None, []]

    def first(self, method: str | None, path: str | None) -> tuple | None:
        """The route of the smallest number that has the method and fits the path, with or without a slash at its end."""
        root = self.roots.get(method)
        if root is None or path is None:
            return None
        segments, best, found = path.split("/"), None, [root]
        for i, segment in enumerate([*segments, None]):
            following = []
            for children, ends, patterns in found:
                over = i == len(segments) or (i == len(segments) - 1 and i > 0 and segment == "")
                if over and ends is not None and (best is None or order(ends) < order(best)):
                    best = ends
                for pattern, route in patterns:
                    if best is not None and order(best) <= order(route):
                        break
                    if pattern.match(path):
                        best = route
                        break
                if segment is not None:
                    for step in (segment, _ANY) if segment else (segment,):
                        child = children.get(step)
                        if child is not None:
                            following.append(child)
            found = following
        return best


def match_routes(requests: DataFrame, routes: DataFrame, keys: list[str], url: str = "url", method: str = "method",
                 routes_per_trie: int = ROUTES_PER_TRIE) -> DataFrame:
    """The first declared route with the method and a matching template for each request, null where none matches.

    ``routes`` has ``ep_ord``, ``method``, ``path``, ``handler``; ``{name}`` stands for one segment or a part of one, other signs
    mean what they mean in a pattern, and a final slash of the request is optional. Each task asks a trie of the templates, so
    requests are not shuffled, a frequent path is no hot key, and the same plan runs on a batch and on a stream, with any number of
    routes: the first route of each method and template, which are the only ones that can match, pass the
    driver and come to the tasks in tries of ``routes_per_trie``. What a trie found in a batch is written before the next one is asked,
    so no task holds two; a stream asks them in one pass. Keys only pass through: they may repeat or be null, and
    requests without method or url match nothing."""
    spark = requests.sparkSession
    rows = requests.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(method).cast("string").alias("method"),
                           request_path(F.col(url)).alias("path"),
                           F.lit(None).cast("bigint").alias("ep_ord"), F.lit(None).cast("string").alias("route"),
                           F.lit(None).cast("string").alias("handler"))
    n, schema = len(keys), StructType([*rows.schema.fields[:len(keys) + 2], StructField("ep_ord", LongType()),
                                       StructField("route", StringType()), StructField("handler", StringType())])
    named = routes.filter("method IS NOT NULL AND path IS NOT NULL")
    first = F.min(F.struct(F.col("ep_ord").cast("bigint").alias("ep_ord"), F.coalesce("handler", F.lit("")).alias("_h"), "handler"))
    declared = named.groupBy("method", "path").agg(first.alias("_f")).select("method", "_f.ep_ord", "path", "_f.handler")

    def asked(rows: DataFrame, some: list[tuple]) -> DataFrame:
        shared = spark.sparkContext.broadcast(some)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trie = Trie(shared.value)
            for batch in batches:
                known: dict[tuple, tuple | None] = {}
                found = []
                for m, p, *before in zip(*(batch.column(i).to_pylist() for i in range(n, n + 5))):
                    if (m, p) not in known:
                        known[m, p] = trie.first(m, p)
                    hit = known[m, p]
                    found.append(before if hit is None or (before[1] is not None and order(before) <= order(hit)) else hit)
                columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n + 2], *columns], schema.names)
        return rows.mapInArrow(run, schema)
    listed = [tuple(r) for r in declared.collect()]
    for at in range(0, len(listed), routes_per_trie):
        rows = asked(rows if at == 0 or requests.isStreaming else written(rows, "routed"), listed[at:at + routes_per_trie])
    return rows.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "ep_ord", "route", "handler")
