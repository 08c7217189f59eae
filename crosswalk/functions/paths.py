"""Column expressions over URL paths and path templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameter annotations and the place they bind to.
JAVA_PARAM_LOCATIONS = {"PathVariable": "path", "RequestParam": "query", "RequestBody": "body"}


def route_pattern(template: Column) -> Column:
    """Regular expression of a path template: a variable is one path segment piece, a final slash is optional."""
    return F.concat(F.lit("^"), F.regexp_replace(template, r"\{\w+\}", "[^/]+"), F.lit("/?$"))


def request_path(url: Column) -> Column:
    """Path of a URL or of a request target, without query and fragment."""
    no_host = F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*", "")
    return F.substring_index(F.substring_index(no_host, "#", 1), "?", 1)


def join_path(prefix: Column, sub: Column) -> Column:
    parts = F.array(*[F.trim(F.coalesce(p, F.lit("")), F.lit("/")) for p in (prefix, sub)])
    return F.concat(F.lit("/"), F.array_join(F.filter(parts, lambda p: p != ""), "/"))


def path_vars(template: Column) -> Column:
    return F.regexp_extract_all(template, F.lit(r"\{(\w+)\}"), F.lit(1))


def param_location(name: Column, ctype: Column, template: Column) -> Column:
    """Where an undecorated handler argument comes from."""
    return (F.when(F.array_contains(path_vars(template), name), F.lit("path"))
            .when(ctype.startswith("ref:"), F.lit("body")).otherwise(F.lit("query")))


def slash_count(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
