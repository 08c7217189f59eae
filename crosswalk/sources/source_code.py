"""Catalog tables from source files: per-file reading in the tasks, meaning by joins and column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from crosswalk.functions import paths, types
from crosswalk.operators.places import with_places
from crosswalk.operators.skew import spread_missing, unbounded
from crosswalk.session import cut_lineage, written
from crosswalk.sources import declarations as readers
from crosswalk.sources.catalog import Catalog, detect_language, extract_port

# Parts of a path whose files are not looked at, and what makes a Python class a model or an enum.
SKIPPED_PARTS = {"java": ["test"], "python": [".venv", "venv", "tests", "__pycache__", "crosswalk_generated"]}
SUFFIXES = {"java": ".java", "python": ".py"}
MODEL_BASES = ["BaseModel", "SQLModel"]
ENUM_BASES = ["Enum", "StrEnum", "IntEnum"]
CONTROLLER_MARKS = ["RestController", "Controller"]
PYTHON_VERBS = ["get", "post", "put", "patch", "delete"]
WIRE_KEYWORDS = ["alias", "serialization_alias"]

RAW_COLUMNS = {"row_kind": "string", "name": "string", "owner": "string", "type_text": "string", "wire": "string",
               "flag": "boolean", "line": "int", "method": "string", "path": "string", "java_kind": "string",
               "bases": "array<string>", "marks": "array<string>", "values": "array<string>", "callee": "string",
               "keys": "array<string>", "texts": "array<string>", "constants": "array<string>"}
RAW_DDL = "service STRING, file STRING, seq INT, " + ", ".join(f"`{c}` {t}" for c, t in RAW_COLUMNS.items())

ROWS_PER_BATCH = 10_000

# What a service of a language is built with.
FRAMEWORKS = {"java": "spring-boot", "python": "fastapi"}

Extractor = Callable[[str], Iterator[dict]]
Meaning = Callable[[DataFrame, str], "Declared"]
EXTRACTORS: dict[str, Extractor] = {"java": readers.java_declarations, "python": readers.python_declarations}
cloudpickle.register_pickle_by_value(readers)  # the readers travel with the job, executors need not have them installed


def register_extractor(language: str, suffix: str, extractor: Extractor, meaning: Meaning | None = None, framework: str = "") -> None:
    """Add a language: a function from the text of one file to declaration rows (see ``RAW_COLUMNS``). ``meaning`` makes the tables
    of these rows (``java_meaning`` or ``python_meaning`` where the reader reports what theirs do; Java's by default)."""
    EXTRACTORS[language] = extractor
    SUFFIXES[language] = suffix
    MEANINGS[language] = meaning or java_meaning
    FRAMEWORKS[language] = framework


@dataclass
class Declared:
    """What sources of one language declare. ``entities`` and ``endpoints`` have the place ``(file, seq)`` of each; ``params`` have the
    ``route_seq`` of the endpoint they belong to."""
    raw: DataFrame
    entities: DataFrame
    fields: DataFrame
    endpoints: DataFrame
    params: DataFrame


@dataclass
class ExtractedCatalog:
    entities: DataFrame
    fields: DataFrame
    endpoints: DataFrame
    params: DataFrame
    errors: DataFrame


def scan_source_files(spark: SparkSession, root: str, language: str, service: str) -> DataFrame:
    """Files of a language under a root: ``service``, ``file`` (relative path), ``text``."""
    suffix = SUFFIXES[language]
    files = (spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=f"*{suffix}")
             .select(F.url_decode(F.col("_metadata.file_path")).alias("uri"), F.col("value").alias("text")))
    marker = root.rstrip("/") + "/"
    rel = F.expr(f"substring(uri, locate({_quoted(marker)}, uri) + {len(marker)})")
    return select_source_files(files.select(F.lit(service).alias("service"), rel.alias("file"), "text"), language)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def select_source_files(files: DataFrame, language: str) -> DataFrame:
    """Files with the suffix of the language and without a skipped part in their path."""
    skipped = F.array(*[F.lit(p) for p in SKIPPED_PARTS.get(language, [])])
    return files.filter(F.col("file").endswith(SUFFIXES[language]) & ~F.arrays_overlap(F.split("file", "/"), skipped))


def declarations(files: DataFrame, language: str) -> DataFrame:
    """Raw declaration rows of every file. A file that cannot be read becomes one row of kind ``error``."""
    extract = EXTRACTORS[language]
    schema = StructType.fromDDL(RAW_DDL)
    kinds = to_arrow_schema(schema)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(values, field.type) for field, values in zip(kinds, zip(*rows))], kinds.names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for service, file, text in zip(*batch.columns):
                try:
                    found = list(extract(text.as_py() or ""))
                except (SyntaxError, ValueError, RecursionError) as problem:
                    found = [{"row_kind": "error", "name": type(problem).__name__, "type_text": str(problem)}]
                service, file = service.as_py(), file.as_py()
                rows += [(service, file, seq, *[r.get(c) for c in RAW_COLUMNS]) for seq, r in enumerate(found)]
                if len(rows) >= ROWS_PER_BATCH:
                    yield table(rows)
                    rows = []
        if rows:
            yield table(rows)

    return files.select("service", "file", "text").mapInArrow(read, schema)


def _first_of_each(entities: DataFrame) -> DataFrame:
    """Of entities of one name in a service the first by file and place: a lookup by name finds that one, so fields are its."""
    firsts = entities.groupBy("service", "name").agg(F.min(F.struct("file", "seq")).alias("_first"))
    return (entities.join(unbounded(firsts), ["service", "name"])
            .filter((F.col("file") == F.col("_first.file")) & (F.col("seq") == F.col("_first.seq"))).drop("_first"))


def resolve_refs(rows: DataFrame, parts: Column, known: DataFrame, out: str) -> DataFrame:
    """Adds the canonical type ``out`` from peeled type parts: a name declared anywhere in the service is a
    reference, any other name is ``object``. ``known`` has one row per service and name, so hot services
    only make the rows side large, which adaptive skew handling splits."""
    staged = rows.withColumn("_parts", parts)
    lookup = F.when(F.col("_parts.scalar").isNull(), F.col("_parts.name"))
    keyed = staged.withColumn("_ref", spread_missing(lookup, F.col("service"), F.col("name"), F.col("type_text")))
    found = known.select("service", F.col("name").alias("_ref"), F.lit(True).alias("_known"))
    return (keyed.join(unbounded(found), ["service", "_ref"], "left")
            .withColumn(out, types.canonical_text(F.col("_parts"), F.coalesce("_known", F.lit(False))))
            .drop("_ref", "_known"))


def _ordered(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Ordinals that follow the file and declaration order of a service, without collecting a service in one task."""
    return rows.orderBy(*keys).withColumn(name, F.monotonically_increasing_id())


def _entity_columns(ordinal: str) -> list:
    no_values = F.array().cast("array<string>")
    return ["service", ordinal, F.col("name").alias("entity"), "kind", "file", "line",
            F.when(F.col("kind") == "enum", F.coalesce("values", no_values)).otherwise(no_values).alias("values")]


def _field_columns(ordinal: Column) -> list:
    return ["service", F.col("owner").alias("entity"), ordinal.cast("bigint").alias("field_ord"), "name",
            F.coalesce("wire", "name").alias("json_name"), "type", F.col("type_text").alias("source_type"), "optional"]


def _endpoint_columns(ordinal: str) -> list:
    return ["service", ordinal, "method", F.col("full_path").alias("path"), F.col("name").alias("handler"),
            types.normalize_return(F.col("type")).alias("returns"), "file", "line"]


def _errors(raw: DataFrame) -> DataFrame:
    return raw.filter(F.col("row_kind") == "error").select(
        "service", "file", F.col("name").alias("error"), F.col("type_text").alias("message"))


def _finish(d: Declared) -> ExtractedCatalog:
    return ExtractedCatalog(
        entities=_ordered(d.entities, ["service", "file", "seq"], "entity_ord").select(*_entity_columns("entity_ord")),
        fields=d.fields.select(*_field_columns(F.col("seq"))),
        endpoints=_ordered(d.endpoints, ["service", "file", "seq"], "ep_ord").select(*_endpoint_columns("ep_ord")),
        params=d.params.select("service", "file", F.col("owner").alias("handler"), F.col("seq").alias("param_ord"), "name",
                               "location", "type"),
        errors=_errors(d.raw),
    )


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    """Ordinals from 0 without gaps within each service, by file and declaration: places in one order of all services less the
    first place of the service. Nothing is ordered by one task, however large a service is."""
    placed = with_places(rows, [F.col("service"), F.col("file"), F.col("seq")], "_place")
    firsts = placed.groupBy("service").agg(F.min("_place").alias("_first"))
    return placed.join(unbounded(firsts), "service").withColumn(name, F.col("_place") - F.col("_first")).drop("_place", "_first")


def extracted_catalog(files: DataFrame, services: DataFrame) -> tuple[Catalog, DataFrame]:
    """The five catalog tables of source files, and the files that could not be read.

    ``files`` has ``service, file, text``, ``services`` the columns of its catalog table. The language of a service says which reader
    gets its files, by suffix, skipped parts of paths left out; registered languages take part. Entities and endpoints are numbered
    from 0 within their service, fields and parameters within their owner, all by file and declaration. Fields of same-named
    classes are those of the first."""
    spoken = files.join(unbounded(services.select("service", "language")), "service")
    # the join deals files out by service, of which there may be few; they are spread before they are read
    spoken = spoken.repartition(4 * files.sparkSession.sparkContext.defaultParallelism, "service", "file")
    found = [MEANINGS[language](select_source_files(spoken.filter(F.col("language") == language), language), language)
             for language in EXTRACTORS]

    def all_of(part: Callable[[Declared], DataFrame], *columns: str | Column) -> DataFrame:
        return reduce(DataFrame.unionByName, [part(d).select(*columns) for d in found])

    entities = _numbered(all_of(lambda d: d.entities, "service", "file", "seq", "name", "kind", "line", "values"), "entity_ord")
    endpoints = _numbered(all_of(lambda d: d.endpoints, "service", "file", "seq", "method", "full_path", "name",
                                 "type", "line"), "ep_ord")
    fields = all_of(lambda d: d.fields, "service", "file", "seq", "owner", "name", "wire", "type", "type_text", "optional")
    params = all_of(lambda d: d.params, "service", "file", "seq", "route_seq", "name", "location", "type")
    field_place = F.row_number().over(Window.partitionBy("service", "file", "owner").orderBy("seq")) - 1
    param_place = F.row_number().over(Window.partitionBy("service", "file", "route_seq").orderBy("seq")) - 1
    routed = (params.withColumn("param_ord", param_place)
              .join(unbounded(endpoints.select("service", "file", F.col("seq").alias("route_seq"), "ep_ord")), ["service", "file", "route_seq"]))
    catalog = Catalog(
        services=services, entities=entities.select(*_entity_columns("entity_ord")),
        fields=fields.withColumn("_place", field_place).select(*_field_columns(F.col("_place"))),
        endpoints=endpoints.select(*_endpoint_columns("ep_ord")),
        params=routed.select("service", "ep_ord", "param_ord", "name", "location", "type"))
    return catalog, reduce(DataFrame.unionByName, [_errors(d.raw) for d in found])


def parse_services(files: DataFrame) -> tuple[Catalog, DataFrame]:
    """``extracted_catalog`` of whole source trees, ``files(service, root, file, text)``: languages by what the trees hold, ports by
    their configuration. Trees of no known language get an error row without a file."""
    spoken = detect_language(files.select("root", F.col("file").alias("path")))
    trees = files.select("service", "root").distinct().join(unbounded(spoken), "root")
    known = trees.filter(F.col("language").isNotNull())
    ports = extract_port(files.join(unbounded(known.select("service", "root", "language")), ["service", "root"])
                         .select("service", "language", F.col("file").alias("path"), "text"))
    framework = F.coalesce(*[F.when(F.col("language") == k, F.lit(v)) for k, v in FRAMEWORKS.items()], F.lit(""))
    services = cut_lineage(known.join(unbounded(ports), "service").select("service", "language", framework.alias("framework"), "root", "port"))
    catalog, errors = extracted_catalog(files.select("service", "file", "text"), services)
    unknown = trees.filter(F.col("language").isNull()).select(
        "service", F.lit(None).cast("string").alias("file"), F.lit("ValueError").alias("error"), F.col("error").alias("message"))
    return catalog, errors.unionByName(unknown)


def _last_part(dotted: Column) -> Column:
    return F.element_at(F.split(dotted, r"\."), -1)


def _argument(keywords: list[str], what: str) -> Column:
    """The first argument under one of the keywords that has a ``what`` (``texts`` or ``constants``)."""
    fitting = F.filter(F.arrays_zip("keys", what), lambda a: a["keys"].isin(keywords) & a[what].isNotNull())
    return F.get(fitting, F.lit(0))[what]


def python_meaning(files: DataFrame, language: str = "python") -> Declared:
    """Models, dataclasses, enums and routes of Python sources."""
    raw = written(declarations(files, language), "declarations")  # read by every table, parsed once
    constants = (raw.filter(F.col("row_kind") == "constant").groupBy("service", "file", F.col("owner").alias("name"))
                 .agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "name"))), lambda c: c["name"]).alias("values")))
    classes = (raw.filter(F.col("row_kind") == "class").drop("values")
               .withColumns({c: F.transform(c, _last_part) for c in ("bases", "marks")})
               .join(unbounded(constants), ["service", "file", "name"], "left"))
    known = classes.select("service", "name").distinct()
    bases = classes.select("service", "file", "seq", F.explode("bases").alias("name"))
    derived = bases.join(unbounded(known), ["service", "name"], "left_semi").select("service", "file", "seq").distinct()
    is_enum = F.arrays_overlap("bases", F.array(*map(F.lit, ENUM_BASES)))
    is_model = (F.arrays_overlap("bases", F.array(*map(F.lit, MODEL_BASES))) | F.array_contains("marks", "dataclass")
                | F.coalesce("_derived", F.lit(False)))
    entities = (classes.join(unbounded(derived.withColumn("_derived", F.lit(True))), ["service", "file", "seq"], "left")
                .withColumn("kind", F.when(is_enum, F.lit("enum")).when(is_model, F.lit("class")))
                .filter(F.col("kind").isNotNull()))
    parts = types.python_type_parts(F.col("type_text"))
    owners = _first_of_each(entities.filter(F.col("kind") == "class")).select("service", "file", F.col("name").alias("owner"))
    visible = raw.filter((F.col("row_kind") == "field") & ~F.col("name").startswith("_")
                         & ~F.col("type_text").rlike(r"^([\w.]+\.)?ClassVar$"))
    wired = visible.withColumn("wire", F.when(_last_part(F.col("callee")) == "Field", _argument(WIRE_KEYWORDS, "constants")))
    fields = (resolve_refs(wired.join(unbounded(owners), ["service", "file", "owner"], "left_semi"), parts, known, "type")
              .withColumn("optional", F.col("_parts.optional") | F.coalesce("flag", F.lit(False))))
    verb = _last_part(F.col("callee"))
    unnamed = F.when(F.get("keys", F.lit(0)) == "", F.get("constants", F.lit(0)))
    routes = (raw.filter((F.col("row_kind") == "decorator") & F.col("callee").contains(".") & verb.isin(PYTHON_VERBS))
              .withColumns({"method": F.upper(verb), "path": F.coalesce(unnamed, F.lit("/")),
                            "type_text": F.coalesce(_argument(["response_model"], "texts"), "type_text")}))
    endpoints = resolve_refs(routes, parts, known, "_type").withColumn(
        "type", F.when(F.col("type_text").isNotNull(), F.col("_type"))).withColumn("full_path", F.col("path"))
    handled = (raw.filter(F.col("row_kind") == "argument").drop("path")
               .join(unbounded(routes.select("service", "file", "owner", "line", "path", F.col("seq").alias("route_seq"))),
                     ["service", "file", "owner", "line"]))
    params = resolve_refs(handled, parts, known, "type").withColumn(
        "location", paths.param_location(F.col("name"), F.col("type"), F.col("path")))
    return Declared(raw, entities, fields, endpoints, params)


def extract_python_catalog(files: DataFrame) -> ExtractedCatalog:
    return _finish(python_meaning(files))


def java_meaning(files: DataFrame, language: str = "java") -> Declared:
    """Classes, records, enums and controller routes of Java sources. A class with routes is no entity, nor is a
    class without fields. Parameters follow the route they belong to."""
    raw = written(declarations(files, language), "declarations")  # read by every table, parsed once
    types_rows = raw.filter((F.col("row_kind") == "class") & F.col("java_kind").isin("class", "record", "enum"))
    known = types_rows.select("service", "name").distinct()
    members = raw.groupBy("service", "file", "owner").agg(
        F.bool_or(F.col("row_kind") == "field").alias("has_fields"),
        F.bool_or(F.col("row_kind") == "endpoint").alias("has_routes")).filter(F.col("owner").isNotNull())
    shaped = types_rows.join(unbounded(members.withColumnRenamed("owner", "name")), ["service", "file", "name"], "left")
    is_controller = F.coalesce(F.arrays_overlap("marks", F.array(*map(F.lit, CONTROLLER_MARKS))), F.lit(False)) \
        & F.coalesce("has_routes", F.lit(False)) & (F.col("java_kind") == "class")
    shaped = shaped.withColumn("is_controller", is_controller)
    entities = (shaped.filter(~F.col("is_controller")
                              & ((F.col("java_kind") != "class") | F.coalesce("has_fields", F.lit(False))))
                .withColumn("kind", F.col("java_kind")))
    parts = types.java_type_parts(F.col("type_text"))
    controllers = shaped.filter("is_controller").select("service", "file", F.col("name").alias("owner"),
                                                        F.col("path").alias("prefix"))
    visible = raw.filter(F.col("row_kind") == "field").join(
        unbounded(_first_of_each(entities).select("service", "file", F.col("name").alias("owner"))), ["service", "file", "owner"], "left_semi")
    fields = resolve_refs(visible, parts, known, "type").withColumn("optional", F.coalesce("flag", F.lit(False)))
    routes = raw.filter(F.col("row_kind") == "endpoint").join(unbounded(controllers), ["service", "file", "owner"])
    endpoints = resolve_refs(routes, parts, known, "type").withColumn(
        "full_path", paths.join_path(F.col("prefix"), F.col("path")))
    location = F.coalesce(*[F.when(F.array_contains("marks", mark), F.lit(place))
                            for mark, place in paths.JAVA_PARAM_LOCATIONS.items()])
    before = Window.partitionBy("service", "file").orderBy("seq")
    route_seq = F.last(F.when(F.col("row_kind") == "endpoint", F.col("seq")), ignorenulls=True).over(before)
    bound = (raw.filter(F.col("row_kind").isin("endpoint", "param")).withColumn("route_seq", route_seq)
             .filter(F.col("row_kind") == "param").withColumn("location", location).filter(F.col("location").isNotNull())
             .join(unbounded(routes.select("service", "file", F.col("seq").alias("route_seq"))), ["service", "file", "route_seq"], "left_semi"))
    return Declared(raw, entities, fields, endpoints, resolve_refs(bound, parts, known, "type"))


def extract_java_catalog(files: DataFrame) -> ExtractedCatalog:
    return _finish(java_meaning(files))


MEANINGS: dict[str, Meaning] = {"java": java_meaning, "python": python_meaning}
