"""Catalog tables from and to nested JSON, from Spark schemas, and the facts about a whole source tree."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from crosswalk import model
from crosswalk.functions.types import canonical_spark
from crosswalk.operators.skew import unbounded
from crosswalk.session import new_folder, written

# Ports used where a service does not state one.
DEFAULT_PORTS = {"java": 8080, "python": 8000}
# Build files that tell the language of a source tree, and the suffix of its sources.
LANGUAGE_MARKS = [("java", ["pom.xml", "build.gradle"], ".java"),
                  ("python", ["pyproject.toml", "requirements.txt"], ".py")]

# Lists are folded by so many bits of their ordinals before they are put together; about so many pieces make a range of services.
PIECE_BITS = 4
ROWS_PER_RANGE = 10_000


@dataclass
class Catalog:
    services: DataFrame
    entities: DataFrame
    fields: DataFrame
    endpoints: DataFrame
    params: DataFrame


def catalog_from_json(documents: DataFrame) -> Catalog:
    """Service documents, one per row in the nested layout, as the five catalog tables."""
    d = documents.withColumnRenamed("name", "service")
    ents = d.select("service", F.posexplode("entities").alias("entity_ord", "e"))
    eps = d.select("service", F.posexplode("endpoints").alias("ep_ord", "e"))
    return Catalog(
        services=d.select("service", "language", "framework", "root", "port"),
        entities=ents.select("service", F.col("entity_ord").cast("bigint").alias("entity_ord"),
                             F.col("e.name").alias("entity"), F.coalesce("e.kind", F.lit("class")).alias("kind"),
                             "e.file", "e.line", F.coalesce("e.values", F.array().cast("array<string>")).alias("values")),
        fields=ents.select("service", F.col("e.name").alias("entity"), F.posexplode("e.fields").alias("field_ord", "f"))
        .select("service", "entity", F.col("field_ord").cast("bigint").alias("field_ord"), "f.name", "f.json_name",
                "f.type", "f.source_type", F.coalesce("f.optional", F.lit(False)).alias("optional")),
        endpoints=eps.select("service", F.col("ep_ord").cast("bigint").alias("ep_ord"), "e.method", "e.path",
                             "e.handler", "e.returns", "e.file", "e.line"),
        params=eps.select("service", F.col("ep_ord").cast("bigint").alias("ep_ord"),
                          F.posexplode("e.params").alias("param_ord", "p"))
        .select("service", "ep_ord", "param_ord", "p.name", "p.location", "p.type"),
    )


def read_catalog_json(spark: SparkSession, path: str, one_per_file: bool = False) -> Catalog:
    """Documents as ``write_catalog_json`` writes them, one on each line. ``one_per_file``: each file is one document over any
    number of lines."""
    return catalog_from_json(spark.read.schema(model.SERVICE_JSON_DDL).json(path, multiLine=one_per_file))


def catalog_documents(catalog: Catalog) -> DataFrame:
    """The five tables folded back to one nested row per service. A list is as long as its owner declares it.

    A document is as large as its service, so it is a row only for who asks for all of it. Pieces of lists are dealt out by ranges of
    services, sorted there and put together one service after another, as columns of a table, from which a later reader gets the lists
    that it asks for. No document is shuffled, sorted or joined."""
    def folded(rows: DataFrame, keys: list, order: str, item: list, name: str) -> DataFrame:
        pair = F.struct(F.col(order).alias("_o"), F.struct(*item).alias("v"))
        return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["v"]).alias(name))

    def pieces(rows: DataFrame, order: str, item: list, name: str) -> DataFrame:
        piece = F.shiftright(F.col(order).cast("bigint"), PIECE_BITS).alias("piece")
        return folded(rows.filter(F.col("service").isNotNull()), ["service", piece], order, item, name)  # no service is found by null

    empty = F.array()
    fields = folded(catalog.fields, ["service", "entity"], "field_ord",
                    ["name", "json_name", "type", "source_type", "optional"], "fields")
    ents = catalog.entities.join(unbounded(fields), ["service", "entity"], "left")
    ents = pieces(ents, "entity_ord",
                  [F.col("entity").alias("name"), F.coalesce("fields", empty).alias("fields"), "file", "line", "kind",
                   "values"], "entities")
    params = folded(catalog.params, ["service", "ep_ord"], "param_ord", ["name", "location", "type"], "params")
    eps = catalog.endpoints.join(unbounded(params), ["service", "ep_ord"], "left")
    eps = pieces(eps, "ep_ord",
                 ["method", "path", "handler", "returns", F.coalesce("params", empty).alias("params"), "file", "line"],
                 "endpoints")
    heads = catalog.services.select("service", F.struct(F.col("service").alias("name"), "language", "framework", "root", "port").alias("head"))
    rows = written(reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True),
                          [part.withColumn("list", F.lit(k)) for k, part in enumerate((heads, ents, eps))]), "pieces")
    spark = rows.sparkSession
    ranges = max(spark.sparkContext.defaultParallelism, rows.count() // ROWS_PER_RANGE + 1)
    dealt = rows.repartitionByRange(ranges, "service").sortWithinPartitions("service", "list", "piece")
    schema = T.StructType([*rows.schema["head"].dataType, rows.schema["entities"], rows.schema["endpoints"]])
    folder = new_folder(spark, "documents")
    # Spark has no writer of ready files but that of text; its ends of lines are the four bytes that a Parquet file ends with
    (dealt.select("service", "head", "entities", "endpoints").mapInArrow(_document_file(schema), "file BINARY").select(F.col("file").cast("string"))
     .write.option("compression", "none").option("lineSep", "PAR1").text(folder))
    return spark.read.schema(schema).parquet(folder)


def _document_file(schema: T.StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function from heads and pieces, sorted by service, to a Parquet file without its last four bytes: a row for each head, with
    the lists of its service. It holds one service, or those of one batch, as Arrow columns, and the file."""
    form = pa.schema([pa.field(f.name, f.type) for f in to_arrow_schema(schema)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[pa.Array]] = [[], [], []]  # heads, entities and endpoints of services not yet in the file
        sizes: list[np.ndarray] = []  # of each of them, by service
        last, file, writer = None, pa.BufferOutputStream(), None

        def starts(rows: pa.RecordBatch) -> np.ndarray:
            return np.concatenate([[0], pc.run_end_encode(rows.column("service")).run_ends.to_numpy()[:-1]])

        def hold(rows: pa.RecordBatch, goes_on: bool) -> None:
            heads, *lists = (rows.column(k) for k in (1, 2, 3))
            counts = [pc.cast(heads.is_valid(), "int64"), *[pc.cast(pc.fill_null(pc.list_value_length(x), 0), "int64") for x in lists]]
            by_service = np.stack([np.add.reduceat(n.to_numpy(zero_copy_only=False), starts(rows)) for n in counts], axis=1)
            if goes_on:
                sizes[-1] = sizes[-1] + by_service[0]
            sizes.extend(by_service[goes_on:])
            for part, found in zip(held, (heads.drop_null(), *[x.flatten() for x in lists])):
                if len(found):
                    part.append(found)
                else:
                    joined(part)

        def joined(part: list[pa.Array]) -> None:
            if len(part) > 1:
                part[:] = [pa.concat_arrays(part)]
                pa.default_memory_pool().release_unused()

        def documents() -> pa.RecordBatch | None:
            n, columns = np.array(sizes), []
            sizes.clear()
            for k in (1, 2):
                joined(held[k])
                kind = form.types[k - 3]
                items = held[k].pop() if held[k] else pa.array([], kind.value_type)
                columns.append(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n[:, k])]).astype("int32"), items, type=kind))
            if (n[:, 0] != 1).any():  # services with several heads, and pieces of services without one
                of = pa.array(np.repeat(np.arange(len(n)), n[:, 0]))
                columns = [x.take(of) for x in columns]
            joined(held[0])
            return pa.RecordBatch.from_arrays([*held[0].pop().flatten(), *columns], schema=form) if held[0] else None

        def put() -> None:
            nonlocal writer
            found = documents()
            if found is not None:
                # a row may go on over many pages of the first version; those of the second end with a row
                writer = writer or pq.ParquetWriter(file, form, data_page_version="1.0", write_statistics=False, store_schema=False)
                writer.write_batch(found)
                del found
                pa.default_memory_pool().release_unused()

        for batch in batches:
            if not batch.num_rows:
                continue
            cut, goes_on = int(starts(batch)[-1]), bool(sizes) and batch.column("service")[0].as_py() == last
            if cut:
                hold(batch.slice(0, cut), goes_on)
            if sizes and (cut or not goes_on):
                put()
                goes_on = False
            last = batch.column("service")[cut].as_py()
            hold(batch.slice(cut), goes_on)
        if sizes:
            put()
        if writer:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([file.getvalue().to_pybytes()[:-4]], pa.binary())], ["file"])

    return read


def write_catalog_json(catalog: Catalog, path: str) -> None:
    catalog_documents(catalog).write.mode("overwrite").json(path, ignoreNullFields=False)


def write_plan_json(plan_documents: DataFrame, path: str) -> None:
    plan_documents.write.mode("overwrite").json(path, ignoreNullFields=False)


def write_report_json(run_reports: DataFrame, path: str) -> None:
    run_reports.write.mode("overwrite").json(path, ignoreNullFields=False)


def catalog_from_tables(spark: SparkSession, service: str, tables: dict[str, DataFrame]) -> Catalog:
    """Spark tables as a service: one entity per table, one more per nested struct. Only schemas are looked at."""
    entities: list[tuple] = []
    fields: list[tuple] = []

    def add(name: str, schema: T.StructType) -> None:
        entities.append((service, len(entities), name, "class", "", 0, []))
        for ord_, f in enumerate(schema.fields):
            inner, depth = f.dataType, 0
            while isinstance(inner, T.ArrayType):
                inner, depth = inner.elementType, depth + 1
            nested = f"{name}_{f.name}" if isinstance(inner, T.StructType) else ""
            fields.append((service, name, ord_, f.name, f.name, canonical_spark(f.dataType, nested),
                           f.dataType.simpleString(), f.nullable))
            if nested:
                add(nested, inner)

    for table, df in tables.items():
        add(table, df.schema)
    return Catalog(
        spark.createDataFrame([(service, "spark", "dataframe", "", 0)], model.SERVICES_DDL),
        spark.createDataFrame(entities, model.ENTITIES_DDL), spark.createDataFrame(fields, model.FIELDS_DDL),
        spark.createDataFrame([], model.ENDPOINTS_DDL), spark.createDataFrame([], model.PARAMS_DDL))


def known_types(entities: DataFrame) -> DataFrame:
    """Names declared anywhere in a service."""
    return entities.select("service", F.col("entity").alias("name")).distinct()


def detect_language(files: DataFrame) -> DataFrame:
    """Language per root from its file paths: build files or sources of Java first, then of Python.

    ``files`` has ``root`` and ``path`` (relative to the root). Roots of neither kind get an error text."""
    checks = {language: F.bool_or(F.col("path").isin(build_files) | F.col("path").endswith(suffix))
              for language, build_files, suffix in LANGUAGE_MARKS}
    found = F.coalesce(*[F.when(F.col(f"_{language}"), F.lit(language)) for language in checks])
    supported = ", ".join(checks)
    return (files.groupBy("root").agg(*[check.alias(f"_{language}") for language, check in checks.items()])
            .select("root", found.alias("language"),
                    F.when(found.isNull(), F.format_string(f"no supported language found in %s (supported: {supported})",
                                                           "root")).alias("error")))


def extract_port(files: DataFrame) -> DataFrame:
    """Port per service from its configuration: the properties file, then yml, then yaml; for Python sources the
    default of ``getenv("PORT", ..)``. The first file in path order wins.

    ``files`` has ``service``, ``language``, ``path``, ``text``."""
    name = F.substring_index("path", "/", -1)
    kind = (F.when((F.col("language") == "java") & (name == "application.properties"), 0)
            .when((F.col("language") == "java") & (name == "application.yml"), 1)
            .when((F.col("language") == "java") & (name == "application.yaml"), 2)
            .when((F.col("language") == "python") & F.col("path").endswith(".py"), 3))
    port = (F.when(kind == 0, F.regexp_extract("text", r"(?m)^server\.port\s*=\s*(\d+)", 1))
            .when(kind.isin(1, 2), F.regexp_extract("text", r"server:\s*\n\s+port:\s*(\d+)", 1))
            .when(kind == 3, F.regexp_extract("text", r"""getenv\(\s*['"]PORT['"]\s*,\s*['"]?(\d+)['"]?\s*\)""", 1)))
    hit = F.when(port != "", port.try_cast("int"))
    default = F.coalesce(*[F.when(F.col("language") == k, F.lit(v)) for k, v in DEFAULT_PORTS.items()])
    return (files.select("service", "language", "path", kind.alias("kind"), hit.alias("hit"))
            .groupBy("service", "language")
            .agg(F.min(F.when(F.col("hit").isNotNull(), F.struct("kind", "path", "hit"))).alias("_m"))
            .select("service", F.coalesce(F.col("_m.hit"), default).alias("port")))


def service_summary(catalog: Catalog) -> DataFrame:
    """Entities with kind and number of fields; services keep a row for each declared entity, empty or not."""
    sizes = catalog.fields.groupBy("service", "entity").agg(F.count(F.lit(1)).alias("n"))
    return (catalog.entities.join(sizes, ["service", "entity"], "left")
            .select("service", "entity", "kind", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_fields")))


def service_counts(services: DataFrame, entities: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Number of entities and endpoints per service, zero where there are none."""
    e = entities.groupBy("service").agg(F.count(F.lit(1)).alias("e"))
    p = endpoints.groupBy("service").agg(F.count(F.lit(1)).alias("p"))
    return (services.select("service").join(e, "service", "left").join(p, "service", "left")
            .select("service", F.coalesce("e", F.lit(0)).alias("n_entities"), F.coalesce("p", F.lit(0)).alias("n_endpoints")))
