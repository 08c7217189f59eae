"""Column expressions over type texts: canonical forms, compatibility, and the Spark side of both."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Scalar source types and their canonical names.
JAVA_SCALARS = {
    "String": "string", "char": "string", "Character": "string",
    "int": "integer", "Integer": "integer", "long": "integer", "Long": "integer",
    "short": "integer", "Short": "integer", "byte": "integer", "BigInteger": "integer",
    "double": "decimal", "Double": "decimal", "float": "decimal", "Float": "decimal", "BigDecimal": "decimal",
    "boolean": "boolean", "Boolean": "boolean",
    "LocalDateTime": "datetime", "OffsetDateTime": "datetime", "ZonedDateTime": "datetime", "Instant": "datetime",
    "LocalDate": "date", "UUID": "uuid", "Object": "object", "Map": "object",
}
JAVA_COLLECTIONS = ["List", "Set", "Collection", "Iterable", "ArrayList"]
PYTHON_SCALARS = {
    "str": "string", "int": "integer", "float": "decimal", "Decimal": "decimal", "bool": "boolean",
    "datetime": "datetime", "date": "date", "UUID": "uuid", "dict": "object", "Any": "object",
}
PYTHON_COLLECTIONS = ["list", "List", "set", "Set", "tuple", "Sequence"]

# Canonical types that may carry each other's values, with a small loss.
COMPATIBLE_TYPES = [("integer", "decimal"), ("date", "datetime"), ("string", "uuid"), ("string", "datetime"),
                    ("string", "date")]
SAME_TYPE, NEAR_TYPE, OTHER_TYPE = 1.0, 0.9, 0.2

# Canonical scalar -> Spark type used when values are cast for a consumer.
SPARK_TARGETS = {
    "string": "STRING", "integer": "BIGINT", "decimal": "DECIMAL(38,18)", "boolean": "BOOLEAN",
    "datetime": "TIMESTAMP_NTZ", "date": "DATE", "uuid": "STRING", "object": "STRING",
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def _words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _last_segment(dotted: Column) -> Column:
    return F.substring_index(dotted, ".", -1)


def base_type(ctype: Column) -> Column:
    """All lists are one base, all references are one base, a scalar is its own base."""
    return (F.when(ctype.startswith("ref:"), F.lit("enum-or-ref"))
            .when(ctype.startswith("list<"), F.lit("list")).otherwise(ctype))


def provider_base(ptype: Column, ref_kind: Column) -> Column:
    """Base of a provider type. ``ref_kind`` is the kind of the entity a ``ref:`` points to, null if undeclared."""
    return (F.when(ptype.startswith("ref:"), F.when(ref_kind == "enum", F.lit("string")).otherwise(F.lit("object")))
            .otherwise(base_type(ptype)))


def type_compat(provider: Column, consumer: Column) -> Column:
    """How well values of one base fit the other. Arguments come from ``provider_base`` and ``base_type``."""
    near = F.lit(False)
    for a, b in COMPATIBLE_TYPES:
        near = near | ((provider == a) & (consumer == b)) | ((provider == b) & (consumer == a))
    return F.when(provider == consumer, F.lit(SAME_TYPE)).when(near, F.lit(NEAR_TYPE)).otherwise(F.lit(OTHER_TYPE))


def round_half_even(value: Column, digits: int = 3) -> Column:
    """Round a double as the exact binary value it is, ties to even, over the whole range.

    Decimal rounding of the printed form moves ties such as 0.5375 (stored slightly below it) the wrong way. The value times
    10**digits is held as a rounded product and its exact error (Dekker), so the distance to the nearest whole number is
    compared with one half exactly. From 2**53 / 10**digits on the nearest double to the rounded value is the value itself."""
    scale, halves = float(10 ** digits), 134217729.0
    big = scale * halves
    high = big - (big - scale)
    low = scale - high

    def named(x: Column, use) -> Column:
        return F.get(F.transform(F.array(x), use), F.lit(0))

    def split(v: Column) -> Column:
        head = v * F.lit(halves) - (v * F.lit(halves) - v)
        return F.struct(v.alias("v"), (v * F.lit(scale)).alias("product"), head.alias("head"), (v - head).alias("tail"))

    def placed(s: Column) -> Column:
        error = (s.head * F.lit(high) - s.product + s.head * F.lit(low) + s.tail * F.lit(high)) + s.tail * F.lit(low)
        return F.struct(s.v.alias("v"), F.rint(s.product).alias("near"), (s.product - F.rint(s.product)).alias("off"), error.alias("error"))

    def decided(s: Column) -> Column:
        odd = F.pmod(s.near, F.lit(2.0)) == 1.0
        above, below = F.lit(0.5) - s.off, F.lit(-0.5) - s.off
        step = (F.when((s.error > above) | ((s.error == above) & odd), 1.0)
                .when((s.error < below) | ((s.error == below) & odd), -1.0).otherwise(0.0))
        return F.when(F.abs(s.v) >= F.lit(2.0 ** 53 / scale), s.v).otherwise((s.near + step) / F.lit(scale))

    return named(value.cast("double"), lambda v: named(split(v), lambda s: named(placed(s), decided)))


def render_type(depth: Column, simple: Column) -> Column:
    """``list<`` nesting around a simple canonical type."""
    depth = depth.cast("int")
    return F.concat(F.repeat(F.lit("list<"), depth), simple, F.repeat(F.lit(">"), depth))


def java_type_parts(java_type: Column) -> Column:
    """Peel a Java type text to ``struct(depth, name, scalar)``: list nesting, simple name, canonical scalar.

    ``scalar`` is null when the name has to be resolved against the declared types of the service."""
    generic = r"^([\w.]+)\s*<(.+)>$"
    start = F.struct(F.trim(java_type).alias("rest"), F.lit(0).alias("depth"))

    def peel(s: Column, _: Column) -> Column:
        rest = s["rest"]
        outer = _last_segment(F.regexp_extract(rest, generic, 1))
        inner = F.trim(F.regexp_extract(rest, generic, 2))
        is_list = F.array_contains(_words(JAVA_COLLECTIONS), outer)
        is_array = (outer == "") & rest.endswith("[]")
        next_rest = (F.when(is_list | (outer == "Optional"), inner)
                     .when(outer != "", F.lit("Object"))
                     .when(is_array, F.trim(rest.substr(F.lit(1), F.length(rest) - 2)))
                     .otherwise(rest))
        return F.struct(next_rest.alias("rest"),
                        (s["depth"] + F.when(is_list | is_array, 1).otherwise(0)).alias("depth"))

    def finish(s: Column) -> Column:
        simple = _last_segment(s["rest"])
        return F.struct(s["depth"].alias("depth"), simple.alias("name"), _lookup(JAVA_SCALARS, simple).alias("scalar"))

    # every peel removes one "<" or "[", so as many steps as there are pieces are enough for any nesting
    return F.aggregate(F.split(java_type, r"[<\[]"), start, peel, finish)


def _top_level(text: Column, mark: str) -> Column:
    """First and last position (1-based, 0 = none) of ``mark`` outside brackets and quotes."""
    start = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("depth"), F.lit("").alias("quote"),
                     F.lit(0).alias("first"), F.lit(0).alias("last"))

    def step(s: Column, ch: Column) -> Column:
        pos = s["pos"] + 1
        quoted = s["quote"] != ""
        is_quote = ch.isin("'", '"')
        quote = (F.when(quoted & (ch == s["quote"]), F.lit("")).when(~quoted & is_quote, ch).otherwise(s["quote"]))
        change = F.when(quoted, 0).when(ch.isin("[", "(", "{"), 1).when(ch.isin("]", ")", "}"), -1).otherwise(0)
        hit = ~quoted & (s["depth"] == 0) & (ch == mark)
        return F.struct(pos.alias("pos"), (s["depth"] + change).alias("depth"), quote.alias("quote"),
                        F.when(hit & (s["first"] == 0), pos).otherwise(s["first"]).alias("first"),
                        F.when(hit, pos).otherwise(s["last"]).alias("last"))

    return F.aggregate(F.split(text, ""), start, step,
                       lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))


def python_type_parts(annotation: Column) -> Column:
    """Peel a Python annotation text to ``struct(depth, name, scalar, optional)``.

    ``X | None``, ``None | X`` and ``Optional[X]`` are optional at the outermost level only; a union is read as its
    first member; ``Annotated`` is its first argument; quoted forward references are read through."""
    subscript = r"(?s)^([\w.]+)\s*\[(.*)\]$"
    start = F.struct(F.trim(F.coalesce(annotation, F.lit(""))).alias("rest"), F.lit(0).alias("depth"),
                     F.lit(None).cast("boolean").alias("optional"))

    def peel(s: Column, _: Column) -> Column:
        rest = s["rest"]
        quoted = F.regexp_extract(rest, r"""^(['"])([^'"]*)\1$""", 2)
        bar = _top_level(rest, "|")
        outer = _last_segment(F.regexp_extract(rest, subscript, 1))
        inner = F.trim(F.regexp_extract(rest, subscript, 2))

        def decide(v: Column) -> Column:
            first, last = v["bar"]["first"], v["bar"]["last"]
            head = F.trim(rest.substr(F.lit(1), first - 1))
            tail = F.trim(rest.substr(last + 1, F.length(rest)))
            after_head = F.trim(rest.substr(first + 1, F.length(rest)))
            union = (first > 0) & (quoted == "")
            lone_head = (head == "None") & (first == last)
            is_list = ~union & F.array_contains(_words(PYTHON_COLLECTIONS), outer)
            comma = v["comma"]["first"]
            next_rest = (
                F.when(quoted != "", F.trim(quoted))
                .when(union & (head == "None"), after_head)
                .when(union, head)
                .when((outer == "Optional") | is_list, F.when(comma > 0, F.when(is_list, F.lit("object"))
                      .otherwise(inner)).otherwise(inner))
                .when((outer == "Annotated") & (comma > 0), F.trim(inner.substr(F.lit(1), comma - 1)))
                .when(outer != "", F.lit("Any"))
                .otherwise(rest)
            )
            # decided by the first step that is not a forward reference or Annotated
            through = (quoted != "") | (~union & (outer == "Annotated"))
            here = (F.when(union, (tail == "None") != lone_head).otherwise(outer == "Optional"))
            optional = F.when(s["optional"].isNotNull(), s["optional"]).when(through, F.lit(None)).otherwise(here)
            return F.struct(next_rest.alias("rest"), (s["depth"] + F.when(is_list, 1).otherwise(0)).alias("depth"),
                            optional.cast("boolean").alias("optional"))

        # a one-element transform names the scan results once instead of repeating them in every branch
        return F.transform(F.array(F.struct(bar.alias("bar"), _top_level(inner, ",").alias("comma"))), decide)[0]

    def finish(s: Column) -> Column:
        simple = F.when(s["rest"].rlike(r"^[\w.]+$"), _last_segment(s["rest"])).otherwise(F.lit(""))
        simple = F.when(simple == "None", F.lit("")).otherwise(simple)
        return F.struct(s["depth"].alias("depth"), simple.alias("name"),
                        F.when(simple == "", F.lit("object")).otherwise(_lookup(PYTHON_SCALARS, simple)).alias("scalar"),
                        F.coalesce(s["optional"], F.lit(False)).alias("optional"))

    # every peel removes one of these marks; the extra piece of the split lets the last step settle the flag
    return F.aggregate(F.split(F.coalesce(annotation, F.lit("")), r"""[\[|'"]"""), start, peel, finish)


def canonical_text(parts: Column, is_known: Column) -> Column:
    """Canonical type from peeled parts: a scalar, ``ref:`` of a declared name, or ``object``."""
    simple = F.coalesce(parts["scalar"], F.when(is_known, F.concat(F.lit("ref:"), parts["name"])), F.lit("object"))
    return render_type(parts["depth"], simple)


def normalize_return(ctype: Column) -> Column:
    """``ref:X`` -> ``X`` and ``list<ref:X>`` -> ``list<X>`` for the return type of an endpoint."""
    bare = F.regexp_replace(ctype, "^ref:", "")
    return F.regexp_replace(bare, "list<ref:", "list<")


def returned_entity(returns: Column) -> Column:
    """``struct(is_list, entity)`` of a normalised return type."""
    is_list = F.coalesce(returns.startswith("list<"), F.lit(False))
    name = F.when(is_list, returns.substr(F.lit(6), F.length(returns) - 6)).otherwise(returns)
    return F.struct(is_list.alias("is_list"), F.coalesce(name, F.lit("")).alias("entity"))


def target_type(ctype: Column, ref_kind: Column) -> Column:
    """Spark type text a consumer column of this canonical type gets. ``ref_kind`` as in ``provider_base``."""
    depth = F.size(F.split(ctype, "list<")) - 1
    inner = F.regexp_replace(F.regexp_replace(ctype, "^(list<)+", ""), ">+$", "")
    simple = (F.when(inner.startswith("ref:"), F.when(ref_kind == "enum", F.lit("STRING"))
                     .when(ref_kind.isNotNull(), F.concat(F.lit("STRUCT "), inner.substr(F.lit(5), F.length(inner))))
                     .otherwise(F.lit("STRING")))
              .otherwise(F.coalesce(_lookup(SPARK_TARGETS, inner), F.lit("STRING"))))
    return F.concat(F.repeat(F.lit("ARRAY<"), depth), simple, F.repeat(F.lit(">"), depth))


def spark_cast_type(ctype: str, source_type: str = "") -> str | None:
    """Spark type a scalar canonical type is cast to, null where values pass through as they are."""
    if ctype == "integer" and source_type == "BigInteger":
        return "DECIMAL(38,0)"
    if ctype == "datetime" and source_type in ("OffsetDateTime", "ZonedDateTime", "Instant"):
        return "TIMESTAMP"
    return SPARK_TARGETS.get(ctype) if ctype not in ("object",) else None


def empty_type(ctype: str, source_type: str = "") -> str:
    """Spark type of a consumer field that nothing is mapped to."""
    depth = ctype.count("list<")
    inner = ctype[5 * depth:len(ctype) - depth]
    simple = "DOUBLE" if inner == "decimal" else spark_cast_type(inner, source_type) or "STRING"
    return "ARRAY<" * depth + simple + ">" * depth


def canonical_spark(data_type: T.DataType, entity_name: str = "") -> str:
    """Canonical type of a Spark type; a struct is a reference to the entity ``entity_name``."""
    if isinstance(data_type, T.ArrayType):
        return f"list<{canonical_spark(data_type.elementType, entity_name)}>"
    if isinstance(data_type, T.StructType):
        return f"ref:{entity_name}" if entity_name else "object"
    families = [
        ((T.StringType, T.CharType, T.VarcharType), "string"),
        ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), "integer"),
        ((T.FloatType, T.DoubleType, T.DecimalType), "decimal"),
        ((T.BooleanType,), "boolean"),
        ((T.TimestampType, T.TimestampNTZType), "datetime"),
        ((T.DateType,), "date"),
    ]
    return next((name for kinds, name in families if isinstance(data_type, kinds)), "object")
