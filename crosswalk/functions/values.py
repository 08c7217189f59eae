"""Column expressions over values: comparison, samples, JSON in chatter, labels and escaping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Status words and the class they are shown in.
STATUS_CLASSES = {
    "pass": "pass", "clean": "pass", "ok": "pass", "fail": "fail", "findings": "fail", "error": "fail",
    "skipped": "skip", "heuristic": "skip", "llm": "warn",
}
# Parts of the sample values of a field.
SAMPLE_UUID = "3f2c9a1e-7b4d-4e8a-9c21-5d6f0a1b2c3d"
SAMPLE_MONTH = "2026-09"

_NUMBER = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?)\s*$"
_DATETIME = r"^\d{4}-\d{2}-\d{2}T"
_OFFSET = r"(Z|[+-]\d{2}(:?\d{2}){0,2})$"
_TIME_PART = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}"


#: Numbers that a decimal(38,18) holds exactly.
_PLAIN_NUMBER = r"^[+-]?[0-9]{1,20}(\.[0-9]{0,18})?$"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def number_form(text: Column) -> Column:
    """A number's text in normal form: sign, digits without outer zeros, exponent of the last digit. Two numbers are equal
    exactly if their forms are, whatever their length. Null for text that is no number. Exponents of more than 38 digits stay as they are
    written, without outer zeros, beside what the digits move them by: with them, numbers are equal if written alike."""
    def form(p: Column) -> Column:
        far = F.concat(F.regexp_replace(p.exponent, r"^(-?)0+(?=\d)", "$1"), F.lit(":"), p.shift.cast("string"))
        scale = F.when(p.exponent == "", p.shift.cast("decimal(38,0)")).otherwise(p.exponent.try_cast("decimal(38,0)") + p.shift)
        return (F.when(p.infinite, F.concat(p.sign, F.lit("inf"))).when(p.digits == "", F.lit("0"))
                .otherwise(F.concat(p.sign, p.digits, F.lit("e"), F.coalesce(scale.cast("decimal(38,0)").cast("string"), far))))

    def parts(p: Column) -> Column:
        digits = F.regexp_replace(p.front, "0+$", "")
        return F.struct(p.sign.alias("sign"), p.infinite.alias("infinite"), p.exponent.alias("exponent"), digits.alias("digits"),
                        (F.length(p.front) - F.length(digits) - F.length(p.fraction)).alias("shift"))

    def read(bare: Column) -> Column:
        fraction = F.regexp_extract(bare, r"\.(\d*)", 1)
        return F.struct(F.when(bare.startswith("-"), F.lit("-")).otherwise(F.lit("+")).alias("sign"), bare.contains("inf").alias("infinite"),
                        F.regexp_extract(bare, r"e\+?(-?\d+)$", 1).alias("exponent"), fraction.alias("fraction"),
                        F.regexp_replace(F.concat(F.regexp_extract(bare, r"^[+-]?(\d*)", 1), fraction), "^0+", "").alias("front"))
    bare = F.lower(F.regexp_replace(text, r"\s+", ""))
    return F.when(text.rlike(_NUMBER), _let(bare, lambda b: _let(read(b), lambda r: _let(parts(r), form))))


def _same_number(expected: Column, actual: Column) -> Column:
    """Equal texts and short decimals need no normal form."""
    def exact(c: Column) -> Column:
        return c.try_cast("decimal(38,18)")
    return (F.when(expected == actual, expected.rlike(_NUMBER))
            .when(expected.rlike(_PLAIN_NUMBER) & actual.rlike(_PLAIN_NUMBER), exact(expected) == exact(actual))
            .otherwise(number_form(expected) == number_form(actual)))


def _same_datetime(expected: Column, actual: Column) -> Column:
    """Both with an offset or both without; ``Z`` is an offset. Text that is no date is unequal."""
    def with_offset(c: Column) -> Column:
        return c.rlike(_TIME_PART) & c.rlike(_OFFSET)

    naive = expected.try_cast("timestamp_ntz") == actual.try_cast("timestamp_ntz")
    aware = expected.try_cast("timestamp") == actual.try_cast("timestamp")
    return (F.when(with_offset(expected) != with_offset(actual), F.lit(False))
            .when(with_offset(expected), aware).otherwise(naive))


def same_value(expected: Column, actual: Column, ctype: str | Column) -> Column:
    """Does the delivered value equal the expected one? Both are texts, ``ctype`` is the expected canonical type.

    Null equals only null; numbers compare as numbers (NaN never equals); an ISO date-time text compares as a
    point in time; everything else compares as text."""
    kind = F.lit(ctype) if isinstance(ctype, str) else ctype
    numeric = kind.isin("integer", "decimal")
    stamped = kind.isin("string", "datetime", "date", "uuid") & expected.rlike(_DATETIME)
    value = (F.when(numeric, _same_number(expected, actual))
             .when(stamped, _same_datetime(expected, actual)).otherwise(expected == actual))
    return (F.when(expected.isNull() | actual.isNull(), expected.isNull() & actual.isNull())
            .otherwise(F.coalesce(value, F.lit(False))))


def name_seed(name: Column) -> Column:
    """Sum of the code points of a name."""
    return F.aggregate(F.split(name, ""), F.lit(0).cast("bigint"), lambda acc, ch: acc + F.ascii(ch))


def sample_scalar(ctype: Column, name: Column, seed: Column) -> Column:
    """Sample of a scalar canonical type as JSON text; an unknown type is an empty object."""
    day = F.lpad((1 + seed % 28).cast("string"), 2, "0")
    hour = F.lpad((seed % 24).cast("string"), 2, "0")
    return (
        F.when(ctype == "string", json_text(F.concat(name, F.lit("-"), (seed % 97).cast("string"))))
        .when(ctype == "integer", (1000 + seed % 9000).cast("string"))
        .when(ctype == "decimal", ((seed % 10000 + 49).cast("double") / F.lit(100.0)).cast("string"))
        .when(ctype == "boolean", (seed % 2 == 0).cast("string"))
        .when(ctype == "datetime", json_text(F.concat(F.lit(f"{SAMPLE_MONTH}-"), day, F.lit("T"), hour, F.lit(":15:30"))))
        .when(ctype == "date", json_text(F.concat(F.lit(f"{SAMPLE_MONTH}-"), day)))
        .when(ctype == "uuid", F.lit(f'"{SAMPLE_UUID}"'))
        .otherwise(F.lit("{}"))
    )


def json_text(value: Column) -> Column:
    """A string as a JSON string literal."""
    quoted = F.to_json(F.array(value))
    return quoted.substr(F.lit(2), F.length(quoted) - 2)


def first_json_object(text: Column) -> Column:
    """The JSON object inside chatter or code fences: from the first ``{`` to the last ``}``. Null when that
    span is not exactly one object."""
    span = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    wrapped = F.concat(F.lit("["), span, F.lit("]"))
    one = F.json_array_length(wrapped) == 1
    # the length check takes single-quoted text as JSON, the strict parser does not
    strict = ~F.contains(span, F.lit("'")) | F.try_parse_json(wrapped).isNotNull()
    return F.when((span != "") & one & strict, span)


def strip_code_fence(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"^```(?:python)?\s*|\s*```\s*$", "")


def last_line(text: Column, width: int = 200) -> Column:
    """Last line of a tool's error text, cut to ``width``."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    lines = F.split(body, "\r\n|[\n\r\u000b\u000c\u0085  ]")
    return F.when(body == "", F.lit("no output")).otherwise(F.left(F.element_at(lines, -1), F.lit(width)))


def html_escape(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def status_class(status: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in STATUS_CLASSES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, status), F.lit("skip"))


def base_name(path: Column) -> Column:
    return F.substring_index(F.regexp_replace(path, "/+$", ""), "/", -1)


def finding_label(rule: Column, path: Column, line: Column) -> Column:
    return F.concat(rule, F.lit(" "), base_name(path), F.lit(":"), line.cast("string"))


def diagnostic_label(file: Column, line: Column, code: Column, message: Column) -> Column:
    return F.concat(file, F.lit(":"), line.cast("string"), F.lit(": "), code, F.lit(" "), message)


def drop_null_params(params: Column) -> Column:
    """Query arguments without a value are not sent."""
    return F.map_filter(params, lambda _, v: v.isNotNull())


def body_json(body: Column) -> Column:
    """A request body as JSON; fields without a value are left out at every level."""
    return F.to_json(body, {"ignoreNullFields": "true"})
