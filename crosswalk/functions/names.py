"""Column expressions over identifiers: splitting, similarity, blocking keys and naming styles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mean the same in a field name, one group per line.
SYNONYM_GROUPS = [
    ["id", "ref", "reference", "key", "number", "no", "identifier"],
    ["customer", "client", "user", "account", "buyer", "purchaser", "member"],
    ["amount", "total", "sum", "price", "cost", "due", "value", "charge"],
    ["created", "placed", "issued", "submitted", "ordered", "opened", "made"],
    ["updated", "modified", "changed", "edited"],
    ["status", "state", "stage"],
    ["city", "town", "locality"],
    ["qty", "quantity", "count"],
    ["email", "mail"],
    ["phone", "mobile", "tel", "telephone"],
    ["name", "title", "label"],
]
# Words that carry no meaning of their own in a field name.
NOISE_WORDS = ["at", "on", "code", "the", "info", "data"]

EQUAL, SYNONYM, PREFIX = 1.0, 0.8, 0.7
PREFIX_MIN_LENGTH = 4  # both words have to be longer than three characters


def tokens_sql(name: str) -> str:
    spaced = f"regexp_replace({name}, '([a-z0-9])([A-Z])', '$1 $2')"
    words = f"split({spaced}, r'(?U)[\\s_\\-]+')"
    return f"transform(filter({words}, w -> w <> ''), w -> lower(w))"


def tokens(name: str) -> Column:
    """Lower-case words of the identifier in a column: split where a capital follows a small letter or digit, then
    at white space, ``_`` and ``-``. A run of capitals stays one word."""
    return F.expr(tokens_sql(name))


# The comparison of two word lists nests lambdas four deep. It is written as SQL text over column names: one call
# builds it, where the same tree out of Column calls takes a second of driver time per use.

def tagged_sql(token_list: str) -> str:
    """Words with the number of their synonym group (null outside all groups), looked up once per name instead of
    once per compared pair. The groups do not overlap, so a word has at most one. The groups are a map of literals: the planner
    would fold ``str_to_map`` on the driver, and its first call there sets up tables of all characters, 3 GB of garbage."""
    entries = ", ".join(f"'{word}', {number}" for number, words in enumerate(SYNONYM_GROUPS) for word in words)
    return f"transform({token_list}, t -> named_struct('t', t, 'g', try_element_at(map({entries}), t)))"


def token_similarity_sql(a: str, b: str) -> str:
    """Likeness of two tagged words."""
    long_pair = f"length({a}.t) >= {PREFIX_MIN_LENGTH} AND length({b}.t) >= {PREFIX_MIN_LENGTH}"
    return (f"CASE WHEN {a}.t = {b}.t THEN {EQUAL}D WHEN {a}.g = {b}.g THEN {SYNONYM}D "
            f"WHEN {long_pair} AND (startswith({a}.t, {b}.t) OR startswith({b}.t, {a}.t)) THEN {PREFIX}D ELSE 0D END")


def significant_sql(tagged_list: str, strip: str | None = None) -> str:
    """Drop noise words and the words in ``strip``; when nothing is left, keep the whole list."""
    noise = ", ".join(f"'{w}'" for w in NOISE_WORDS)
    more = f" AND NOT array_contains({strip}, w.t)" if strip else ""
    left = f"filter({tagged_list}, w -> w.t NOT IN ({noise}){more})"
    return f"transform(array({left}), k -> IF(size(k) > 0, k, {tagged_list}))[0]"


def list_similarity_sql(a: str, b: str) -> str:
    """Dice-style likeness of two lists of tagged words. An empty list is like nothing (0.0)."""
    def best_matches(xs: str, ys: str) -> str:
        best = f"array_max(transform({ys}, y -> {token_similarity_sql('x', 'y')}))"
        return f"aggregate({xs}, 0D, (acc, x) -> acc + {best})"

    total = f"({best_matches('v.a', 'v.b')} + {best_matches('v.b', 'v.a')}) / (size(v.a) + size(v.b))"
    return (f"transform(array(named_struct('a', {a}, 'b', {b})), "
            f"v -> IF(size(v.a) = 0 OR size(v.b) = 0, 0D, {total}))[0]")


def name_similarity(a: str, b: str, strip: str | None = None) -> Column:
    """Likeness in 0..1 of the names in two columns; ``strip`` is a column of words to leave out. Where many pairs
    are compared, compute ``tagged(name)`` per name first and use ``list_similarity`` on the pairs."""
    words = f"named_struct('p', {tagged_sql(tokens_sql(a))}, 'q', {tagged_sql(tokens_sql(b))})"
    body = list_similarity_sql(significant_sql("u.p", strip), significant_sql("u.q", strip))
    return F.expr(f"transform(array({words}), u -> {body})[0]")


def tagged(name: str) -> Column:
    """Tagged words of the name in a column."""
    return F.expr(tagged_sql(tokens_sql(name)))


def list_similarity(a: str, b: str) -> Column:
    """Likeness of two columns of tagged words, noise words left out."""
    return F.expr(list_similarity_sql(significant_sql(a), significant_sql(b)))


def blocking_keys(tagged_list: str) -> Column:
    """Keys with the property that two words of likeness above zero share one: the synonym group (or the word
    itself outside all groups), and the first four letters of a longer word."""
    own = f"transform({tagged_list}, w -> IF(w.g IS NOT NULL, 'g:' || w.g, 't:' || w.t))"
    long_words = f"filter({tagged_list}, w -> length(w.t) >= {PREFIX_MIN_LENGTH})"
    heads = f"transform({long_words}, w -> 'p:' || left(w.t, {PREFIX_MIN_LENGTH}))"
    return F.expr(f"array_distinct(concat({own}, {heads}))")


def snake(name: Column) -> Column:
    split = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2")
    return F.lower(F.trim(F.regexp_replace(split, "[^a-zA-Z0-9]+", "_"), F.lit("_")))


def pascal(name: Column) -> Column:
    parts = F.filter(F.split(name, "[^a-zA-Z0-9]+"), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p)))), "")


def package_key(name: Column) -> Column:
    """Package names that differ only in case or in runs of ``-``, ``_``, ``.`` are the same package."""
    return F.lower(F.regexp_replace(name, "[-_.]+", "-"))


def requirement_name(requirement: Column) -> Column:
    """Package named at the start of a requirement line; null for lines that only apply to an extra."""
    name = F.regexp_extract(requirement, r"^[A-Za-z0-9_.\-]+", 0)
    return F.when(~F.contains(requirement, F.lit("extra ==")) & (name != ""), name)


def parse_pair_spec(spec: Column) -> Column:
    """``Order:OrderRecord`` as a struct; everything after the first colon belongs to the consumer."""
    parts = F.split(spec, ":", 2)
    return F.struct(F.try_element_at(parts, F.lit(1)).alias("provider_entity"),
                    F.try_element_at(parts, F.lit(2)).alias("consumer_entity"))


def any_of(bases: Column, known: list[str] | Column) -> Column:
    """Do two sets of names overlap?"""
    other = F.array(*[F.lit(k) for k in known]) if isinstance(known, list) else known
    return F.arrays_overlap(bases, other)
