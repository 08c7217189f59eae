"""Secret scans: known shapes, and strings that a battery of randomness tests tells from ordinary text.

A candidate is a run of characters of some encoding. Its encoding is inferred from the classes of characters it has, and three tests look at it: chi-squared
uniformity over the encoding's alphabet, the number of runs of one character class, and serial correlation. Evidence is the
chance that ordinary text of that length shows as even a spread and as many runs. Short strings give weak evidence however
random they are, and the false-discovery control works within each encoding and length class over all candidates of
the corpus, so that the many ordinary long words do not let a share of them through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosswalk.llm.quality import let

#: Shapes found whatever the tests say: name, pattern, and the part whose length counts with the least length.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
SHAPES = (("assign", ASSIGN, 1, 12), ("access", r"AKIA[A-Z0-9]+", 0, 18), ("hex", r"[0-9a-f]{16,}", 0, 16))
RANDOM = "random"
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}={0,2}"
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Encoding:
    """``uneven``: how far ordinary text in this alphabet is from uniform, as k * sum(p^2) - 1; ``changes``: how often two
    neighbours of ordinary text differ in class."""
    name: str
    pattern: str
    alphabet: str
    uneven: float
    changes: float


#: In the order in which they are tried. Digits alone are the known shape of hex.
ENCODINGS = (
    Encoding("lower", r"^[a-z]+=*$", _LOWER, 0.7, 0.0),
    Encoding("upper", r"^[A-Z]+=*$", _UPPER, 0.7, 0.0),
    Encoding("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", _DIGITS + "abcdef", 0.6, 0.15),
    Encoding("base32", r"^[A-Z2-7]+=*$", _UPPER + "234567", 1.1, 0.15),
    Encoding("base32lower", r"^[a-z2-7]+=*$", _LOWER + "234567", 1.1, 0.15),
    Encoding("base36", r"^[A-Z0-9]+=*$", _UPPER + _DIGITS, 1.2, 0.15),
    Encoding("base36lower", r"^[a-z0-9]+=*$", _LOWER + _DIGITS, 1.2, 0.15),
    Encoding("base62", r"^[A-Za-z0-9]+=*$", _UPPER + _LOWER + _DIGITS, 2.2, 0.15),
    Encoding("base64", r"^[A-Za-z0-9+/]+=*$", _UPPER + _LOWER + _DIGITS + "+/", 2.2, 0.15),
    Encoding("base64url", r"^[A-Za-z0-9_-]+=*$", _UPPER + _LOWER + _DIGITS + "-_", 2.2, 0.15),
)
FALSE_DISCOVERIES = 0.01
#: A string this far off from random, in standard deviations, in any one test is no random string. It takes part in the
#: false-discovery control as a candidate without evidence. Of 40,000 random keys drawn for each encoding and length these gates
#: refuse 0.2 to 0.4% at 16 characters, 0.1 to 0.3% at 64 and 0.06 to 0.3% at 512.
NOT_RANDOM = 3.9
_BIN, _LOWEST = 0.05, -20.0


def running_sums(numbers: Column) -> Column:
    """Running sums of a non-empty array of longs, in blocks so that long arrays stay cheap."""
    def within(block: Column) -> Column:
        return F.aggregate(block, F.array().cast("array<bigint>"),
                           lambda a, x: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)) + x)))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / 256).cast("int")),
                         lambda b: F.transform(F.sequence(b * 256, F.least(b * 256 + 255, F.size(numbers) - 1)),
                                               lambda i: F.get(numbers, i)))
    return let(F.transform(blocks, within), lambda sums: let(
        F.aggregate(sums, F.array(F.lit(0).cast("long")), lambda a, s: F.concat(
            a, F.array(F.element_at(a, -1) + F.element_at(s, -1)))),
        lambda before: F.flatten(F.transform(sums, lambda s, i: F.transform(s, lambda v: v + F.get(before, i))))))


_SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string,found:string>>"


def matches(text: Column, pattern: str, kind: str, rank: int) -> Column:
    """Leftmost non-overlapping matches with code-point positions: what stands between matches comes from splitting at the
    same pattern, and the lengths add up to the positions. Texts without a match are not split."""
    def placed(found: Column) -> Column:
        between = F.transform(F.split(text, pattern, -1), lambda p: F.length(p).cast("long"))
        gaps = let(between, lambda b: F.transform(found, lambda m, i: F.get(b, i) + F.coalesce(
            F.length(F.get(found, i - 1)), F.lit(0)).cast("long")))
        return let(running_sums(gaps), lambda at: F.transform(found, lambda m, i: F.struct(
            F.get(at, i).alias("start"), F.lit(rank).alias("rank"), (F.get(at, i) + F.length(m)).alias("end"),
            F.lit(kind).alias("kind"), m.alias("found"))))
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(
        F.size(found) > 0, placed(found)).otherwise(F.array().cast(_SPAN)))


def shaped(text: Column) -> Column:
    """Spans of the known shapes, by start, then in the order of ``SHAPES``."""
    def of(rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
        return F.filter(matches(text, pattern, kind, rank), lambda m: F.length(F.regexp_extract(m.found, pattern, group)) >= least)
    return F.sort_array(F.concat(*[of(rank, *shape) for rank, shape in enumerate(SHAPES)]))


def _phi(z: Column) -> Column:
    """Normal distribution function (Abramowitz and Stegun 26.2.17)."""
    a = F.abs(z)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * a)
    poly = t * (F.lit(0.319381530) + t * (F.lit(-0.356563782) + t * (F.lit(1.781477937) + t * (
        F.lit(-1.821255978) + t * F.lit(1.330274429)))))
    tail = F.exp(-a * a / 2) * F.lit(0.3989422804014327) * poly
    return F.when(z > 0, F.lit(1.0) - tail).otherwise(tail)


#: Characters by class: digits, capitals, small letters, others.
_CLASSES = str.maketrans({**dict.fromkeys(_DIGITS, "d"), **dict.fromkeys(_UPPER, "u"), **dict.fromkeys(_LOWER, "l"), **dict.fromkeys("+/-_", "o")})


def _parameters() -> Column:
    """By the name of an encoding: alphabet, its size, how uneven ordinary text is, how often its class changes, and how often that of
    random text does."""
    def of(e: Encoding) -> Column:
        shares = [e.alphabet.translate(_CLASSES).count(c) / len(e.alphabet) for c in "dulo"]
        return F.struct(F.lit(e.alphabet).alias("alphabet"), F.lit(float(len(e.alphabet))).alias("k"), F.lit(e.uneven).alias("uneven"),
                        F.lit(e.changes).alias("changes"), F.lit(1 - sum(x * x for x in shares)).alias("q"))
    return F.create_map(*[c for e in ENCODINGS for c in (F.lit(e.name), of(e))])


def _serial(values: Column, n: Column) -> Column:
    """Serial correlation of neighbours, the last with the first, in standard deviations; null where all are equal."""
    def total(of: Column) -> Column:
        return F.aggregate(of, F.lit(0.0), lambda a, y: a + y)
    following = F.transform(values, lambda y, i: y * F.coalesce(F.get(values, i + 1), F.get(values, F.lit(0))))
    sums = F.struct(total(values).alias("one"), total(F.transform(values, lambda y: y * y)).alias("two"), total(following).alias("cross"))
    return let(sums, lambda p: let(F.struct((n * p.two - p.one * p.one).alias("spread"), (n * p.cross - p.one * p.one).alias("both")), lambda v: F.when(
        v.spread > 0, (v.both / v.spread + F.lit(1.0) / (n - 1)) * F.sqrt(n))))


def _changes(classes: Column) -> Column:
    """How often the class differs between neighbours, from the lengths that are left without each pair of classes."""
    pairs = [a + b for a in "dulo" for b in "dulo" if a != b]
    return sum(((F.length(classes) - F.length(F.replace(classes, F.lit(p), F.lit("")))) / 2 for p in pairs), F.lit(0))


def _battery(token: Column, name: Column, parameters: Column) -> Column:
    """``z`` of the evidence against ordinary text (low: unlikely to be text), null where a test says it is not random. An
    alphabet of one class has no runs, so its evidence is the spread alone. One expression for all encodings: what tells them
    apart is looked up."""
    body = F.rtrim(F.when(name == "hex", F.lower(token)).otherwise(token), F.lit("="))
    characters = _UPPER + _LOWER + _DIGITS + "+/-_"

    def tests(x: Column, e: Column) -> Column:
        n = F.length(x).cast("double")
        k, every = e.k, F.split(x, "")
        squares = F.aggregate(F.array_distinct(every), F.lit(0.0), lambda a, c: a + F.pow(n - F.length(F.replace(x, c, F.lit(""))), F.lit(2.0)))
        values = F.transform(every, lambda c: F.instr(e.alphabet, c).cast("double"))
        measured = F.struct(n.alias("n"), (squares * k / n - n).alias("chi"),
                            let(values, lambda v: _serial(v, n)).alias("serial"),
                            _changes(F.translate(x, characters, characters.translate(_CLASSES))).alias("changes"))

        def judged(m: Column) -> Column:
            more, free = m.n - 1, k - 1
            even = (m.chi - free) / F.sqrt(free * 2.0 * more / m.n)
            spread = (m.chi - free - more * e.uneven) / F.sqrt(free * 2.0 + m.n * (e.uneven * 4.0))
            runs = (m.changes - more * e.q) / F.sqrt(more * (e.q * (F.lit(1.0) - e.q)))
            texty = (F.lit(0.5) + more * e.changes - m.changes) / F.sqrt(more * (e.changes * (F.lit(1.0) - e.changes)))
            plain = (F.abs(even) < NOT_RANDOM) & m.serial.isNotNull() & (F.abs(m.serial) < NOT_RANDOM)
            return F.when(plain & (e.q == 0), spread).when(plain & (F.abs(runs) < NOT_RANDOM), (spread + texty) / F.lit(2 ** 0.5))
        return let(measured, judged)
    return let(F.struct(body.alias("x"), F.element_at(parameters, name).alias("e")), lambda p: tests(p.x, p.e))


def candidates(text: Column) -> Column:
    """Runs of 16 or more characters of an encoding with their encoding, length class and evidence ``z``."""
    def named(m: Column) -> Column:
        name = F.lit(None).cast("string")
        for e in reversed(ENCODINGS):
            name = F.when(m.found.rlike(e.pattern), F.lit(e.name)).otherwise(name)
        return name

    def judged(m: Column, name: Column) -> Column:
        z = F.when(name.isNotNull(), _battery(m.found, name, _parameters()))
        return F.struct(m.start.alias("start"), m.rank.alias("rank"), m.end.alias("end"), m.kind.alias("kind"),
                        F.concat_ws("-", name, F.floor(F.log2(F.length(m.found)))).alias("stratum"),
                        F.greatest(F.lit(_LOWEST), F.least(F.lit(5.0), z)).alias("z"))
    return F.transform(matches(text, CANDIDATE, RANDOM, len(SHAPES)), lambda m: let(named(m), lambda name: judged(m, name)))


def scan(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and, of each whole text, ``__shaped`` and ``__candidates``: those that do not lie within a known shape.
    One that reaches beyond a shape is tested whole, and its span stands beside the shape's. Null and empty texts have neither; texts of
    any length are looked at whole; repeated rows stay apart; columns of ``docs`` that are not in ``keep`` are left out."""
    t = F.coalesce(F.col(text), F.lit(""))
    found = docs.select(*keep, shaped(t).alias("__shaped"), candidates(t).alias("__all"))
    free = F.filter("__all", lambda c: ~F.exists("__shaped", lambda s: (s.start <= c.start) & (c.end <= s.end)))
    return found.select(*keep, "__shaped", F.when(F.size("__all") > 0, free).otherwise(F.col("__all")).alias("__candidates"))


def thresholds(scanned: DataFrame, false_discoveries: float = FALSE_DISCOVERIES) -> dict[str, float]:
    """For each encoding and length class the largest ``z`` that the step-up rule of Benjamini and Hochberg accepts.

    Evidence is counted in bins of 0.05, before the shuffle; a bin counts with its upper edge. All candidates of the corpus
    take part, also those whose tests spoke against randomness. At most 500 bins of ten encodings and 40 length classes exist,
    so what reaches the driver is bounded."""
    # the outer form: for the inner one the optimizer asks for the size first, by computing all candidates once more
    each = scanned.select(F.explode_outer("__candidates").alias("c")).filter(F.col("c").isNotNull())
    bins = (each.groupBy(F.col("c.stratum").alias("stratum"), F.floor(F.col("c.z") / _BIN).alias("bin"))
            .agg(F.count(F.lit(1)).alias("n")))
    by: dict[str, dict] = {}
    for row in bins.withColumn("p", _phi((F.col("bin") + 1) * _BIN)).collect():
        by.setdefault(row.stratum, {})[row.bin] = (row.n, row.p)
    limits = {}
    for stratum, counted in by.items():
        everything, seen = sum(n for n, _ in counted.values()), 0
        for bin_ in sorted(b for b in counted if b is not None):
            n, p = counted[bin_]
            seen += n
            if p * everything <= false_discoveries * seen:
                limits[stratum] = (bin_ + 1) * _BIN
    return limits


def found_spans(limits: dict[str, float]) -> Column:
    """Known shapes and accepted candidates of scanned rows, by start, then kind."""
    if not limits:
        return F.col("__shaped")
    table = F.create_map(*[F.lit(x) for pair in sorted(limits.items()) for x in pair])
    accepted = F.filter("__candidates", lambda c: c.z < table[c.stratum])
    plain = F.transform(accepted, lambda c: F.struct(c.start, c.rank, c.end, c.kind, F.lit("").alias("found")))
    return F.when(F.size("__candidates") > 0, F.sort_array(F.concat(F.col("__shaped"), plain))).otherwise(F.col("__shaped"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def redacted(text: Column, spans: Column, mark: str) -> Column:
    """The text with every stretch that a span covers replaced by ``mark``; overlapping and touching spans become one."""
    merged = F.aggregate(spans, F.array().cast("array<struct<start:bigint,end:bigint>>"), lambda a, s: F.when(
        (F.size(a) > 0) & (F.get(a, F.size(a) - 1).end >= s.start),
        F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(
            F.get(a, F.size(a) - 1).start.alias("start"), F.greatest(F.get(a, F.size(a) - 1).end, s.end).alias("end"))))
    ).otherwise(F.concat(a, F.array(F.struct(s.start.alias("start"), s.end.alias("end"))))))

    def cut(m: Column) -> Column:
        kept = F.transform(m, lambda s, i: F.substring(
            text, (F.coalesce(F.get(m, i - 1).end, F.lit(0)) + 1).cast("int"),
            (s.start - F.coalesce(F.get(m, i - 1).end, F.lit(0))).cast("int")))
        rest = F.substring(text, (F.element_at(m, -1).end + 1).cast("int"), F.length(text))
        return F.concat(F.array_join(kept, mark), F.lit(mark), rest)
    return F.when(F.size(spans) > 0, let(merged, cut)).otherwise(text)


def secret_spans(scanned: DataFrame, limits: dict[str, float], keep: list[str]) -> DataFrame:
    """``keep``, the counts of the known shapes, ``base_spans`` and ``spans``. Null and empty texts have none."""
    def count(kind: str) -> Column:
        return F.size(F.filter("__shaped", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select(*keep, *[count(kind) for kind, *_ in SHAPES], span_text(F.col("__shaped")).alias("base_spans"),
                          span_text(found_spans(limits)).alias("spans"))


def redact_secrets(docs: DataFrame, text: str = "text", length: str | None = "n_chars", mark: str = "[SECRET]",
                   false_discoveries: float = FALSE_DISCOVERIES) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark`` and ``length`` counted anew where something was
    replaced. The texts are read twice, once for the thresholds and once to replace, and never shuffled."""
    limits = thresholds(scan(docs, [], text), false_discoveries)
    spans = found_spans(limits)
    marked = scan(docs.withColumn("__own", F.struct(*[F.col(c) for c in docs.columns])), ["__own"], f"__own.{text}")
    ready = marked.select("__own", redacted(F.col(f"__own.{text}"), spans, mark).alias("__text"), F.size(spans).alias("__n"))
    def column(c: str) -> Column:
        if c == text:
            return F.col("__text").alias(c)
        if c == length:
            return F.when(F.col("__n") > 0, F.length("__text").cast(docs.schema[c].dataType)).otherwise(F.col("__own")[c]).alias(c)
        return F.col("__own")[c].alias(c)
    return ready.select(*[column(c) for c in docs.columns])
