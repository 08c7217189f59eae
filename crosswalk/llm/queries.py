"""The operators over the driver's tables, with production parameters."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crosswalk.llm import bpe, conversations, licenses, lm, packing, quality, secrets, shards, simhash, spelling, tokens, urls, winnow
from crosswalk.llm.common import cut_lineage, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


@query("op1_secret_scans")
def secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = cut_lineage(secrets.scan(table(spark, sf_dir, "documents"), ["doc_id"]))
    found = secrets.secret_spans(scanned, secrets.thresholds(scanned), ["doc_id"])
    return found.withColumn("base_spans", F.sha2("base_spans", 256)).withColumnRenamed("base_spans", "base_sha256")


@query("op2_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


@query("op3_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024)


_SPACES = r"[\x20\x09-\x0D]+"
QUALITY_SQL = rf"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACES}'), lambda x: x <> '') AS w
  FROM documents),
lines AS (
  SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
    list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' ')) AS windows
  FROM split),
again AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(pos, pos + 8)) AS p FROM (
      SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, g) AS copies
      FROM (SELECT doc_id, unnest(windows) AS g, generate_subscripts(windows, 1) AS pos FROM lines)) WHERE copies > 1)
  GROUP BY doc_id),
measured AS (
  SELECT lines.doc_id, t, w, l, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(again.n, 0) AS n_repeat_words
  FROM lines LEFT JOIN again ON lines.doc_id = again.doc_id),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR 2 * n_dup_lines > len(l) OR 10 * (length(t) - length(replace(t, '!', ''))) > 3 * n_words
    OR 2 * length(regexp_replace(t, '\P{{Lu}}+', '', 'g')) > length(regexp_replace(t, '\P{{L}}+', '', 'g'))
    OR 2 * len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) < n_words) AS kept
FROM judged"""


@query("op4_quality_rules", QUALITY_SQL)
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(table(spark, sf_dir, "documents"))


@query("op7_packing")
def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("ids")


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
URL_SQL = r"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS r FROM pages),
rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'),
  ('org', '/fr/', 'allow')),
fitting AS (
  SELECT r, h || p AS rule, v, row_number() OVER (PARTITION BY r ORDER BY length(h || p) DESC) AS k
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fitting WHERE k = 1) AS best ON parts.r = best.r"""


@query("op10_url_filters", URL_SQL)
def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select(
        "page_id", "host", "path", "rule", "verdict")


@query("op5_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                          public_tokenizers.PATTERN)


@query("op8_document_fingerprints")
def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.fingerprints(table(spark, sf_dir, "documents"))


@query("op6_lm_scoring")
def lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


@query("op9_training_shards")
def training_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.materialise(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def misspelled(key: object, counted: Counter) -> Iterator[tuple[bytes, int]]:
    """The runs of one text, those without a letter that the checksum of key and run strikes out."""
    before = zlib.crc32(b"%s:" % (b"" if key is None else str(key).encode()))
    for word, n in counted.items():
        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), before)
        if h % 97 == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1:]
        yield word, n


@query("op11_spelling_variants")
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), change=misspelled)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with the faults that the checksum of each row's place names; nulls are one blank."""
    said = F.coalesce("text", F.lit(" "))
    fault = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])) % 20
    return (rows.select("conv_id", "turn", "role", said.alias("text"), fault.alias("fault")).filter("fault <> 0")
            .select("conv_id", "turn", F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                    F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", ""))
                    .otherwise(F.col("text")).alias("text"),
                    F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy")).drop("copy"))


@query("op13_conversation_repair")
def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversations.with_all(conversations.repair_reports(damaged(rows)), rows).drop("n_rows")


@query("op12_license_scans")
def license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s.phrase)
    def labels(spans: Column) -> Column:
        return F.array_join(F.sort_array(F.array_distinct(spans.label)), ",")
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(base.start).alias("first_word"),
                        F.array_max(base.start).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"),
                        "score")
