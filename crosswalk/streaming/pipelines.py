"""The stateless operators on streams: mapping, route matching and rule scans run unchanged on ``readStream`` input."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from crosswalk.operators.apply import apply_mapping
from crosswalk.operators.scan import scan_rules


def stream_of(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A folder of parquet files as a stream; the schema comes from the files that are there."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def start(stream: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Run a stateless step over what is available now and stop. The checkpoint folder has to be shared; written
    batches are not written twice when the query starts again."""
    return (step(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def start_mapping(stream: DataFrame, plan: Sequence[tuple[str, str]], consumer_fields: Sequence, out: str, checkpoint: str,
                  keep: Sequence[str] = ()) -> StreamingQuery:
    return start(stream, lambda df: apply_mapping(df, plan, consumer_fields, keep=keep), out, checkpoint)


def start_rule_scan(stream: DataFrame, rules: Sequence[tuple[str, str]], keys: list[str], out: str, checkpoint: str,
                    text: str = "text") -> StreamingQuery:
    return start(stream, lambda df: scan_rules(df, rules, keys, text), out, checkpoint)
