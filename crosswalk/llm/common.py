"""What the operators share: whole texts as words, shared folders, cut lineage, Arrow maps."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from crosswalk.session import cut_lineage, ensure_checkpoint_dir

#: Separators of words, as a character class that Java and DuckDB read alike.
SPACES = r"[\x20\x09-\x0D]+"

__all__ = ["SPACES", "cut_lineage", "fresh_folder", "map_rows", "table", "words", "with_bytes"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder; nothing is ever written twice to the same one."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def words(text: Column) -> Column:
    """Words of a text: everything between blanks and the controls 9 to 13. A null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def map_rows(df: DataFrame, per_batch: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` where each batch stands alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = per_batch(batch)
            if out is not None and out.num_rows:
                yield out
    return df.mapInArrow(run, schema)


def with_bytes(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text, one at a time; null counts as empty."""
    for value in column:
        yield b"" if not value.is_valid else value.as_buffer().to_pybytes()
