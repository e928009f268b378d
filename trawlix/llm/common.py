"""Helpers shared by the training-data operators.

Text reaches Python as Arrow binary batches. Each batch is handled in chunks of
bounded bytes, so memory follows the longest single document and not the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlix.operators.ordering import cut, forget, prefix_sums, split_join

__all__ = ["LOWER", "binary", "chunks", "cut", "fold", "forget", "prefix_sums", "split_join", "table"]

#: Bytes of text that one chunk gathers before it is handed on.
CHUNK_BYTES = 4 << 20
#: Maps the ASCII capitals A-Z to a-z and leaves every other byte alone.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id falls in fold -1."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % modulus, F.lit(-1))


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches, each with its texts as bytes (null: empty).

    A slice holds at most ``limit`` bytes of text, or one longer document.
    """
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        n = len(column)
        if n == 0:
            continue
        lengths = np.asarray(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        ends = np.cumsum(lengths)
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            part = batch.slice(at, to - at)
            yield part, [x or b"" for x in part.column(part.schema.get_field_index(text)).to_pylist()]
            at = to


def binary(df: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The columns ``keep`` and the text as UTF-8 bytes, ready for ``mapInArrow``."""
    return df.select(*keep, F.col(text).cast("binary").alias(text))
