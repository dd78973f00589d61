"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewise.session import ship_package as ship

#: The six ASCII white-space bytes that separate words, as ``bytes.split()`` does.
WORD_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of every row of a string column; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: str = "text", max_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``max_bytes`` of text (at least one row each),
    so that working arrays stay small whatever the batch size is."""
    import pyarrow.compute as pc
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > max_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def map_rows(df: DataFrame, fn: Callable, schema: str, column: str = "text") -> DataFrame:
    """``mapInArrow`` of a function from a (small) RecordBatch to a RecordBatch or None; ``column`` holds the texts."""
    ship(df.sparkSession)

    def run(batches):
        for batch in batches:
            for part in slices(batch, column):
                out = fn(part)
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """Only the columns an operator reads, so extra or clashing columns cannot matter."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       *[F.col(c).cast("string").alias(c) for c in more])
