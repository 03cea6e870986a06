"""Helpers shared by the training-data operators: scratch folder, Arrow mapping, words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.sources.scratch import scratch

#: The six characters that separate words everywhere in this subpackage.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
#: Rows that a function of whole texts gets at a time.
SLICE = 1024


def written(df: DataFrame, narrow: int = 1) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back: lineage ends there.

    ``narrow`` times fewer files than shuffle partitions are written, for tables of a few bytes per document.
    """
    spark = df.sparkSession
    path = scratch(spark)
    if narrow > 1:
        df = df.coalesce(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // narrow))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Empties the folders that ``written`` made for ``df``; it must not be read again."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(path)


def map_rows(df: DataFrame, fn: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of at most ``SLICE`` rows, so that few whole texts are unpacked at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                out = fn(batch.slice(start, SLICE))
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def document_columns(docs: DataFrame) -> DataFrame:
    """The two columns that every document operator reads; extra columns never clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def null_safe(pairs: list[tuple[Column, Column]]) -> Column:
    cond = pairs[0][0].eqNullSafe(pairs[0][1])
    for a, b in pairs[1:]:
        cond = cond & a.eqNullSafe(b)
    return cond
