"""Token ids in a compact binary format, written in doc_id order and read back.

Ids are replaced by their rank in the corpus' frequency order, so that common ids take one byte.
Ranks are stored in one to four whole bytes; a separate stream of control bytes holds the lengths
of four ranks each.  Decoding looks lengths up in a table by control byte and gathers all bytes
at once.  The files are Parquet with one row per block of documents: ``shard, block, doc_ids,
counts, control, data`` and, beside them, the id of every rank.

Defined results: a null text counts as empty and holds the end id only; rows order by doc_id
(nulls first), equal doc_ids by their ids' checksum, so repeated rows follow one another; extra
columns are ignored; an empty table gives empty files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import discard, document_columns, map_rows, written
from siltstone.llm.fast_tokens import ids_of
from siltstone.sources.scratch import scratch

#: Ids of a block before the next one begins.
BLOCK_IDS = 1 << 18

#: Lengths of the four ranks that a control byte describes.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) % 4 + 1


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of an array of ranks below 2**32."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    size = 1 + (ranks > 0xFF) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    used = np.arange(4) < size[:, None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4) < size[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").ravel()


def tokenized(docs: DataFrame, vocabulary: str, end_id: int | None) -> DataFrame:
    """``doc_id, ids binary``: little-endian ids of every whole text, the end id appended."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = ids_of(vocabulary)
        tail = b"" if end_id is None else np.array([end_id], encoder.type).tobytes()
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([i.tobytes() + tail for i in encoder.encode(batch.column(1))], pa.binary())], ["doc_id", "ids"])

    return map_rows(document_columns(docs), run, "doc_id long, ids binary")


def _id_counts(tokens: DataFrame, vocabulary: str) -> DataFrame:
    """``id, n``: occurrences of every id, summed up within each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = ids_of(vocabulary).type
        total = np.zeros(0, np.int64)
        for batch in batches:
            own = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind))
            total, own = (total, own) if len(total) >= len(own) else (own, total)
            total[: len(own)] += own
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen])], ["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int | None = 2, block_ids: int = BLOCK_IDS) -> None:
    """Encode all documents and write ``path``/blocks and ``path``/ranks."""
    tokens = written(tokenized(docs, vocabulary, end_id))
    # As many rows as the vocabulary has ids, at most.
    order = _id_counts(tokens, vocabulary).orderBy(F.desc("n"), "id").collect()
    ids = [r["id"] for r in order]
    rank_of = np.zeros(max(ids, default=0) + 1, np.uint32)
    rank_of[ids] = np.arange(len(ids))
    tokens.sparkSession.createDataFrame([(i, r["id"], r["n"]) for i, r in enumerate(order)], "rank int, id int, n long").coalesce(1).write.parquet(f"{path}/ranks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = ids_of(vocabulary).type
        block = 0

        def close(rows: list[tuple]) -> pa.RecordBatch:
            counts = [len(r[1]) // kind.itemsize for r in rows]
            control, data = pack_ranks(rank_of[np.frombuffer(b"".join(r[1] for r in rows), kind)])
            doc_ids = pa.array([[r[0] for r in rows]], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([rows[0][2]], pa.int32()), pa.array([block], pa.int32()), doc_ids, pa.array([counts], pa.list_(pa.int32())), pa.array([control], pa.binary()), pa.array([data], pa.binary())], ["shard", "block", "doc_ids", "counts", "control", "data"])

        rows, held = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append(row)
                held += len(row[1]) // kind.itemsize
                if held >= block_ids:
                    yield close(rows)
                    rows, held, block = [], 0, block + 1
        if rows:
            yield close(rows)

    ordered = tokens.repartitionByRange("doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.crc32("ids"), F.length("ids"))
    blocks = ordered.select("doc_id", "ids", F.spark_partition_id().alias("shard")).mapInArrow(run, "shard int, block int, doc_ids array<long>, counts array<int>, control binary, data binary")
    blocks.write.parquet(f"{path}/blocks")
    discard(tokens)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` in file order; ids as little-endian unsigned 32-bit bytes."""
    order = [r["id"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()]
    id_of = np.array(order or [0], "<u4")
    blocks = spark.read.parquet(f"{path}/blocks").withColumn("n", F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c))
    # First the shards' totals, few, then the blocks within each shard.
    shards = blocks.groupBy("shard").agg(F.sum("n").alias("total"))
    before = shards.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("shard_start"))
    heads = blocks.select("shard", "block", "n").withColumn("block_start", F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n"))
    starts = heads.join(before, "shard").select("shard", "block", (F.col("shard_start") + F.col("block_start")).alias("start"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], []]
        for row in batch.to_pylist():
            ids = id_of[unpack_ranks(row["control"], row["data"], row["n"])]
            at = 0
            for doc_id, count in zip(row["doc_ids"], row["counts"], strict=True):
                for values, v in zip(out, (doc_id, row["start"] + at, count, ids[at : at + count].tobytes()), strict=True):
                    values.append(v)
                at += count
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "start", "n_tokens", "ids"])

    return map_rows(blocks.join(starts, ["shard", "block"]), run, "doc_id long, start long, n_tokens long, ids binary")


def written_and_read(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Write all documents to the shared folder, read the files back; adds ``ids_crc32``."""
    path = scratch(docs.sparkSession)
    write_tokens(docs, path, vocabulary, end_id)
    return read_tokens(docs.sparkSession, path).withColumn("ids_crc32", F.crc32("ids"))


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
