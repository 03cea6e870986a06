"""Best-fit packing after a dominance reduction.

Every document becomes ids with an end id; only longer ones are cut, into pieces of ``capacity``
ids after a first piece that may be shorter.  How many pieces there are of each length is all
that the plan depends on: at most ``capacity`` numbers, whatever the corpus.  On them the
reduction fixes bins that some optimal packing holds - a piece alone that no other fits, a
pair that fills a bin, or the largest partner where no pair of others beats it - and best-fit
decreasing packs the rest.  Equal bins are planned once, with a count.

Pieces then find their place from their rank among those of their length.  Ranks come from
counts per length and bucket, buckets growing with a length's count, so no task holds all
pieces of a common length.

Defined results: a null text counts as empty, its piece is the end id alone; repeated rows are
packed one by one; rows without a doc_id are packed too; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import document_columns, map_rows, written
from siltstone.llm.fast_tokens import ids_of

#: Words whose ids a worker remembers.
WORDS = 300_000

#: Pieces of one length that one rank bucket holds, about.
BUCKET_PIECES = 100_000


def _best_pair(counts: np.ndarray, room: int) -> int:
    """The largest sum of two available pieces within ``room``; 0 if none fits."""
    sizes = np.flatnonzero(counts)
    sizes = sizes[sizes < room]
    if not len(sizes):
        return 0
    at = np.searchsorted(sizes, room - sizes, "right") - 1
    best = 0
    for a, i in zip(sizes, at, strict=True):
        while i >= 0:
            b = sizes[i]
            if b != a or counts[a] > 1:
                best = max(best, int(a + b))
                break
            i -= 1
    return best


def reduce_instance(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix dominating bins; takes their pieces out of ``counts`` and returns (lengths, times)."""
    fixed: list[tuple[tuple[int, ...], int]] = []
    changed = True
    while changed:
        changed = False
        for size in range(capacity, 0, -1):
            while counts[size]:
                own = int(counts[size])
                room = capacity - size
                counts[size] -= 1
                others = np.flatnonzero(counts[: room + 1])
                partner = int(others[-1]) if len(others) else 0
                if not partner:
                    counts[size] += 1
                    # Nothing fits beside it, so neither does anything beside its equals, but for a pair of them.
                    times, lengths = (own, (size,))
                elif partner == room:
                    counts[size] += 1
                    times, lengths = (own // 2 if partner == size else min(own, int(counts[partner]))), (size, partner)
                else:
                    smallest, left = 0, 3
                    for s in others[:3]:
                        take = min(left, int(counts[s]))
                        smallest += int(s) * take
                        left -= take
                        if not left:
                            break
                    three_fit = left == 0 and smallest <= room
                    dominated = not three_fit and _best_pair(counts, room) <= partner
                    counts[size] += 1
                    if not dominated:
                        break
                    times, lengths = 1, (size, partner)
                fixed.append((lengths, times))
                for s in lengths:
                    counts[s] -= times
                changed = True
    return fixed


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: (lengths, times) of all bins."""
    bins: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]  # by room left
    for size in range(capacity, 0, -1):
        left = int(counts[size])
        room = size
        while left and room <= capacity:
            while left and bins[room]:
                lengths, times = bins[room].pop()
                each = room // size
                full = min(times, left // each)
                rest = left - full * each if full < times else 0
                if full:
                    bins[room - each * size].append((lengths + (size,) * each, full))
                if rest:
                    bins[room - rest * size].append((lengths + (size,) * rest, 1))
                if times - full - bool(rest):
                    bins[room].append((lengths, times - full - bool(rest)))
                left -= full * each + rest
            room += 1
        if left:
            each = capacity // size
            full, rest = divmod(left, each)
            if full:
                bins[capacity - each * size].append(((size,) * each, full))
            if rest:
                bins[capacity - rest * size].append(((size,) * rest, 1))
    return [b for same in bins for b in same]


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """All bins for so many pieces of each length, equal bins once with their number."""
    left = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        left[size] = n
    return reduce_instance(left, capacity) + best_fit(left, capacity)


def places(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length: rank from which each slot group applies, its first sequence, pieces a bin, first offset."""
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    first = 0
    for lengths, times in plan:
        at = 0
        for size in dict.fromkeys(lengths):
            each = lengths.count(size)
            slots.setdefault(size, []).append((taken.get(size, 0), first, each, at))
            taken[size] = taken.get(size, 0) + each * times
            at += each * size
        first += times
    return {size: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for size, rows in slots.items()}


def pieces_of(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, if asked for, the ids of every piece."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], [], [], []]
        for doc_id, ids in zip(batch.column(0).to_pylist(), ids_of(vocabulary, WORDS).encode(batch.column(1)), strict=True):
            ids = np.append(ids.astype("<u4"), np.uint32(end_id))
            n = len(ids)
            first = (n - 1) % capacity + 1
            edges = [0, *range(first, n + 1, capacity)]
            for k in range(len(edges) - 1):
                part = ids[edges[k] : edges[k + 1]].tobytes()
                for values, v in zip(out, (doc_id, k, edges[k], edges[k + 1] - edges[k], zlib.crc32(part), part if with_ids else None), strict=True):
                    values.append(v)
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    rows = map_rows(document_columns(docs), run, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")
    return rows if with_ids else rows.drop("ids")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece."""
    pieces = written(pieces_of(docs, vocabulary, capacity, end_id, with_ids))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    if not counts:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    place = places(plan_bins(counts, capacity))
    buckets = F.create_map(*[F.lit(int(x)) for size, n in sorted(counts.items()) for x in (size, -(-n // BUCKET_PIECES) * 4)])
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), buckets[F.col("length").cast("int")]))
    sums = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    base = sums.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("base"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = dealt.withColumn("within", within).join(base, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("within") - 1).drop("bucket", "within", "base")
    names = ranked.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        length, rank = (batch.column(names.index(c)).to_numpy() for c in ("length", "rank"))
        sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        for size in np.unique(length):
            own = length == size
            lo, first, each, at = place[int(size)]
            k = np.searchsorted(lo, rank[own], "right") - 1
            x = rank[own] - lo[k]
            sequence[own] = first[k] + x // each[k]
            offset[own] = at[k] + x % each[k] * size
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"{n} {t}" for n, t in ranked.dtypes) + ", sequence_id long, offset long"
    return map_rows(ranked, run, schema).select(*pieces.columns, "sequence_id", "offset")
