"""Near-duplicate classes by min-max hashing, banding and confirmation on full sets.

Every permutation gives two signature values, the smallest and the largest hash, so half the
hash evaluations fill the bands.  Texts with the same words are one node from the start.
Links are confirmed on whole shingle sets.

Within a bucket, nodes are first compared with one pivot, so a group of thousands of copies
costs about as many comparisons as it has members; further pivots follow as long as a tenth of
the comparisons links.  What is then still apart is compared across components, in blocks of
``BLOCK`` members.  Every comparison first bounds the overlap by parity sketches: each shingle
flips one bit, so the bits in which two sketches differ are at most the shingles in which the
sets differ.  The bound is exact, no pair that reaches the similarity fails it; only pairs near
the similarity are left for the texts to decide, in a large group of loose copies as elsewhere.

At a similarity of 0.8 a link shares none of the 40 bands of 6 values with probability
(1 - 0.8^6)^40, about 5 in a million.

Defined results: null, empty and word-less texts have an empty set and are linked with
nothing; rows without a doc_id are linked with nothing, their component_id is null and they are
kept; rows that share a doc_id are one document, whatever their texts; repeated rows give
repeated results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import discard, document_columns, map_rows, written
from siltstone.llm.components import NARROW, components, contracted

BANDS, ROWS = 40, 6
#: Members of a bucket that one task compares with as many others at a time.
BLOCK = 512
#: Pivots are chosen anew while this share of their comparisons links.
PIVOTS_PAY = 0.1


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASH = _WordHashes()


def shingle_set(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct 64-bit prints of the ``width``-word shingles; all words as one if fewer."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASH.__getitem__, words), np.uint64, len(words))
    width = min(width, len(h))
    n = len(h) - width + 1
    x = h[:n].copy()
    for k in range(1, width):
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x += h[k : k + n]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    x.sort()
    return x[np.concatenate(([True], x[1:] != x[:-1]))]


@lru_cache(4)
def _permutations(bands: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    n = bands * rows // 2
    return (rng.integers(0, 2**31, (n, 1), np.uint64) * 2 + 1).astype(np.uint32), rng.integers(0, 2**32, (n, 1), np.uint64).astype(np.uint32), rng.integers(0, 2**63, (bands, rows), np.uint64) * np.uint64(2) + np.uint64(1)


def min_max_signature(prints: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """``bands x rows`` values: the first half of the bands from minima, the second from maxima."""
    a, b, _ = _permutations(bands, rows)
    x = (prints >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(a), 2**32 - 1, np.uint32)
    high = np.zeros(len(a), np.uint32)
    for i in range(0, len(x), 2048):
        h = a * x[None, i : i + 2048] + b
        np.minimum(low, h.min(1), out=low)
        np.maximum(high, h.max(1), out=high)
    return np.concatenate([low, high]).reshape(bands, rows)


def band_keys(signature: np.ndarray) -> np.ndarray:
    bands, rows = signature.shape
    _, _, mix = _permutations(bands, rows)
    s = signature.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    s ^= s >> np.uint64(31)
    key = (s * mix).sum(1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    key ^= key >> np.uint64(32)
    return (key * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def _words(text: str) -> list[bytes]:
    """ASCII-lower-cased words between the six ASCII separators."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def parity_sketch(prints: np.ndarray) -> bytes:
    """One bit per print modulo the size, a power of two of at least the number of prints, flipped by each."""
    size = max(64, 1 << (len(prints) - 1).bit_length())
    flips = np.bincount((prints & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(flips.astype(np.uint8)).tobytes()


def _fits(differ: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of ``sizes`` shingles together that differ in ``differ`` at least can reach the similarity."""
    return differ * (100 + percent) <= sizes * (100 - percent)


def signatures(docs: DataFrame, width: int = 4, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, digest, n_shingles, bands, sketch`` of every row; digest is null for an empty set."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        digest, size, keys, sketch = [], [], [], []
        for text in batch.column(1).to_pylist():
            words = _words(text) if text else []
            if not words:
                digest.append(None), size.append(0), keys.append(None), sketch.append(None)
                continue
            prints = shingle_set(words, width)
            digest.append(xxhash.xxh3_128_digest(b" ".join(words)))
            size.append(len(prints))
            keys.append(band_keys(min_max_signature(prints, bands, rows)))
            sketch.append(parity_sketch(prints))
        arrays = [batch.column(0), pa.array(digest, pa.binary()), pa.array(size, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "digest", "n_shingles", "bands", "sketch"])

    return map_rows(document_columns(docs), run, "doc_id long, digest binary, n_shingles long, bands array<long>, sketch binary")


def _packed_words(docs: DataFrame) -> DataFrame:
    """``rep, digest, words``: compressed lower-cased words, to keep shuffles small."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pack = zstandard.ZstdCompressor(level=1).compress
        joined = [b" ".join(_words(t)) if t else b"" for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f(x) if x else None for x in joined], pa.binary()) for f in (xxhash.xxh3_128_digest, pack))], ["rep", "digest", "words"])

    return map_rows(document_columns(docs), run, "rep long, digest binary, words binary")


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those pairs ``a, b`` whose full sets reach the similarity."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        unpack = zstandard.ZstdDecompressor().decompress
        seen: dict[bytes, np.ndarray] = {}
        cols = [batch.column(i) for i in range(4)]
        a_ids, b_ids = cols[0].to_pylist(), cols[1].to_pylist()
        keep = []
        for i, (a, b) in enumerate(zip(a_ids, b_ids, strict=True)):
            pair = []
            for k, which in ((a, 2), (b, 3)):
                if k not in seen:
                    if len(seen) > 64:
                        seen.clear()
                    seen[k] = shingle_set(unpack(cols[which][i].as_py()).split(), width)
                pair.append(seen[k])
            both = len(np.intersect1d(*pair, assume_unique=True))
            keep.append(100 * both >= percent * (len(pair[0]) + len(pair[1]) - both))
        return pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in cols[:2]], ["a", "b"])

    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("words").alias("a_words")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("words").alias("b_words")), "b")
    return map_rows(both.select("a", "b", "a_words", "b_words"), run, "a binary, b binary")


#: Nodes are 16 bytes: the smallest doc_id of a text, in an order that keeps that of the numbers, and half of its digest.
_NODE = "unhex(concat(lpad(hex(rep ^ -9223372036854775808L), 16, '0'), substr(hex(digest), 1, 16)))"


def _rep_of(node: str) -> Column:
    return F.expr(f"cast(conv(hex(substr({node}, 1, 8)), 16, -10) AS bigint) ^ -9223372036854775808L")


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row."""
    sigs = written(signatures(docs, width, bands, rows))
    usable = sigs.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    texts = usable.groupBy("digest").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n_shingles", "bands", "sketch")])
    classes = written(texts.withColumn("node", F.expr(_NODE)))
    links = _links(docs, classes, width, percent)
    # A doc_id with several texts ties them together.
    tied = usable.groupBy("doc_id").agg(F.min(F.xxhash64("digest")).alias("lo"), F.max(F.xxhash64("digest")).alias("hi")).where("lo < hi").select("doc_id")
    ties = usable.join(tied, "doc_id").join(classes.select("digest", "node"), "digest").select("doc_id", "node")
    ties = written(ties.join(ties.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").select("a", F.col("node").alias("b")).where("a <> b"), NARROW)
    labels = components(links.unionByName(ties))
    per_class = classes.join(labels, "node", "left").select("digest", F.when(F.col("label").isNull(), F.col("rep")).otherwise(_rep_of("label")).alias("component"))
    out = sigs.select("doc_id", "digest", "n_shingles").join(per_class, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def _sketch_matrix(sketches: list[bytes], size: int) -> np.ndarray:
    """Sketches folded to ``size`` bytes each, as 64-bit words."""
    out = np.empty((len(sketches), size), np.uint8)
    for i, s in enumerate(sketches):
        np.bitwise_xor.reduce(np.frombuffer(s, np.uint8).reshape(-1, size), axis=0, out=out[i])
    return out.view(np.uint64)


def _near_pairs(sketches: list[bytes], n: np.ndarray, apart: Callable[[np.ndarray, np.ndarray], np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs of places that ``apart`` allows, whose sizes and sketches fit the similarity."""
    widths = np.array([len(s) for s in sketches])
    found: list[tuple[int, int]] = []
    for size in np.unique(widths).tolist():
        own, wide = np.flatnonzero(widths == size), np.flatnonzero(widths > size)
        both = np.concatenate([own, wide])
        matrix = _sketch_matrix([sketches[i] for i in both], size)
        for row, i in enumerate(own.tolist()):
            other = both[row + 1 :]
            fit = apart(np.int64(i), other) & (100 * np.minimum(n[i], n[other]) >= percent * np.maximum(n[i], n[other]))
            at = np.flatnonzero(fit)
            differ = np.bitwise_count(matrix[row] ^ matrix[row + 1 :][at]).sum(1, dtype=np.int64)
            found += [(i, int(j)) for j in other[at[_fits(differ, n[i] + n[other[at]], percent)]]]
    return found


def _pivot_pairs(open_: DataFrame, turn: int, percent: int) -> DataFrame:
    """``a, b``: members of open buckets with the pivot of their bucket, where their sketches allow a link."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = {name: batch.column(k).to_pylist() for k, name in enumerate(("a", "b", "n_a", "n_b", "s_a", "s_b"))}
        keep = []
        for n_a, n_b, s_a, s_b in zip(*(cols[c] for c in ("n_a", "n_b", "s_a", "s_b")), strict=True):
            pair = _sketch_matrix([s_a, s_b], min(len(s_a), len(s_b)))
            keep.append(bool(_fits(np.bitwise_count(pair[0] ^ pair[1]).sum(dtype=np.int64), n_a + n_b, percent)))
        return pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in (0, 1)], ["a", "b"])

    chosen = F.min("node") if not turn else F.min_by("node", F.xxhash64("node", F.lit(turn)))
    pivots = open_.groupBy("key").agg(chosen.alias("pivot")).withColumnRenamed("key", "p_key")
    pivots = open_.join(pivots, F.expr("key = p_key AND node = pivot")).select("key", *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "sketch", "label")])
    met = open_.join(pivots.hint("merge"), "key").where(F.expr(f"label <> label_b AND 100 * least(n, n_b) >= {percent} * greatest(n, n_b)"))
    asked = met.groupBy(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b")).agg(*[F.first(c).alias(c) for c in ("n", "n_b", "sketch", "sketch_b")])
    return map_rows(asked.select("a", "b", "n", "n_b", "sketch", "sketch_b"), run, "a binary, b binary")


def _cross_pairs(open_: DataFrame, percent: int) -> DataFrame:
    """``a, b``: members of one bucket in different components, where their sketches allow a link.

    A bucket of more than ``BLOCK`` members is dealt out as pairs of blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            node, label, block = (group.column(c).to_numpy(zero_copy_only=False) for c in ("node", "label", "block"))
            split = group.column("lo")[0].as_py() != group.column("hi")[0].as_py()
            apart = lambda i, j: (label[j] != label[i]) & ((block[j] != block[i]) | (not split))  # noqa: B023, E731
            pairs = [sorted((node[i], node[j])) for i, j in _near_pairs(group.column("sketch").to_pylist(), group.column("n").to_numpy(), apart, percent)]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], ["a", "b"])

    blocks = open_.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).withColumnRenamed("key", "c_key")
    dealt = open_.join(blocks, F.col("key") == F.col("c_key")).withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), "blocks").cast("int"))
    met = dealt.select("key", "node", "n", "sketch", "label", "block", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    met = met.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "n", "sketch", "label")
    return met.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(run, "a binary, b binary").distinct()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows with one key, lo and hi at a time, from batches sorted by them."""
    left: pa.Table | None = None
    for batch in batches:
        own = pa.Table.from_batches([batch])
        left = own if left is None else pa.concat_tables([left, own])
        ids = [left.column(c).to_numpy() for c in ("key", "lo", "hi")]
        cuts = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in ids])) + 1
        start = 0
        for cut in cuts.tolist():
            yield left.slice(start, cut - start)
            start = cut
        left = left.slice(start)
    if left is not None and len(left):
        yield left


def _links(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """``a, b``: links between nodes, enough of them to join every component."""
    spark = docs.sparkSession
    nothing = spark.createDataFrame([], "a binary, b binary")
    heads = classes.select("node", F.explode("bands").alias("key"))
    crowded = heads.groupBy("key").agg(F.count("*").alias("times")).where("times > 1").select(F.col("key").alias("c_key"))
    met = written(heads.join(crowded, F.col("key") == F.col("c_key")).select("key", "node"))
    # Buckets with the same members ask the same questions: one of them stays.
    alike = met.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.hash("node")).alias("s")).groupBy("n", "x", "s").agg(F.min("key").alias("key")).select("key")
    known = classes.select("node", "digest", "rep", F.col("n_shingles").alias("n"), "sketch")
    open_ = written(met.join(alike, "key").join(known.select("node", "n", "sketch"), "node").select("key", "node", "n", "sketch", F.col("node").alias("label")))
    if not open_.take(1):
        return nothing
    asked = known.join(open_.select("node").distinct(), "node", "left_semi").select("node", F.col("rep").alias("r"), F.col("digest").alias("d"))
    packed = _packed_words(docs).where(F.col("rep").isNotNull() & F.col("digest").isNotNull())
    texts = written(packed.join(asked, F.expr("rep = r AND digest = d")).groupBy("node").agg(F.first("words").alias("words")))
    discard(met)
    links, labels, turn = nothing, None, 0
    while True:
        pairs = written(_pivot_pairs(open_, turn, percent), NARROW)
        new = written(_confirmed(pairs, texts, width, percent), NARROW)
        n_pairs, n_new = pairs.count(), new.count()
        if n_new:
            links = links.unionByName(new)
            labels = contracted(labels, new)
            # Components only grow, so a bucket that lies in one of them is done.
            placed = open_.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
            spread = placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select(F.col("key").alias("s_key"))
            last, open_ = open_, written(placed.join(spread, F.col("key") == F.col("s_key")).drop("s_key"))
            discard(last)
        turn += 1
        if n_new < max(1, PIVOTS_PAY * n_pairs):
            break
    last = written(_confirmed(written(_cross_pairs(open_, percent), NARROW), texts, width, percent), NARROW)
    discard(open_), discard(texts)
    return links.unionByName(last)


def kept_documents(docs: DataFrame, width: int = 4, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component, all columns; rows without a doc_id stay.

    Of several rows with the doc_id that stays, the one with the smallest text does.
    """
    keys = near_duplicates(docs, width, percent).where(F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    known = docs.where(F.col("doc_id").isNotNull()).join(keys, "doc_id", "left_semi").select(docs.columns)
    twice = known.groupBy("doc_id").agg(F.count("*").alias("times")).where("times > 1").select("doc_id")
    single = known.join(twice, "doc_id", "left_anti").select(docs.columns)
    one_each = known.join(twice, "doc_id").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.col("text").cast("string")).alias("row")).select("row.*")
    return single.unionByName(one_each).unionByName(docs.where(F.col("doc_id").isNull()))
