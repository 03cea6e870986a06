"""Removal of every byte inside a string of ``width`` bytes that also starts elsewhere.

Suffixes are taken at anchors only: positions whose ``GRAM``-byte hash is the least in some
window of ``width`` bytes.  Every window holds the anchor that its own bytes decide, so two equal
windows meet at an equal gram.  Grams that occur once are dropped; an anchor whose whole
surroundings occur again is settled at once.  For the rest, the surroundings are keyed by
the half window to the right, or to the left, of the anchor - one of them lies inside any window -
and each group is resolved as an enhanced suffix array: members sorted by what follows,
common prefixes of neighbours, a stack scan that yields the common-prefix interval tree, and
in each interval the left extensions, whose diversity tells the maximal repeats and how far
each occurrence reaches.  All occurrences of a group are reported, not only neighbours.

Groups of more than ``MOST_IN_GROUP`` different surroundings would make one task's tree grow without
bound, so their tree is cut across at the one depth that matters and dealt over the cluster: a window
of ``width`` bytes that starts so many bytes before the core is a node of the tree of the suffixes from
there, an inner node if it is counted twice.  The result is the same; a test holds one against the other.

Surroundings are equal if their own and their gram's 64-bit prints are; partial overlaps are
decided by comparing bytes (or, in the largest groups, prints).

Defined results: a null text counts as empty; texts under ``width`` bytes keep everything;
a repeated row is another occurrence of all its strings; rows without a doc_id take part like
others; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import document_columns, map_rows, written

WIDTH, GRAM = 200, 32
MOST_IN_GROUP = 20_000
#: Bytes of texts whose anchors are found at a time, longer texts alone.
CHUNK = 1 << 19

_RNG = np.random.default_rng(7)
_BYTE = _RNG.integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 2**64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]), 1 << 16)
        for k, base in enumerate((_BASE, _BACK)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[k] = np.multiply.accumulate(x)
    return _POWERS[0], _POWERS[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Prints:
    """Hashes of any substrings of one text."""

    def __init__(self, data: bytes) -> None:
        up, self.down = _powers(len(data) + 1)
        raw = _BYTE[np.frombuffer(data, np.uint8)]
        raw *= up[: len(raw)]
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(raw, out=self.sums[1:])

    def all_of(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return _mixed((self.sums[size:] - self.sums[:n]) * self.down[:n])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[stop] - self.sums[start]) * self.down[start])


def _sliding(a: np.ndarray, w: int, ufunc: np.ufunc, fill: int) -> np.ndarray:
    """Least (or greatest) of every ``w`` neighbours, in two running passes over blocks of ``w``."""
    n = len(a)
    blocks = np.full(-(-n // w) * w, fill, a.dtype)
    blocks[:n] = a
    blocks = blocks.reshape(-1, w)
    ahead = ufunc.accumulate(blocks, axis=1).ravel()
    behind = ufunc.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return ufunc(behind[: n - w + 1], ahead[w - 1 : n])


def anchors(prints: Prints, starts: np.ndarray, sizes: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Anchor positions and the text of each, for texts that lie one after another, none shorter than ``width``."""
    # Half of the print is enough to choose by; a tie only adds an anchor.
    grams = (prints.all_of(gram) >> np.uint64(32)).astype(np.uint32)
    w = width - gram + 1
    least = _sliding(grams, w, np.minimum, 2**32 - 1)
    # Windows that reach into the next text decide nothing.
    ends = starts + sizes
    for end in ends[:-1].tolist():
        least[end - width + 1 : end] = 0
    pad = np.zeros(w - 1, np.uint32)
    of_windows = _sliding(np.concatenate([pad, least, pad]), w, np.maximum, 0)
    at = np.flatnonzero(grams == of_windows)
    text = np.searchsorted(starts, at, "right") - 1
    inside = at + gram <= ends[text]
    return at[inside], text[inside]


def _anchor_arrays(texts: list[bytes], width: int, gram: int) -> list[np.ndarray]:
    """Text, position in it, gram, surroundings and the right and left half keys (0: none) of each anchor."""
    sizes = np.array(list(map(len, texts)))
    starts = np.cumsum(sizes) - sizes
    reach = width - gram
    half = reach // 2
    prints = Prints(b"".join(texts))
    at, text = anchors(prints, starts, sizes, width, gram)
    first, n = at - starts[text], sizes[text]
    left, right = np.minimum(reach, first), np.minimum(reach, n - first - gram)
    grams = prints.of(at, at + gram)
    around = _mixed(prints.of(at - left, at + gram + right) + (left * 1000 + right).astype(np.uint64))
    to_right = np.where(right >= half, _mixed(prints.of(at, at + gram + np.minimum(right, half)) + np.uint64(1)), 0).astype(np.uint64)
    to_left = np.where(left >= half, _mixed(prints.of(at - np.minimum(left, half), at + gram) + np.uint64(2)), 0).astype(np.uint64)
    return [text, first.astype(np.int32), *(x.view(np.int64) for x in (grams, around, to_right, to_left))]


def _data(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def anchor_rows(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """One row per anchor: ``doc_id, mark, at, gram, around, to_right, to_left``; mark tells texts of one doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, own = [], []
            size = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = _data(text)
                if len(data) >= width:
                    ids.append(doc_id), own.append(data)
                    size += len(data)
                if size > CHUNK:
                    yield rows(ids, own)
                    ids, own, size = [], [], 0
            if own:
                yield rows(ids, own)

    def rows(ids: list, own: list[bytes]) -> pa.RecordBatch:
        text, *columns = _anchor_arrays(own, width, gram)
        index = pa.array(text)
        marks = pa.array([zlib.crc32(d) - 2**31 for d in own], pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()).take(index), marks.take(index), *map(pa.array, columns)], ["doc_id", "mark", "at", "gram", "around", "to_right", "to_left"])

    return document_columns(docs).mapInArrow(run, "doc_id long, mark int, at int, gram long, around long, to_right long, to_left long")


def repeat_spans(before: list[bytes], after: list[bytes], need: int) -> list[list[tuple[int, int]]]:
    """For members that share a core: how far each repeats, as (bytes before, bytes after) the core.

    Only spans with at least ``need`` bytes beyond the core count.  ``before`` is read backwards.
    """
    m = len(after)
    # As numbers of one size, the first bit in which two strings differ tells what they share.
    size = max(map(len, [*before, *after]), default=0)
    sizes = [[len(x) for x in part] for part in (before, after)]
    numbers = [[int.from_bytes(x.ljust(size, b"\0")) for x in part] for part in ([b[::-1] for b in before], after)]

    def common(part: int, i: int, j: int) -> int:
        shared = size - (((numbers[part][i] ^ numbers[part][j]).bit_length() + 7) >> 3)
        return min(shared, sizes[part][i], sizes[part][j])

    order = sorted(range(m), key=lambda i: (numbers[1][i], sizes[1][i]))
    prefix = [0, *(common(1, order[i - 1], order[i]) for i in range(1, m)), -1]
    by_left = sorted(range(m), key=lambda i: (numbers[0][i], sizes[0][i]))
    place = [0] * m
    for i, x in enumerate(by_left):
        place[x] = i
    spans: list[list[tuple[int, int]]] = [[] for _ in range(m)]

    def report(depth: int, lo: int, hi: int) -> None:
        """An interval of the tree: suffixes lo..hi-1 share ``depth`` bytes after the core."""
        inside = sorted(order[lo:hi], key=place.__getitem__)
        previous = 0
        for i, x in enumerate(inside):
            following = common(0, x, inside[i + 1]) if i + 1 < len(inside) else 0
            reach = max(previous, following)
            if reach + depth >= need and not any(a >= reach and b >= depth for a, b in spans[x]):
                spans[x].append((reach, depth))
            previous = following

    stack = [(0, 0)]  # (common prefix, first suffix) of the open intervals
    for i in range(1, m + 1):
        start = i - 1
        while stack and stack[-1][0] > prefix[i]:
            depth, start = stack.pop()
            report(depth, start, i)
        if not stack or stack[-1][0] < prefix[i]:
            stack.append((prefix[i], start))
    return spans


SPAN = "doc_id long, mark int, start int, stop int"


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of whole keys, from batches that are sorted by key."""
    open_: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column("key").to_numpy()
        if not len(keys):
            continue
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if open_ and open_[-1].column("key")[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(open_)
            open_ = []
        if len(cuts):
            yield pa.Table.from_batches([*open_, batch.slice(0, cuts[-1])])
            open_ = [batch.slice(cuts[-1])]
        else:
            open_.append(batch)
    if open_:
        yield pa.Table.from_batches(open_)


def _resolve_groups(surroundings: DataFrame, need: int) -> DataFrame:
    """Spans of the single members of small groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            keys = table.column("key").to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            before, after, single = table.column("before").to_pylist(), table.column("after").to_pylist(), (table.column("n").to_numpy() == 1).tolist()
            rows, reach, depth = [], [], []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi - lo < 2:
                    continue
                for i, found in enumerate(repeat_spans(before[lo:hi], after[lo:hi], need), lo):
                    for r, d in found if single[i] else ():
                        rows.append(i), reach.append(r), depth.append(d)
            at = np.array(rows, np.int64)
            start, stop = table.column("core").to_numpy()[at] - np.array(reach, np.int32), table.column("core_end").to_numpy()[at] + np.array(depth, np.int32)
            who = [table.column(c).combine_chunks().take(pa.array(at)) for c in ("doc_id", "mark")]
            yield pa.RecordBatch.from_arrays([*who, pa.array(start, pa.int32()), pa.array(stop, pa.int32())], ["doc_id", "mark", "start", "stop"])

    return surroundings.repartition("key").sortWithinPartitions("key").mapInArrow(run, SPAN)


def _resolve_by_windows(surroundings: DataFrame, need: int) -> DataFrame:
    """The same for groups of any size: windows are counted by their prints."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        windows = []
        for before, after in zip(batch.column("before").to_pylist(), batch.column("after").to_pylist(), strict=True):
            prints = Prints(before + after)
            b, a = len(before), len(after)
            reach = np.arange(max(0, need - a), min(need, b) + 1)
            hashed = _mixed(prints.of(b - reach, b + need - reach) + reach.astype(np.uint64)).view(np.int64) if len(reach) else []
            windows.append([{"reach": int(r), "print": int(h)} for r, h in zip(reach, hashed, strict=True)])
        kind = pa.list_(pa.struct([("reach", pa.int32()), ("print", pa.int64())]))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "n", "doc_id", "mark", "core", "core_end")), pa.array(windows, kind)], ["key", "n", "doc_id", "mark", "core", "core_end", "windows"])

    rows = map_rows(surroundings, run, "key long, n long, doc_id long, mark int, core int, core_end int, windows array<struct<reach int, print long>>")
    rows = rows.select("key", "n", "doc_id", "mark", "core", "core_end", F.inline("windows"))
    again = rows.groupBy("key", "reach", "print").agg(F.count("*").alias("times")).where("times > 1").drop("times")
    hit = rows.where("n = 1").join(again, ["key", "reach", "print"])
    return hit.select("doc_id", "mark", (F.col("core") - F.col("reach")).alias("start"), (F.col("core_end") + need - F.col("reach")).alias("stop"))


def packed(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``doc_id, mark, body``: whole texts, compressed so that shuffles stay small; ``carry``: columns to keep as ``rest``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pack = zstandard.ZstdCompressor(level=1).compress
        data = [_data(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([zlib.crc32(d) - 2**31 for d in data], pa.int32()), pa.array([pack(d) if d else b"" for d in data], pa.binary()), *batch.columns[2:]], ["doc_id", "mark", "body", *["rest"] * bool(carry)])

    if not carry:
        return map_rows(document_columns(docs), run, "doc_id long, mark int, body binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*carry).alias("rest"))
    return map_rows(rows, run, f"doc_id long, mark int, body binary, rest {rows.schema['rest'].dataType.simpleString()}")


def _unpack(body: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(body) if body else b""


def _on_document(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    r = right.withColumnsRenamed({"doc_id": "r_doc_id", "mark": "r_mark"})
    return left.join(r, left.doc_id.eqNullSafe(r.r_doc_id) & (left.mark == r.r_mark), how).drop("r_doc_id", "r_mark")


def repeated_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, most_in_group: int = MOST_IN_GROUP) -> DataFrame:
    """``doc_id, mark, start, stop``: byte spans that repeats cover, possibly overlapping.

    A stop of -1 stands for an anchor at ``start`` whose whole surroundings are covered.
    """
    half = (width - gram) // 2
    need = width - gram - half
    rows = anchor_rows(docs, width, gram)
    # Written, so that the join below deals both sides anew and Spark can split a gram that stands in very many places.
    grams = written(rows.groupBy(F.col("gram").alias("g")).agg(F.count("*").alias("n"), F.min("around").alias("lo"), F.max("around").alias("hi")).where("n > 1").select("g", (F.col("lo") == F.col("hi")).alias("settled")))
    again = written(rows.join(grams, F.col("gram") == F.col("g")).drop("g"))
    whole = again.where("settled").select("doc_id", "mark", F.col("at").alias("start"), F.lit(-1).alias("stop"))
    sides = again.where("not settled").select("doc_id", "mark", "at", "gram", "around", F.explode(F.array(F.struct(F.lit(True).alias("ahead"), F.col("to_right").alias("key")), F.struct(F.lit(False).alias("ahead"), F.col("to_left").alias("key")))).alias("s"))
    sides = sides.select("doc_id", "mark", "at", "gram", "around", "s.ahead", "s.key").where("key <> 0")
    members = written(sides.groupBy("key", "around", "gram").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "mark", "at", "ahead")).alias("one")))
    # Surroundings that occur again are covered wherever they stand, in whichever group they were seen.
    known = written(members.where("n > 1").select(F.col("around").alias("a"), F.col("gram").alias("g")).distinct())
    more = again.where("not settled").join(known, F.expr("around = a AND gram = g"), "left_semi").select("doc_id", "mark", F.col("at").alias("start"), F.lit(-1).alias("stop"))
    kinds = members.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1")
    asked = members.join(kinds, "key").select("key", "n", "kinds", "one.*")
    per_document = asked.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("key", "n", "kinds", "at", "ahead")).alias("asked"))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        asked = batch.column("asked")
        each = asked.flatten()
        counts = np.diff(asked.offsets.to_numpy())
        column = lambda name: each.field(each.type.get_field_index(name))
        core = column("at").to_numpy() - np.where(column("ahead").to_numpy(zero_copy_only=False), 0, half).astype(np.int32)
        before, after = [], []
        places = iter(core.tolist())
        for body, k in zip(batch.column("body").to_pylist(), counts.tolist(), strict=True):
            data = _unpack(body)
            for start in islice(places, k):
                end = start + gram + half
                before.append(data[max(0, start - need) : start])
                after.append(data[end : end + need])
        row = pa.array(np.repeat(np.arange(len(counts)), counts))
        arrays = [column("key"), column("n"), column("kinds"), batch.column("doc_id").take(row), batch.column("mark").take(row), pa.array(core, pa.int32()), pa.array(core + gram + half, pa.int32()), pa.array(before, pa.binary()), pa.array(after, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["key", "n", "kinds", "doc_id", "mark", "core", "core_end", "before", "after"])

    bodies = _on_document(per_document, packed(docs), "inner")
    surroundings = written(map_rows(bodies.select("doc_id", "mark", "asked", "body"), cut, "key long, n long, kinds long, doc_id long, mark int, core int, core_end int, before binary, after binary"))
    small = _resolve_groups(surroundings.where(F.col("kinds") <= most_in_group), need)
    found = whole.unionByName(more).unionByName(small)
    large = surroundings.where(F.col("kinds") > most_in_group)
    if large.take(1):
        found = found.unionByName(_resolve_by_windows(large, need))
    return found


def merged(spans: list[tuple[int, int]], n: int, width: int, gram: int) -> list[tuple[int, int]]:
    """Sorted, joined spans; spans that touch are one."""
    reach = width - gram
    plain = sorted((max(0, a - reach), min(n, a + gram + reach)) if b < 0 else (a, b) for a, b in spans)
    out: list[list[int]] = []
    for a, b in plain:
        if b - a < width:
            continue
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _with_spans(docs: DataFrame, width: int, gram: int, most_in_group: int, carry: list[str] | None = None) -> DataFrame:
    spans = repeated_spans(docs, width, gram, most_in_group).groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return _on_document(packed(docs, carry), spans, "left").select("doc_id", "body", F.col("spans.start").alias("span_start"), F.col("spans.stop").alias("span_stop"), *["rest"] * bool(carry))


def _rest(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in spans:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]])


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, most_in_group: int = MOST_IN_GROUP, carry: list[str] | None = None) -> DataFrame:
    """``doc_id, text, n_bytes, n_removed, n_spans, kept_sha256`` of every row, ``carry`` columns as ``rest``.

    ``text`` is what is left, decoded, without the bytes of a character that a cut broke; the digest
    is of the bytes themselves.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, total, removed, count, digest = [], [], [], [], []
        starts, stops = (batch.column(f"span_{x}").to_pylist() for x in ("start", "stop"))
        for body, start, stop in zip(batch.column("body").to_pylist(), starts, stops, strict=True):
            data = _unpack(body)
            spans = merged(list(zip(start, stop, strict=True)), len(data), width, gram) if start else []
            rest = _rest(data, spans)
            texts.append(rest.decode("utf-8", "ignore"))
            total.append(len(data))
            removed.append(len(data) - len(rest))
            count.append(len(spans))
            digest.append(hashlib.sha256(rest).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), *(pa.array(x, pa.int64()) for x in (total, removed, count)), pa.array(digest, pa.string()), *batch.columns[4:]], ["doc_id", "text", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["rest"] * bool(carry)])

    rows = _with_spans(docs, width, gram, most_in_group, carry)
    schema = "doc_id long, text string, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return map_rows(rows, run, schema + (f", rest {rows.schema['rest'].dataType.simpleString()}" if carry else ""))
