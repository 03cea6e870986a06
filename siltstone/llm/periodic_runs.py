"""Periodic runs of words, found by minimizers at several scales.

A run is a stretch of words with smallest period ``q`` and length of at least ``max(LEAST, POWER * q)`` that no
neighbouring word extends keeping the period.  At the scale of periods ``P / 2 < q <= P`` every place has the hash of the next
``P`` words, and of every ``P / 2`` places in a row the one with the least hash (the leftmost, if several) is a
minimizer.  Inside a run of period q windows q apart hold the same hashes, so their minimizers are q apart and equal, and
since a hash spans a whole period no equal one lies between.  A run is longer than ``q + P + P / 2`` words, so it holds such a
pair.  Neighbouring equal minimizers at a distance of the scale are therefore seeds of all runs; each is extended both
ways by comparing words.  Periods up to ``SHORT`` have too few places for that and are found by comparing all words at that lag.

Hashes have 64 bits; a run could be missed if two different stretches of ``P`` words in one slice of texts had the same
one.  What is found is always right: extension compares the words' exact codes.

On Spark each task reads texts in slices of about ``SLICE_WORDS`` words and lays them end to end with a separate code
between, so that a scale is a few array operations for many texts; a scale only sees texts that are long enough for it.  A text
is in one task; the work for n words is O(n log n).  There is no shuffle.

Defined results: words are ``[^\\x20\\x09-\\x0D]+``; a null or word-less text has no runs and comes out empty; repeated rows are
judged each; extra columns are ignored unless named in ``carry``; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run's least length in words and in periods, and the longest period found by direct comparison.
LEAST, POWER, SHORT = 6, 4, 8
#: Words of texts that are handled together (a longer text is handled by itself).
SLICE_WORDS = 1 << 19

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers spread over all places."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def least_in_windows(x: np.ndarray, size: int) -> np.ndarray:
    """The least of every ``size`` (a power of two) numbers in a row."""
    step = 1
    while step < size:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return x


def minimizers(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places that are the leftmost least of some ``window`` places; hashes are compared by as many high bits as places leave room for."""
    if len(hashes) < window:
        return np.empty(0, np.int64)
    bits = np.uint64(len(hashes).bit_length())
    at = least_in_windows((hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64), window) & ((np.uint64(1) << bits) - np.uint64(1))
    return np.unique(at).astype(np.int64)


def agreement(codes: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The greatest range around ``at`` whose words equal those ``lag`` later."""
    low, high, size = at, at, 64
    while high + lag < len(codes):
        a, b = codes[high : high + size], codes[high + lag : high + lag + size]
        same = a[: len(b)] == b
        if not same.all():
            high += int(same.argmin())
            break
        high, size = high + len(b), size * 2
    size = 64
    while low > 0:
        start = max(0, low - size)
        same = codes[start:low] == codes[start + lag : low + lag]
        if not same.all():
            low -= int(same[::-1].argmin())
            break
        low, size = start, size * 2
    return low, high


def runs_of(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``start, length, period`` of all runs in texts that lie end to end.

    codes: the words' codes, each text followed by a code that occurs nowhere else.  sizes: words per text, without that code.
    """
    found: list[np.ndarray] = []
    for lag in range(1, SHORT + 1):
        same = np.zeros(max(0, len(codes) - lag) + 2, np.int8)
        same[1:-1] = codes[lag:] == codes[:-lag]
        edges = np.flatnonzero(np.diff(same))
        start, length = edges[::2], edges[1::2] - edges[::2] + lag
        ok = length >= max(LEAST, POWER * lag)
        found.append(np.stack([start[ok], length[ok], np.full(ok.sum(), lag)], 1))
    place, text = np.arange(len(codes)), np.repeat(np.arange(len(sizes)), sizes + 1)
    hashes, span = mixed(codes.astype(np.uint64) + np.uint64(1)), 1
    scale = SHORT
    while True:
        scale *= 2
        # A run of this scale has over POWER * scale / 2 words.
        long = sizes[text] > POWER * scale // 2
        if not long.any():
            break
        # Hashes shrink with their span: the last places would reach past the last text.
        long = long[: len(hashes)]
        place, text, hashes = place[: len(hashes)][long], text[: len(hashes)][long], hashes[long]
        while span < scale and len(hashes) > span:
            hashes = mixed(hashes[:-span] * np.uint64(0xD6E8FEB86659FD93) + (hashes[span:] ^ (hashes[span:] >> np.uint64(31))))
            span *= 2
        if span < scale:
            break
        at = minimizers(hashes, scale // 2)
        order = at[np.argsort(hashes[at], kind="stable")]
        lag = np.diff(order)
        seed = (hashes[order[1:]] == hashes[order[:-1]]) & (lag > scale // 2) & (lag <= scale)
        first, lag = place[order[:-1][seed]], lag[seed]
        by = np.lexsort((first, lag))
        rows, done = [], (0, -1)
        for i, q in zip(first[by].tolist(), lag[by].tolist(), strict=True):
            if q == done[0] and i < done[1]:
                continue
            low, high = agreement(codes, i, q)
            done = (q, high)
            if high > low and high - low + q >= max(LEAST, POWER * q):
                rows.append((low, high - low + q, q))
        if rows:
            found.append(np.array(rows))
        place, text = place[: len(hashes)], text[: len(hashes)]
    every = np.concatenate(found).astype(np.int64)
    # The same stretch at a multiple of its smallest period is no run of its own.
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    fresh = np.ones(len(every), bool)
    fresh[1:] = (every[1:, :2] != every[:-1, :2]).any(1)
    every = every[fresh]
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def _slices(texts: list[bytes | None]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Words of texts, some texts at a time, and the place of the first."""
    part: list[list[bytes]] = []
    count, first = 0, 0
    for i, text in enumerate(texts):
        # Bytes split at just the six characters.
        words = text.split() if text else []
        if part and count + len(words) > SLICE_WORDS:
            yield first, part
            part, count, first = [], 0, i
        part.append(words)
        count += len(words)
    if part:
        yield first, part


def periodic_runs(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``doc_id, n_words, runs, text`` and the columns ``carry`` of every document.

    runs: ``start, length, period`` by start and then period, counted in words.  text: the words that stay, joined by one space;
    a word goes if a run contains it after the run's first period.
    """
    others = carry or []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.struct(F.lit(0).alias("_"), *others).alias("rest"))
    rest_type = rows.schema["rest"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in _slices(batch.column("text").to_pylist()):
                sizes = np.array([len(w) for w in part], np.int64)
                flat = [w for words in part for w in words]
                word_codes = pa.array(flat, pa.binary()).dictionary_encode().indices.to_numpy() if flat else np.empty(0, np.int32)
                ends = np.cumsum(sizes)
                codes = np.insert(word_codes.astype(np.int64), ends, len(flat) + np.arange(len(part)))
                runs = runs_of(codes, sizes)
                starts = ends - sizes + np.arange(len(part))
                text = np.searchsorted(starts, runs[:, 0], "right") - 1
                # Texts without words share their start with none, but are not where a run begins.
                gone = np.zeros(len(codes) + 1, np.int64)
                np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
                np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
                gone = gone.cumsum() > 0
                counts = np.bincount(text, minlength=len(part))
                out_text = []
                for i, words in enumerate(part):
                    if counts[i]:
                        drop = gone[starts[i] : starts[i] + sizes[i]]
                        words = [w for w, d in zip(words, drop.tolist(), strict=True) if not d]
                    out_text.append(b" ".join(words))
                columns = [pa.array(runs[:, 0] - starts[text]), pa.array(runs[:, 1]), pa.array(runs[:, 2])]
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                listed = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([c.cast(pa.int64()) for c in columns], fields=list(RUN)))
                own = batch.slice(first, len(part))
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), pa.array(sizes), listed, pa.array(out_text, pa.binary()), own.column("rest")], ["doc_id", "n_words", "runs", "text", "rest"])

    out = rows.mapInArrow(run, f"doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, text binary, rest {rest_type}")
    return out.select("doc_id", "n_words", "runs", F.col("text").cast("string").alias("text"), *[F.col("rest")[c].alias(c) for c in others])


def run_digests(found: DataFrame) -> DataFrame:
    """Per document the number of runs, the longest one (ties: smallest start, then period) and digests of all runs and of the kept words."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    longest = F.aggregate("runs", F.col("runs")[0], lambda best, r: F.when(r["length"] > best["length"], r).otherwise(best))
    rows = found.withColumn("best", F.when(F.size("runs") > 0, longest))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col("best")[c].alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with a run in about one of ten documents, by a checksum of doc_id.

    With ``h`` the checksum, ``g = h div 10`` and ``n`` words, the words from ``a = g % n`` on repeat the first
    ``1 + (n - a) div (3 + g % 8)`` of them.  Documents with ``h % 10 > 0``, without words or without a doc_id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    # Split only where it is needed; the others' texts pass untouched.
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), h.alias("h")).withColumn("words", F.when(F.col("h") % 10 == 0, F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')")))
    sized = chosen.withColumns({"n": F.size("words"), "g": F.expr("h div 10")}).withColumns({"a": F.expr("CASE WHEN n > 0 THEN g % n END")}).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    made = F.expr("array_join(transform(sequence(0L, n - 1L), i -> words[int(CASE WHEN i < a THEN i ELSE a + (i - a) % p END)]), ' ')")
    return sized.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))
