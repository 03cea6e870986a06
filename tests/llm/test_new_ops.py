"""Hard negatives, periodic runs and exact top-k search against brute force."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import hard_negatives, mips_buckets, periodic_runs
from siltstone.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_segment_hard_negatives", "op13_top_products"])
def test_vector_queries_match_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    got = QUERIES[name](spark, DATA)
    want = con.execute(ORACLE_SQL[name])
    assert [d[0] for d in want.description] == got.columns
    rows = sorted(tuple(r) for r in got.collect())
    assert rows and rows == sorted(want.fetchall())


def _table(spark, vectors, labels=None, odd=()):
    rows = [(i, [float(x) for x in v], None if labels is None else int(labels[i])) for i, v in enumerate(vectors)]
    # Extra columns carry names that the operators use themselves.
    return spark.createDataFrame([(*r, 0, 1.5, "c") for r in [*rows, *odd]], "vec_id long, embedding array<double>, label int, block int, score double, q string")


def _odd(size):
    return [(50_000, None, 1), (50_050, [float("nan")] * size, 1), (50_100, [None] * size, 1), (50_150, [float("inf")] * size, 1), (50_200, [1.0, 2.0], 1), (50_250, [], 1), (None, [1.0] * size, 1), (50_300, [1e300] * size, 1)]


def _top(v, ids, every, k):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        score = v @ v[i]
        order = [j for j in sorted(range(len(ids)), key=lambda j: (-score[j], ids[j])) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), int(score[j])) for j in order]
    return out


def _same(out, want):
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return got == {q: w for q, w in want.items() if w}


@pytest.mark.parametrize("kind", ["unit", "heavy lengths", "few directions", "one vector"])
def test_top_products(spark, kind):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((1200, 12))
    v /= np.linalg.norm(v, axis=1)[:, None]
    if kind == "heavy lengths":
        v *= (rng.pareto(1.2, 1200) + 0.05)[:, None]
    if kind == "few directions":
        v = np.eye(12)[rng.integers(0, 12, 1200)] * 4 + 0.05 * v
    if kind == "one vector":
        # A third of all rows are one vector, and some are zero.
        v[:400], v[400:420] = v[900], 0.0
    table = _table(spark, v, odd=_odd(12))
    whole = np.floor(256 * v).astype(np.int64)
    out = mips_buckets.top_products(table, F.col("vec_id") % 50 == 0, block_rows=100, lot_rows=8).collect()
    assert _same(out, _top(whole, np.arange(1200), 50, 5))
    work = sum({r.query_id: r.verified for r in out}.values())
    if kind in ("heavy lengths", "few directions"):
        # Length or coordinates prune where there is something to prune by.
        assert work < 0.5 * 24 * 1200


def test_top_products_of_odd_tables(spark):
    big = [[2.0**20 * (i + 1), -(2.0**21), 1.0 + i] for i in range(6)]
    whole = np.array([[int(x * 256) for x in r] for r in big], dtype=object)
    out = mips_buckets.top_products(_table(spark, big), F.col("vec_id") % 2 == 0, k=3).collect()
    assert _same(out, _top(whole, np.arange(6), 2, 3))
    table = _table(spark, [[1.0], [2.0], [-1.0]])
    assert mips_buckets.top_products(table.limit(0), F.lit(True)).count() == 0
    assert mips_buckets.top_products(table, F.lit(False)).count() == 0
    assert mips_buckets.top_products(table.where("vec_id = 0"), F.lit(True)).count() == 0
    # Rows that share an id count once, with the larger vector; with few candidates all are returned.
    rows = mips_buckets.top_products(table.union(_table(spark, [[9.0]])), F.col("vec_id") == 1).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(rows, key=lambda r: r.rank)] == [(1, 0, 9 * 2 * 65536), (2, 2, -2 * 65536)]


def _hard(v, ids, labels, every):
    out = set()
    for i in np.flatnonzero(ids % every == 0):
        score = v @ v[i]
        order = sorted(range(len(ids)), key=lambda j: (-score[j], ids[j]))
        for p in [j for j in order if labels[j] == labels[i] and j != i][:5]:
            inside = [j for j in order if labels[j] != labels[i] and 30 * score[p] <= 100 * score[j] <= 90 * score[p]][:10]
            out |= {(int(ids[i]), int(ids[p]), rank + 1, int(ids[j]), int(score[p]), int(score[j])) for rank, j in enumerate(inside)}
    return out


@pytest.mark.parametrize("kind", ["noise", "smooth", "one label"])
def test_hard_negatives(spark, kind):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((900, 16))
    labels = rng.integers(0, 6, 900)
    if kind == "smooth":
        v = np.repeat(rng.standard_normal((900, 4)), 4, axis=1) + 0.02 * v
    if kind == "one label":
        # Most rows share a label, a third a vector.
        labels[:700], v[:300] = 2, v[500]
    odd = [*_odd(16), (51_000, [1.0] * 16, None)]
    whole = np.floor(256 * v).astype(np.int64)
    out = hard_negatives.hard_negatives(_table(spark, v, labels, odd), F.col("vec_id") % 45 == 0, block_rows=100, lot_rows=7).collect()
    assert {tuple(r)[:6] for r in out} == _hard(whole, np.arange(900), labels, 45) and len(out) == len({tuple(r)[:6] for r in out})
    if kind == "smooth":
        assert np.mean(list({r.anchor_id: r.scored for r in out}.values())) < 0.35 * 900


def test_hard_negatives_of_odd_tables(spark):
    table = _table(spark, [[1.0, 0.0], [1.0, 0.1], [0.5, 0.5], [-1.0, 0.0]], [1, 1, 2, 2])
    out = {tuple(r)[:6] for r in hard_negatives.hard_negatives(table, F.lit(True)).collect()}
    assert out == _hard(np.floor(256 * np.array([[1.0, 0.0], [1.0, 0.1], [0.5, 0.5], [-1.0, 0.0]])).astype(int), np.arange(4), np.array([1, 1, 2, 2]), 1)
    assert hard_negatives.hard_negatives(table.limit(0), F.lit(True)).count() == 0
    assert hard_negatives.hard_negatives(table, F.lit(False)).count() == 0
    # No positives, no rows; a null label takes no part.
    assert hard_negatives.hard_negatives(table.where("vec_id <> 0"), F.col("vec_id") == 1).count() == 0
    assert hard_negatives.hard_negatives(table.withColumn("label", F.lit(None).cast("int")), F.lit(True)).count() == 0


def test_summaries_bound_products():
    rng = np.random.default_rng(8)
    for size in (1, 2, 3, 7, 16, 50, 64):
        a, b = (rng.integers(-300, 300, (40, size)) for _ in range(2))
        exact = a @ b.T
        widths = []
        for (am, ad), (bm, bd) in zip(hard_negatives.levels(hard_negatives.summaries(a), size), hard_negatives.levels(hard_negatives.summaries(b), size), strict=True):
            middle, reach = am @ bm.T, ad @ bd.T
            assert (np.abs(exact - middle) <= reach + 1e-6).all()
            widths.append(reach.mean())
        # Finer segments bound more closely.
        assert widths == sorted(widths, reverse=True)


def _brute_runs(words):
    code = {w: i for i, w in enumerate(dict.fromkeys(words))}
    a = np.array([code[w] for w in words])
    best = {}
    for q in range(1, len(words) // 4 + 1):
        same = np.concatenate([[0], (a[q:] == a[:-q]).astype(int), [0]])
        edges = np.flatnonzero(np.diff(same))
        for s, t in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if t - s + q >= max(6, 4 * q):
                best.setdefault((s, t - s + q), q)
    runs = sorted((s, q, n) for (s, n), q in best.items())
    drop = {i for s, q, n in runs for i in range(s + q, s + n)}
    return [(s, n, q) for s, q, n in runs], " ".join(w for i, w in enumerate(words) if i not in drop)


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def _texts():
    rng = np.random.default_rng(2)
    texts = []
    for _ in range(150):
        words, n = [], int(rng.integers(1, 500))
        while len(words) < n:
            if rng.random() < 0.5:
                q = int(rng.integers(1, 45))
                words += (rng.integers(0, rng.integers(1, 4) + 1, q).tolist() * 12)[: int(rng.integers(q, 8 * q + 8))]
            else:
                words += rng.integers(0, 50, 5).tolist()
        texts.append(" ".join(map(str, words[:n])))
    # A long text with long periods, one run of one word, words apart by odd white space and Unicode spaces that separate nothing.
    block = [str(x) for x in rng.integers(0, 9, 2500)]
    texts += [" ".join([*block[:700], *block * 5, "end"]), "w " * 9000, "a\tb c\x0bd e\n\na\tb c\x0bd e " * 7, "", " \t\n", None, "x"]
    return texts


def test_periodic_runs(spark):
    texts = _texts()
    table = spark.createDataFrame([(i, t, "k", i) for i, t in enumerate(texts)] + [(None, texts[0], "k", 7), (3, texts[3], "k", 8)], "doc_id long, text string, runs string, rest long")
    out = periodic_runs.periodic_runs(table, carry=["rest"]).collect()
    assert len(out) == len(texts) + 2
    for r in out:
        words = _words(texts[r.doc_id if r.doc_id is not None else 0])
        runs, kept = _brute_runs(words)
        assert (r.n_words, [tuple(x) for x in r.runs], r.text) == (len(words), runs, kept)
        assert r.rest == {None: 7}.get(r.doc_id, r.doc_id) or (r.doc_id == 3 and r.rest == 8)
    assert periodic_runs.periodic_runs(table.limit(0)).count() == 0


def test_no_run_crosses_texts(spark):
    table = spark.createDataFrame([(i, "a b a b a b") for i in range(50)], "doc_id long, text string")
    assert periodic_runs.periodic_runs(table).where("size(runs) > 0").count() == 0


def test_op12_whole_table(spark):
    out = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    assert len(out) == len(docs)
    for d in docs:
        words, h = _words(d.text), zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and words:
            a = h // 10 % len(words)
            p = 1 + (len(words) - a) // (3 + h // 10 % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs, kept = _brute_runs(words)
        r = out[d.doc_id]
        longest = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert r.n_runs == len(runs) and r.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*longest, 1000 * longest[1] // longest[2]) if longest else (None,) * 4)
    assert sum(r.n_runs > 0 for r in out.values()) > 5
