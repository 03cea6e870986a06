"""The text operators against brute force, on small tables with odd rows."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siltstone.llm import bpe_dp, minhash_dedup, packing, quality_mcd, suffix_dedup, token_binary, toxicity_fst, wordpiece_count
from siltstone.llm.queries import op2_wordpiece_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, body string, label long"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def _corpus():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abdeginorstéß") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 250))) for _ in range(60)]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    texts += [f"{t} {passage} {rng.choice(vocab)}" for t in texts[:8]]
    for t in texts[:6]:
        words = t.split()
        if len(words) > 50:
            words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    texts += [texts[0], texts[0], None, "", "  \n\t ", "x", "a b c", "<|endoftext|> don't 日本 ½ \x01 İ", "ab " * 400, "é" * 700, " ".join(rng.choice(vocab) for _ in range(9000))]
    rows = [(i, t, rng.choice(["en", "de", None]), "s", 1, "w", "b", 0) for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, texts[5], "en", "s", 1, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return _corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _got(df, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_quality(docs, rows, none):
    want = collections.Counter()
    for i, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        times, hit = collections.Counter(windows), set()
        for k, w in enumerate(windows):
            if times[w] > 1:
                hit.update(range(k, k + 8))
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want[(i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), len(words) < 20 or 100 * len(hit) > 30 * len(words))] += 1
    out = quality_mcd.robust_outliers(docs)
    assert _got(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert not out.where("base_failed and kept").count()
    assert quality_mcd.kept_documents(docs).columns == docs.columns
    assert quality_mcd.robust_outliers(none).count() == 0


def test_determinant_is_the_least_of_all_cores(spark):
    """Ten documents, two of them odd, as many as a core of eight can leave out: the steps end at the core of eight whose regularised determinant is least."""
    rng = np.random.default_rng(12)
    vocab = ["".join(rng.choice(list("aeinorst"), rng.integers(2, 9))) for _ in range(300)]
    texts = [" ".join(rng.choice(vocab, n)) for n in (60, 75, 66, 82, 71, 64, 78, 69)] + [" ".join("ab" for _ in range(24)) + f" $$ {i}" + " # * # $ %" * 3 for i in range(2)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    stats = quality_mcd._vector(quality_mcd.text_statistics(docs)).withColumn("base_failed", F.lit(False)).cache()
    own = stats.orderBy("doc_id").toPandas()
    x, n, k, core = own[quality_mcd.NAMES].to_numpy(float), 10, 5.0, 0.8
    est = quality_mcd.Estimates(stats, core, k).est.first()
    q = lambda v, share: np.sort(v)[max(0, int(np.ceil(share * len(v))) - 1)]
    centre = np.array([q(c, 0.5) for c in x.T])
    spread = np.array([((q(c, 0.75) - q(c, 0.25)) / 1.349) ** 2 for c in x.T])
    units = np.stack([own.n_words, own.n_words, own.n_words, own.n_lines, own.n_words / 8], 1)
    noise = (1 / (4 * np.maximum(units, 1))).mean(0)
    lean = lambda v, onto: (n * v + k * onto) / (n + k)
    target = lean(spread, lean(spread, np.array(list(quality_mcd.FEATURES.values())) ** 2))
    best = {}
    for held in itertools.combinations(range(n), 8):
        part = x[list(held)]
        h, off = 8, part.mean(0) - centre
        scatter = (h * np.cov(part.T, bias=True) + k * np.diag(target) + h * k / (h + k) * np.outer(off, off)) / (h + k) + np.diag(noise)
        best[held] = np.linalg.slogdet(scatter)[1]
    assert abs(est.log_det - min(best.values())) < 1e-9


def test_quality_groups_stand_alone(spark):
    """A document is judged by its own language and source: what is usual in one is odd in the other."""
    rng = np.random.default_rng(5)
    text = lambda words, n: " ".join(words[i] for i in rng.integers(0, len(words), n))
    short, long_ = ["".join(rng.choice(list("aeinorst"), 3)) for _ in range(300)], ["".join(rng.choice(list("aeinorst"), 11)) for _ in range(300)]
    rows = [(i, text(short, 120), "en", "a") for i in range(400)] + [(400 + i, text(long_, 120), "de", "b") for i in range(400)]
    rows += [(900, text(long_, 120), "en", "a"), (901, text(short, 120), "de", "b"), (902, text(short, 120), None, None)]
    out = {r.doc_id: r.kept for r in quality_mcd.robust_outliers(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not out[900] and not out[901] and out[902]
    assert all(kept for i, kept in out.items() if i < 900)


def test_quality_rejects_outliers(spark):
    rng = np.random.default_rng(1)
    vocab = ["".join(rng.choice(list("aeinorst"), rng.integers(2, 9))) for _ in range(500)]
    texts = [" ".join(rng.choice(vocab, rng.integers(40, 200))) for _ in range(300)]
    texts += [" ".join(f"q{k}$$$%%%###{j}" for j in range(60)) for k in range(10)]
    out = quality_mcd.robust_outliers(spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string"))
    kept = {r.doc_id: r.kept for r in out.collect()}
    assert all(kept[i] for i in range(300)) and not any(kept[i] for i in range(300, 310))


def test_wordpiece(docs, rows, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = set(wordpiece_count.load_pieces(path))

    def greedy(word):
        word, n = "▁" + word, 0
        while word:
            size = next((k for k in range(len(word), 0, -1) if word[:k] in pieces), 0)
            if not size:
                return 0
            word, n = word[size:], n + 1
        return n

    want = collections.Counter()
    for i, text, *_ in rows:
        each = [greedy(w) if len(w) <= 200 else 0 for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        want[(i, len(each), sum(n or 1 for n in each), each.count(0))] += 1
    assert _got(wordpiece_count.count_tokens(docs, path, max_chars=200), "doc_id", "n_words", "n_tokens", "n_unknown") == want
    assert wordpiece_count.count_tokens(none, path).count() == 0


def test_bpe(docs, rows, none):
    library = Tokenizer.from_file(BYTE)
    want = collections.Counter()
    for i, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())] += 1
    assert _got(bpe_dp.round_trip_digests(docs, BYTE), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    encoded = bpe_dp.encode_documents(docs, BYTE)
    assert _got(bpe_dp.decode_documents(encoded, BYTE), "doc_id", "text") == collections.Counter((i, t or "") for i, t, *_ in rows)
    assert bpe_dp.round_trip_digests(none, BYTE).count() == 0


def test_token_binary(docs, rows, none):
    library = Tokenizer.from_file(WORD)
    out = token_binary.written_and_read(docs, WORD).collect()
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t, *_ in rows}
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == collections.Counter((i, len(ids[i]), zlib.crc32(ids[i].tobytes())) for i, *_ in rows)
    at = 0
    for r in sorted(out, key=lambda r: (r.start, r.n_tokens)):
        assert r.start == at
        at += r.n_tokens
    ordered = [r.doc_id for r in sorted(out, key=lambda r: r.start) if r.doc_id is not None]
    assert ordered == sorted(ordered)
    assert token_binary.written_and_read(none, WORD).count() == 0


def test_rank_coding():
    ranks = np.array([0, 255, 256, 65535, 65536, 2**24, 2**32 - 1, 7, 9], np.uint32)
    control, data = token_binary.pack_ranks(ranks)
    assert (token_binary.unpack_ranks(control, data, len(ranks)) == ranks).all()


def test_packing(docs, rows, none):
    library = Tokenizer.from_file(BYTE)
    out = packing.pack_documents(docs, BYTE).collect()
    pieces = collections.Counter()
    for i, text, *_ in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        edges = [0, *range(first, len(ids) + 1, 1024)]
        for k in range(len(edges) - 1):
            part = np.array(ids[edges[k] : edges[k + 1]], "<u4")
            pieces[(i, k, edges[k], len(part), zlib.crc32(part.tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == pieces
    bins = collections.defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= -(-sum(r.length for r in out) // 1024) * 1.2 + 1
    assert packing.pack_documents(none, BYTE).count() == 0


def test_reduction_is_no_worse_than_best_fit():
    rng = random.Random(3)
    for _ in range(200):
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(1, 40))]
        plan = packing.plan_bins(collections.Counter(sizes), 20)
        assert sorted(s for lengths, n in plan for s in lengths * n) == sorted(sizes)
        assert all(sum(lengths) <= 20 for lengths, _ in plan)
        assert sum(n for _, n in plan) <= -(-sum(sizes) // 20) * 1.3 + 1


def _fewest(sizes, capacity):
    """The least number of bins, over all subsets."""
    n = len(sizes)
    best = [(0, 0)] + [(n + 1, 0)] * (2**n - 1)  # (bins, fill of the last one)
    for held in range(2**n):
        bins, fill = best[held]
        for i in range(n):
            if not held >> i & 1:
                grown = (bins, fill + sizes[i]) if bins and fill + sizes[i] <= capacity else (bins + 1, sizes[i])
                best[held | 1 << i] = min(best[held | 1 << i], grown)
    return best[-1][0]


def test_reduction_fixes_only_what_an_optimal_packing_holds():
    rng = random.Random(9)
    total = alone = 0
    for _ in range(120):
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        left = np.bincount(sizes, minlength=21)
        alone += sum(n for _, n in packing.best_fit(left.copy(), 20))
        fixed = packing.reduce_instance(left, 20)
        rest = [s for s in range(21) for _ in range(left[s])]
        least = _fewest(sizes, 20)
        assert sum(n for _, n in fixed) + _fewest(rest, 20) == least
        planned = sum(n for _, n in packing.plan_bins(collections.Counter(sizes), 20))
        assert planned <= least + 1
        total += planned
    assert total <= alone


def _components(rows, width=4):
    sets = {}
    for i, text, *_ in rows:
        words = (text or "").encode().lower().split()
        sets[i] = frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))) if words else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [i for i in sets if i is not None]
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i) if i is not None else None) for i in sets}


def test_near_duplicates(docs, rows, none):
    want = _components(rows)
    out = minhash_dedup.near_duplicates(docs).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out) == collections.Counter((i, *want[i], i is None or want[i][1] == i) for i, *_ in rows)
    kept = [r.doc_id for r in minhash_dedup.kept_documents(docs).collect()]
    assert sorted(x for x in kept if x is not None) == sorted({c for _, c in want.values() if c is not None})
    assert minhash_dedup.near_duplicates(none).count() == 0


def _removed(rows, width):
    data = [(i, (t or "").encode()) for i, t, *_ in rows]
    times = collections.Counter(b[p : p + width] for _, b in data for p in range(len(b) - width + 1))
    want = collections.Counter()
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - width + 1):
            if times[b[p : p + width]] > 1:
                gone[p : p + width] = True
        rest = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[(i, len(b), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest())] += 1
    return want


@pytest.mark.parametrize("most", [20_000, 1])
def test_repeat_removal(docs, rows, none, most):
    out = suffix_dedup.remove_repeats(docs, most_in_group=most)
    assert _got(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == _removed(rows, 200)
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_toxicity(spark, docs, none):
    assert [k for k, _ in toxicity_fst.clauses("You are an idiot. He is not stupid! She said they called him a moron.\nI will kill you")] == ["insult_at_target", "negated", "reported", "threat_at_target"]
    rng = random.Random(2)
    plain = [" ".join(rng.choice(["the", "of", "house", "tree", "walk", "not"]) for _ in range(30)) for _ in range(400)]
    rows = [(i, t + (" you pathetic idiot. worthless trash" if i % 4 == 0 else "")) for i, t in enumerate(plain)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    out = toxicity_fst.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in out if r.held_out)
    assert toxicity_fst.score_documents(docs, labels.limit(0)).where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity_fst.score_documents(none, labels).count() == 0


def test_toxicity_learns_words(spark):
    rng = random.Random(6)
    plain = [" ".join(rng.choice(["das", "haus", "le", "chat", "la", "casa"]) for _ in range(30)) for _ in range(400)]
    rows = [(i, t + (". das garstnix flegelo." if i % 4 == 0 else "")) for i, t in enumerate(plain)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert set(toxicity_fst.learned_words(toxicity_fst.training_rows(table, labels))) == {"garstnix", "flegelo"}
    out = toxicity_fst.score_documents(table, labels).collect()
    assert sum(r.held_out for r in out) > 40
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in out)
    assert sorted(r.doc_id for r in toxicity_fst.kept_documents(table, labels).collect()) == [i for i in range(400) if i % 4]
    for one in (0, 1):
        assert toxicity_fst.learned_words(toxicity_fst.training_rows(table, labels.where(f"toxic = {one}"))) == {}


def test_wordpiece_spells_long_words(spark, tmp_path):
    pieces = set(wordpiece_count.load_pieces(public_tokenizers.path("piece_bpe_32k.model")))
    longest = max(map(len, pieces))

    def greedy(word):
        word, at, n = "▁" + word, 0, 0
        while at < len(word):
            size = next((k for k in range(longest, 0, -1) if word[at : at + k] in pieces and at + k <= len(word)), 0)
            if not size:
                return 0
            at, n = at + size, n + 1
        return n

    rng = random.Random(8)
    words = ["".join(rng.choice("abdeginorst") for _ in range(n)) for n in (200, 201, 5000, 30_000)]
    spark.createDataFrame([(i, f"{w} {w}") for i, w in enumerate(words)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = op2_wordpiece_counts(spark, str(tmp_path))
    assert all(greedy(w) > 1 for w in words)
    assert _got(out, "doc_id", "n_words", "n_tokens", "n_unknown") == collections.Counter((i, 2, 2 * greedy(w), 0) for i, w in enumerate(words))


def _heaviest(clause):
    """The kind of a clause by looking at each match and what stands around it."""
    fst = toxicity_fst
    within = lambda i, what, back, ahead: any(clause[j] == what for j in range(max(0, i - back), min(len(clause), i + ahead + 1)) if j != i)
    kinds = set()
    for i, x in enumerate(clause):
        if x not in (fst.INSULT, fst.THREAT, fst.LOADED):
            continue
        if within(i, fst.NEGATION, 3, 0):
            kinds.add("negated")
        elif within(i, fst.REPORT, 6, 0):
            kinds.add("reported")
        elif x == fst.LOADED:
            kinds.add("loaded")
        else:
            kinds.add({fst.INSULT: "insult", fst.THREAT: "threat"}[x] + ("_at_target" if within(i, fst.TARGET, 6, 6) else ""))
    return next((k for k in fst.KIND_NAMES if k in kinds), None)


def test_grammar_accepts_what_brute_force_does():
    kind = toxicity_fst.Grammar().kind
    for n in range(6):
        for clause in itertools.product(range(7), repeat=n):
            assert kind(clause) == _heaviest(clause), clause
    rng = random.Random(4)
    for _ in range(20_000):
        clause = rng.choices(range(7), weights=[12, 2, 2, 1, 1, 1, 1], k=rng.randrange(6, 30))
        assert kind(clause) == _heaviest(clause), clause


def test_clauses_of_long_and_repeated_texts(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    once, often = "you are an idiot.", "you are an idiot. " * 3000
    rows = [(1, once), (1, once), (2, often), (3, "the house stands. " * 20_000), (4, None), (5, ""), (None, once)]
    out = [(r.doc_id, round(r.score, 9), r.predicted) for r in toxicity_fst.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()]
    score = {i: s for i, s, _ in out}
    assert len(out) == 7 and out.count((1, score[1], 1)) == 2 and score[None] == score[1] < score[2] <= 1
    assert score[3] == score[4] == score[5] < 0.5


def test_composed_letters_are_one_word():
    assert [k for k, _ in toxicity_fst.clauses("du bist erba\u0308rmlich")] == ["insult_at_target"]


def test_near_duplicates_tie_texts_of_one_document(spark):
    a = " ".join(f"a{i}" for i in range(80))
    b = " ".join(f"b{i}" for i in range(80))
    rows = [(1, a), (1, b), (2, f"{a} end"), (3, f"{b} end"), (4, "else where it is"), (-5, f"start {b}")]
    out = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in out.collect()} == {1: -5, 2: -5, 3: -5, 4: 4, -5: -5}
    kept = minhash_dedup.kept_documents(spark.createDataFrame([*rows, (4, "another text of four"), (None, a)], "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(-5, f"start {b}"), (4, "another text of four"), (None, a)], key=str)


@pytest.mark.parametrize("block", [4, 512])
def test_loose_copies_are_compared_in_blocks(spark, monkeypatch, block):
    """Copies of one text with up to half of their words changed: components as brute force has them, from few comparisons."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    texts = []
    for i in range(80):
        words = list(base)
        for _ in range(i % 20):
            words[rng.randrange(150)] = f"x{rng.randrange(10_000)}"
        texts.append(" ".join(words))
    sets = [minhash_dedup.shingle_set(t.encode().split(), 4) for t in texts]
    near = [[100 * (both := len(np.intersect1d(a, b))) >= 80 * (len(a) + len(b) - both) for b in sets] for a in sets]
    label = list(range(80))
    while any(near[i][j] and label[j] < label[i] for i in range(80) for j in range(80)):
        label = [min(label[j] for j in range(80) if near[i][j]) for i in range(80)]
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    out = minhash_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in out.collect()} == dict(enumerate(label))


def test_sketches_never_part_a_link():
    rng = np.random.default_rng(2)
    for n in (3, 60, 64, 65, 130, 700):
        own = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        for changed in range(0, n // 4 + 1, max(1, n // 30)):
            other = np.unique(np.concatenate([own[changed:], rng.integers(0, 2**63, changed).astype(np.uint64)]))
            both = len(np.intersect1d(own, other))
            link = 100 * both >= 80 * (len(own) + len(other) - both)
            found = minhash_dedup._near_pairs([minhash_dedup.parity_sketch(x) for x in (own, other)], np.array([len(own), len(other)]), lambda i, j: j != i, 80)
            assert found or not link
