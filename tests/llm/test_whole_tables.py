"""Toxicity scores and the pipeline over whole tables, recomputed without the operators."""

import collections
import math
import re
import unicodedata
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from test_text_ops import _components, _heaviest
from tokenizers import Tokenizer

from siltstone.llm import preference_chat, quality_mcd, toxicity_fst
from siltstone.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def _tokens(text):
    return re.findall(r"[^\W\d_]+|[.!?;:\n]", unicodedata.normalize("NFC", text or "").lower())


def _held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def _toxicity(docs, labels):
    """``doc_id -> score`` from the words of training rows, clause kinds by looking around each match, and a Newton fit."""
    fst = toxicity_fst
    rows = [(docs[i] or "", y) for i, y in labels if y in (0, 1) and i in docs and not _held_out(i)]
    training = [(_tokens(t), y) for t, y in rows]
    fold_of = [zlib.crc32(t.encode()) % fst.FOLDS for t, _ in rows]

    def marked(part, least):
        seen = {y: collections.Counter(w for tokens, label in part if label == y for w in set(tokens)) for y in (0, 1)}
        base, found = sum(y for _, y in part) / len(part), {}
        for word, bad in seen[1].items():
            good, n = seen[0][word], bad + seen[0][word]
            share = bad / n
            ratio = 2 * (bad * math.log(share / base) + (good * math.log((1 - share) / (1 - base)) if good else 0))
            if bad >= good and share > base and ratio >= least and word.isalpha() and word not in fst.CLASS_OF:
                lower = (share + 2 / n - 2 * math.sqrt(share * (1 - share) / n + 1 / n**2)) / (1 + 4 / n)
                found[word] = ratio, fst.INSULT if lower >= fst.INSULT_SHARE else fst.LOADED
        return found

    wrong = dict.fromkeys(fst.RATIOS, 0)
    for k in range(fst.FOLDS):
        lexicon = marked([t for t, f in zip(training, fold_of, strict=True) if f != k], 0)
        for (tokens, y), f in zip(training, fold_of, strict=True):
            top = max((lexicon[w][0] for w in set(tokens) if w in lexicon), default=0)
            for bound in wrong:
                wrong[bound] += f == k and (top >= bound) != (y == 1)
    least = max(r for r in wrong if wrong[r] == min(wrong.values()))
    class_of = {w: c for w, (_, c) in marked(training, least).items()}
    class_of |= fst.CLASS_OF

    def features(tokens):
        counts, clause = collections.Counter(), []
        for t in [*tokens, "."]:
            if t in ".!?;:\n":
                counts[_heaviest(clause)] += 1
                clause = []
            else:
                clause.append(class_of.get(t, fst.OTHER))
        return [1.0, *(math.log2(1 + counts[k]) for k in fst.KIND_NAMES)]

    x, y = np.array([features(t) for t, _ in training]), np.array([label for _, label in training], float)
    pull = np.array([1e-3] + [1.0] * len(fst.KIND_NAMES))
    w = fst.PRIOR.copy()
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (y - p) - pull * (w - fst.PRIOR))
        w = w + step * min(1, 1 / np.abs(step).max())
        if np.abs(step).max() < 1e-10:
            break
    return {i: 1 / (1 + math.exp(-float(np.dot(features(_tokens(t)), w)))) for i, t in docs.items()}, class_of


def _labels(spark, sf_dir):
    return [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]


@pytest.mark.parametrize("sf_dir", [DATA, "/root/testdata/sf0.01"])
def test_op4_whole_table(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want, class_of = _toxicity(docs, _labels(spark, sf_dir))
    out = QUERIES["op4_toxicity_grammar"](spark, sf_dir).collect()
    assert len(out) == len(docs)
    for r in out:
        assert r.held_out == _held_out(r.doc_id) and abs(r.score - want[r.doc_id]) < 1e-5 and r.predicted == int(r.score >= 0.5)
    training = toxicity_fst.training_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert toxicity_fst.learned_words(training) | toxicity_fst.CLASS_OF == class_of


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_fixed_insults_can_go(spark, sf_dir):
    """Held-out decisions are the same without the fixed insults and threats: the labels show them."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    bare = {w: c for w, c in toxicity_fst.CLASS_OF.items() if c not in (toxicity_fst.INSULT, toxicity_fst.THREAT)}
    known = labels.where("toxic IN (0, 1)").select("doc_id", "toxic")
    counts = []
    for fixed in (toxicity_fst.CLASS_OF, bare):
        judged = toxicity_fst.score_documents(docs, labels, fixed).where("held_out").join(known, "doc_id")
        counts.append(sorted((r.toxic, r.predicted, r["count"]) for r in judged.groupBy("toxic", "predicted").count().collect()))
    assert counts[0] == counts[1]


def test_words_of_a_small_classifier(spark):
    """A classifier of few words holds those of the highest ratio."""
    rows = [(i, f"plain words here {'vilo' if i % 2 else 'neat'}{' grumo' if i % 4 == 1 else ''}", i % 2) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    training = toxicity_fst.training_rows(table, table.select("doc_id", "toxic"))
    assert set(toxicity_fst.learned_words(training, {})) == {"vilo", "grumo"}
    assert set(toxicity_fst.learned_words(training, {}, most_words=1)) == {"vilo"}
    assert set(toxicity_fst.learned_words(training, {"vilo": toxicity_fst.TARGET})) == {"grumo"}


def test_equal_texts_score_alike(spark):
    """Ties: repeated rows and texts that differ in white space and digits only have one score."""
    text = "You are a worthless idiot. He said you are trash!"
    docs = spark.createDataFrame([(1, text), (2, text), (1, text), (3, text.replace(" ", "  ") + " 12"), (4, ""), (5, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, toxic int")
    scores = collections.defaultdict(list)
    for r in toxicity_fst.score_documents(docs, labels).collect():
        scores[r.doc_id].append(r.score)
    assert len(scores[1]) == 2 and len({s for i in (1, 2, 3) for s in scores[i]}) == 1 and scores[4] == scores[5]


def test_pipeline_whole_table(spark):
    """run() against its stages recomputed: base rule, scores, components and repeats by brute force, ids by the library."""
    table = spark.read.parquet(f"{DATA}/documents.parquet").drop("n_chars")
    docs = {r.doc_id: r.text for r in table.collect()}
    # The estimates of the quality rules have no brute force of their own here (their determinant has, and their base rule).
    judged = {r.doc_id: r for r in quality_mcd.robust_outliers(table).collect()}
    for i, t in docs.items():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        assert judged[i].n_words == n and (n >= 20 or not judged[i].kept)
    docs = {i: t for i, t in docs.items() if judged[i].kept}
    scores, _ = _toxicity(docs, _labels(spark, DATA))
    docs = {i: t for i, t in docs.items() if scores[i] < 0.5}
    parts = _components(list(docs.items()))
    docs = {i: t for i, t in docs.items() if parts[i][1] == i}
    # What is left of each text, by the place of every 200-byte string.
    data = {i: (t or "").encode() for i, t in docs.items()}
    times = collections.Counter(b[p : p + 200] for b in data.values() for p in range(len(b) - 199))
    rest = {}
    for i, b in data.items():
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 199):
            if times[b[p : p + 200]] > 1:
                gone[p : p + 200] = True
        rest[i] = bytes(np.frombuffer(b, np.uint8)[~gone]).decode("utf-8", "ignore")
    assert any(len(rest[i]) < len(t or "") for i, t in docs.items())
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    out = corpus_pipeline.run(spark, DATA).collect()
    pieces = collections.defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(rest)
    for i, own in pieces.items():
        ids = [*library.encode(rest[i], add_special_tokens=False).ids, 2]
        own.sort(key=lambda r: r.piece)
        assert [r.start for r in own] == list(np.cumsum([0, *(r.length for r in own[:-1])])) and sum(r.length for r in own) == len(ids)
        assert all(r.length == 1024 for r in own[1:]) and all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in own)
    places = collections.defaultdict(list)
    for r in out:
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        spans.sort()
        assert [o for o, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1]] and sum(n for _, n in spans) <= 1024
    # No packing of so many tokens takes fewer sequences than their sum asks for; the method stays within a twentieth.
    assert len(places) <= 1.05 * math.ceil(sum(r.length for r in out) / 1024) + 1


def test_preference_pairs_of_a_long_conversation(spark):
    """Thousands of turns of which the last two differ."""
    n = 3000
    chosen = [(1, k, "user" if k % 2 == 0 else "assistant", f"turn {k}") for k in range(n)]
    rejected = [(i, k, role, text if k < n - 2 else f"other {k}") for i, k, role, text in chosen]
    schema = "pair_id long, turn int, role string, text string"
    out = preference_chat.preference_pairs(spark.createDataFrame(chosen, schema), spark.createDataFrame(rejected, schema)).collect()
    assert len(out) == 1
    whole = " ".join(str(v) for v in out[0].asDict().values())
    assert all(f"turn {k}" in whole for k in (0, 1500, n - 3, n - 1)) and f"other {n - 1}" in whole and f"other {n - 3}" not in whole
