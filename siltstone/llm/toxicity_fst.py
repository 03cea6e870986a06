"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols (insult, threat, loaded word, target, negation, reported speech), and four
transducers rewrite them, each in its own concern: one marks what a negation governs, one what
is reported speech, one whom an insult or a threat is aimed at - before or after it, so it may
guess a target that must follow - and one chooses which match the clause counts for.  They are
composed into one weighted transducer, whose best path through a clause gives its kind.  A
document's score is the logistic sum over its clause kinds, with weights learned from labelled
training rows around prior weights, so that isolated words never count twice.

The words of the grammar are the fixed ones below and, whatever the language, those that stand
in toxic training rows far more often than chance allows: ``word_counts`` counts every word of
every training row by label.  How much more often is decided on folds of the training rows:
``least_ratio`` takes the bound whose words, learned on the other folds, tell toxic rows best.
The fixed words are a parameter; held-out decisions on the shipped tables are the same without
its insults and threats.

Defined results: null and empty texts have no clauses and get the base score; rows without a
doc_id are scored but never train; labels that are null, or not 0 or 1, are ignored; without any
usable label the prior weights and the fixed words stand; repeated rows are scored one by one.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from siltstone.llm.common import document_columns, map_rows, written

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, LOADED = range(7)

#: The grammar's vocabulary in the four languages of the corpus.
LEXICON = {
    INSULT: "idiot idiots moron morons stupid loser losers trash scum worthless pathetic disgusting clown clowns dumb imbecile filth filthy vermin retard jerk bastard bitch asshole pig scumbag freak cretin "
    "idiotin dumm dummkopf abschaum arschloch versager drecksack trottel schwein widerlich wertlos erbärmlich "
    "imbécile crétin connard salaud ordure débile abruti pathétique dégoûtant minable "
    "idiota imbécil estúpido estúpida basura escoria patético asqueroso inútil cretino payaso",
    THREAT: "kill hurt destroy beat smash burn shoot stab murder strangle töten umbringen verprügeln erschießen tuer frapper égorger détruire matar golpear destruir quemar",
    TARGET: "you your yours yourself ur u du dich dir euch ihr tu toi vous vos tú vosotros usted ustedes they them he she him her these those people",
    NEGATION: "not no never neither nor isnt arent dont wont cannot nicht kein keine nie ne pas jamais aucun nunca ningún tampoco",
    REPORT: "said says called calls claimed quoted wrote alleged allegedly reportedly sagte nannte schrieb dit appelé dijo llamó escribió",
}
CLASS_OF = {unicodedata.normalize("NFC", w): c for c, words in LEXICON.items() for w in words.split()}

#: Words for which a context stays in force after it was read.
REACH = {TARGET: 6, NEGATION: 3, REPORT: 6}

#: Clause kinds, heaviest first, with the prior weight of each.
KINDS = {"threat_at_target": 3.5, "insult_at_target": 4.0, "insult": 3.5, "threat": 0.5, "loaded": 2.5, "reported": 0.3, "negated": 0.3}
KIND_NAMES = list(KINDS)
PRIOR = np.array([-2.5, *KINDS.values()])
#: Symbols that make a clause worth matching.
MARKED = {INSULT, THREAT, LOADED}

#: Bounds to choose from of a learned word's log-likelihood ratio against the share of toxic rows: chi-square of one
#: degree that a word exceeds by chance once in 1,000, 10,000, 100,000 and 1,000,000 times.
RATIOS = (10.8, 15.1, 19.5, 23.9)
#: The lower bound of its toxic share from which a learned word is an insult, not just loaded.
INSULT_SHARE = 0.9
#: Parts of the training rows, by their texts, on which the bound is chosen.
FOLDS = 4

COUNTS = StructType([StructField(f"k_{k}", IntegerType()) for k in KIND_NAMES])

_TOKENS = re.compile(r"[^\W\d_]+|[.!?;:\n]").findall


@dataclass(frozen=True)
class Transducer:
    """A weighted finite-state transducer that writes one symbol for each it reads.

    ``arcs[state][symbol]`` lists (written symbol, next state, weight); a path's weight is the sum of
    its arcs', and of the paths that end in a final state the heaviest counts.
    """

    start: object
    arcs: dict
    final: frozenset

    def then(self, other: Transducer) -> Transducer:
        """The composition: ``other`` reads what this one writes.  Only reachable states are built."""
        start = (self.start, other.start)
        arcs: dict = {}
        todo = [start]
        while todo:
            state = todo.pop()
            if state in arcs:
                continue
            own = arcs[state] = {}
            for symbol, outs in self.arcs[state[0]].items():
                own[symbol] = [(y, (p, q), v + w) for x, p, v in outs for y, q, w in other.arcs[state[1]].get(x, ())]
                todo += [q for _, q, _ in own[symbol]]
        return Transducer(start, arcs, frozenset(s for s in arcs if s[0] in self.final and s[1] in other.final))


MATCHES = (INSULT, THREAT, LOADED)
#: What the transducers write in place of a match.
NEGATED, REPORTED, INSULT_AT, THREAT_AT = "negated", "reported", "insult_at_target", "threat_at_target"


def governed(by: int, reach: int, written: str, alphabet: list) -> Transducer:
    """Writes ``written`` for the matches among the ``reach`` words after a ``by``; states count the words left."""
    arcs = {}
    for left in range(reach + 1):
        after = max(0, left - 1)
        arcs[left] = {x: [(x, after, 0)] for x in alphabet}
        arcs[left] |= {x: [(written, after, 0)] for x in MATCHES if left}
        arcs[left][by] = [(by, reach, 0)]
    return Transducer(0, arcs, frozenset(arcs))


def aimed(reach: int, alphabet: list) -> Transducer:
    """Writes ``*_at_target`` for insults and threats with a target up to ``reach`` words before or after.

    States: (words left since a target, words left for a target that was guessed; none: 0).
    """
    arcs: dict = {}
    for left in range(reach + 1):
        for owed in range(reach + 1):
            own = arcs[left, owed] = {}
            # A guess whose time is up has no arc: that path ends.
            after = (max(0, left - 1), owed - 1) if owed > 1 else (max(0, left - 1), 0)
            alive = owed != 1
            for x in alphabet:
                own[x] = [(x, after, 0)] if alive else []
            for x, aimed_x in ((INSULT, INSULT_AT), (THREAT, THREAT_AT)):
                if left:
                    own[x] = [(aimed_x, after, 0)] if alive else []
                elif alive:
                    own[x] = [(x, after, 0), (aimed_x, (after[0], after[1] or reach), 0)]
            own[TARGET] = [(TARGET, (reach, 0), 0)]
    return Transducer((0, 0), arcs, frozenset(s for s in arcs if not s[1]))


def chosen(alphabet: list) -> Transducer:
    """Writes the kind of one match of the clause and nothing for the rest; heavier kinds have heavier arcs."""
    kinds = {INSULT: "insult", THREAT: "threat", LOADED: "loaded", NEGATED: "negated", REPORTED: "reported", INSULT_AT: INSULT_AT, THREAT_AT: THREAT_AT}
    before, after = {}, {}
    for x in alphabet:
        before[x], after[x] = [("", "before", 0)], [("", "after", 0)]
        if x in kinds:
            before[x].append((kinds[x], "after", len(KIND_NAMES) - KIND_NAMES.index(kinds[x])))
    return Transducer("before", {"before": before, "after": after}, frozenset(["before", "after"]))


class Grammar:
    """The composed transducer with its best paths, made deterministic as clauses ask for it."""

    def __init__(self) -> None:
        plain = [OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, LOADED]
        self.whole = (
            governed(NEGATION, REACH[NEGATION], NEGATED, plain)
            .then(governed(REPORT, REACH[REPORT], REPORTED, [*plain, NEGATED]))
            .then(aimed(REACH[TARGET], [*plain, NEGATED, REPORTED]))
            .then(chosen([*plain, NEGATED, REPORTED, INSULT_AT, THREAT_AT]))
        )
        self._places: dict[tuple, int] = {}
        self._weights: list[dict] = []
        self._steps: dict[tuple[int, int], int] = {}
        self._place({self.whole.start: 0})

    def _place(self, weights: dict) -> int:
        """The number of a set of states with the best weight that reaches each."""
        key = tuple(sorted(weights.items(), key=repr))
        if key not in self._places:
            self._places[key] = len(self._weights)
            self._weights.append(weights)
        return self._places[key]

    def kind(self, symbols: list[int]) -> str | None:
        """The kind of the heaviest path through a clause, if it matches at all."""
        at = 0
        for symbol in symbols:
            step = self._steps.get((at, symbol))
            if step is None:
                reached: dict = {}
                for state, weight in self._weights[at].items():
                    for _, to, w in self.whole.arcs[state][symbol]:
                        reached[to] = max(reached.get(to, 0), weight + w)
                step = self._steps[at, symbol] = self._place(reached)
            at = step
        best = max((w for state, w in self._weights[at].items() if state in self.whole.final), default=0)
        return KIND_NAMES[len(KIND_NAMES) - best] if best else None


@lru_cache(1)
def grammar() -> Grammar:
    return Grammar()


def tokens_of(text: str) -> list[str]:
    """Lower-cased words and clause ends of a text in composed form."""
    return _TOKENS((text if text.isascii() else unicodedata.normalize("NFC", text)).lower())


def clauses(text: str, class_of: dict[str, int] = CLASS_OF) -> list[tuple[str, str]]:
    """(kind, words) of every matched clause of a text."""
    tokens = tokens_of(text)
    symbols = list(map(class_of.get, tokens))
    if MARKED.isdisjoint(symbols):
        return []
    out, start = [], 0
    for end in [*(i for i, t in enumerate(tokens) if t in ".!?;:\n"), len(tokens)]:
        part = symbols[start:end]
        if not MARKED.isdisjoint(part):
            kind = grammar().kind([s or OTHER for s in part])
            if kind:
                out.append((kind, " ".join(tokens[start:end])))
        start = end + 1
    return out


def match_documents(docs: DataFrame, class_of: dict[str, int] = CLASS_OF) -> DataFrame:
    """``doc_id`` and, for every whole text, ``clauses array<struct<kind, words>>``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("words", pa.string())]))
        found = [[{"kind": k, "words": w} for k, w in clauses(t, class_of)] if t else [] for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "clauses"])

    return map_rows(document_columns(docs), run, "doc_id long, clauses array<struct<kind string, words string>>")


def clause_counts(class_of: dict[str, int], text: str) -> Column:
    """Clauses of each kind in whole texts, as a struct of ``k_<kind>``."""

    @F.pandas_udf(COUNTS)
    def count(texts: pd.Series) -> pd.DataFrame:
        rows = np.zeros((len(texts), len(KIND_NAMES)), np.int32)
        for i, text in enumerate(texts):
            for kind, _ in clauses(text, class_of) if text else []:
                rows[i, KIND_NAMES.index(kind)] += 1
        return pd.DataFrame(rows, columns=[f"k_{k}" for k in KIND_NAMES])

    return count(F.col(text).cast("string")).alias("k")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``text, toxic, fold`` of every labelled document that is not held out, written once; labels grow with the documents and are never broadcast."""
    train = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & train)
    fold = F.coalesce(F.crc32(F.col("text").cast("binary")) % FOLDS, F.lit(0)).cast("int").alias("fold")
    return written(document_columns(docs).where(train).join(marked.hint("merge"), "doc_id").select("text", "toxic", fold))


def word_counts(training: DataFrame) -> DataFrame:
    """``word, bad_<fold>, good_<fold>``: training rows that hold each word, by label and fold; the row of the empty word holds the totals."""

    def counted(seen: Counter) -> pa.RecordBatch:
        arrays = [pa.array([key[k] for key in seen], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int32()))]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(list(seen.values()), pa.int64())], ["word", "toxic", "fold", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text, toxic, fold in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                seen.update((w, toxic, fold) for w in ({"", *tokens_of(text)} if text else {""}))
                if len(seen) > 200_000:
                    yield counted(seen)
                    seen = Counter()
        yield counted(seen)

    part = lambda y, k: F.coalesce(F.sum(F.when((F.col("toxic") == y) & (F.col("fold") == k), F.col("n"))), F.lit(0))
    cells = training.select("text", "toxic", "fold").mapInArrow(run, "word string, toxic int, fold int, n long")
    return written(cells.groupBy("word").agg(*[part(y, k).alias(f"{c}_{k}") for y, c in ((1, "bad"), (0, "good")) for k in range(FOLDS)]))


def marked_words(counts: DataFrame, without: int | None, least: float, fixed: dict[str, int], most_words: int) -> dict[str, tuple[float, bool]]:
    """Words that mark toxic rows outside the fold ``without``, with their ratio and whether they are insults; no fixed word among them.

    most_words: size of the classifier; beyond it, it holds the words of the highest ratios.
    """
    kept = [k for k in range(FOLDS) if k != without]
    per_word = counts.selectExpr("word", *[" + ".join(f"{c}_{k}" for k in kept) + f" AS {c}" for c in ("bad", "good")])
    total = per_word.where("word = ''").first()
    if total is None or not total.bad or not total.good:
        return {}
    base = total.bad / (total.bad + total.good)
    found = per_word.where("word <> '' AND bad > 0 AND bad >= good").withColumns({"n": F.expr("bad + good"), "share": F.expr("bad / (bad + good)")})
    ratio = F.expr(f"2 * (bad * ln(share / {base}D) + CASE WHEN good > 0 THEN good * ln((1 - share) / (1 - {base}D)) ELSE 0 END)")
    lower = F.expr("(share + 2 / n - 2 * sqrt(share * (1 - share) / n + 1 / (n * n))) / (1 + 4 / n)")
    rows = found.withColumn("ratio", ratio).where((F.col("share") > base) & (F.col("ratio") >= least)).orderBy(F.desc("ratio"), "word").limit(most_words).select("word", "ratio", (lower >= INSULT_SHARE).alias("strong")).collect()
    return {r.word: (r.ratio, r.strong) for r in rows if r.word not in fixed and r.word.isalpha()}


def least_ratio(training: DataFrame, counts: DataFrame, fixed: dict[str, int], most_words: int) -> float:
    """The bound of ``RATIOS`` with the fewest training rows misjudged by words learned on the other folds; ties to the highest.

    A row counts as found if it holds a learned word of at least that ratio.
    """
    lexicons = [{w: r for w, (r, _) in marked_words(counts, k, min(RATIOS), fixed, most_words).items()} for k in range(FOLDS)]

    @F.pandas_udf("double")
    def highest(texts: pd.Series, folds: pd.Series) -> pd.Series:
        return pd.Series([max(map(lexicons[k].get, lexicons[k].keys() & set(tokens_of(t)) if t else ()), default=0.0) for t, k in zip(texts, folds, strict=True)], dtype="float64")

    judged = training.select(highest("text", "fold").alias("r"), "toxic")
    wrong = judged.agg(*[F.count_if((F.col("r") >= bound) != (F.col("toxic") == 1)).alias(f"w_{i}") for i, bound in enumerate(RATIOS)]).first()
    return max(zip(RATIOS, wrong, strict=True), key=lambda x: (-x[1], x[0]))[0]


def learned_words(training: DataFrame, fixed: dict[str, int] = CLASS_OF, most_words: int = 200_000) -> dict[str, int]:
    """Words that mark toxic training rows, each with its class; no fixed word among them."""
    counts = word_counts(training)
    found = marked_words(counts, None, least_ratio(training, counts, fixed, most_words), fixed, most_words)
    return {w: INSULT if strong else LOADED for w, (_, strong) in found.items()}


def _feature(column: str) -> str:
    """How a count of clauses enters the score: every further clause adds, each less than the one before."""
    return f"log2(1D + {column})"


def fit(training: DataFrame, class_of: dict[str, int] = CLASS_OF, ridge: float = 1.0) -> np.ndarray:
    """Intercept and kind weights from all training rows, by Newton steps.

    Rows are summed up per combination of counts and written once; each step sums up the gradient and
    the curvature of that table, so a fixed number of sums reaches the driver.
    """
    names = [f"k_{k}" for k in KIND_NAMES]
    sums = written(training.select(clause_counts(class_of, "text"), "toxic").select("k.*", "toxic").groupBy(*names).agg(F.count("*").alias("n"), F.sum("toxic").alias("y")))
    weights = PRIOR.copy()
    x = sums.selectExpr("n", "y", "1D AS x_0", *[f"{_feature(c)} AS x_{i}" for i, c in enumerate(names, 1)])
    size = range(len(weights))
    pull = np.array([1e-3, *[ridge] * len(names)])
    for _ in range(50):
        z = " + ".join(f"{float(w)!r}D * x_{i}" for i, w in enumerate(weights))
        at = x.withColumn("p", F.expr(f"1D / (1D + exp(-greatest(least({z}, 30D), -30D)))"))
        row = at.selectExpr(*[f"sum((y - n * p) * x_{i})" for i in size], *[f"sum(n * p * (1D - p) * x_{i} * x_{j})" for i in size for j in size]).first()
        if row[0] is None:
            return weights
        flat = np.array(row, float)
        gradient = flat[: len(weights)] - pull * (weights - PRIOR)
        step = np.linalg.solve(flat[len(weights) :].reshape(len(weights), -1) + np.diag(pull), gradient)
        weights = weights + step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return weights


def score_of(weights: np.ndarray, prefix: str = "") -> Column:
    """The score as an expression over the columns ``k_<kind>`` below ``prefix``."""
    z = F.lit(float(weights[0]))
    for kind, w in zip(KIND_NAMES, weights[1:], strict=True):
        z = z + F.lit(float(w)) * F.expr(_feature(f"{prefix}k_{kind}"))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fitted(docs: DataFrame, labels: DataFrame, fixed: dict[str, int] = CLASS_OF, most_words: int = 200_000) -> tuple[dict[str, int], np.ndarray]:
    """The classes of fixed and learned words, and the weights."""
    training = training_rows(docs, labels)
    class_of = learned_words(training, fixed, most_words) | fixed
    return class_of, fit(training, class_of)


def score_documents(docs: DataFrame, labels: DataFrame, fixed: dict[str, int] = CLASS_OF, most_words: int = 200_000) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document; only training texts are shuffled and read again.

    fixed: classes of words that need no label.  most_words: learned words that the classifier holds at most.
    """
    class_of, weights = fitted(docs, labels, fixed, most_words)
    counts = document_columns(docs).select("doc_id", clause_counts(class_of, "text"))
    out = counts.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_of(weights, "k.").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def kept_documents(docs: DataFrame, labels: DataFrame, fixed: dict[str, int] = CLASS_OF, most_words: int = 200_000) -> DataFrame:
    """The rows of ``docs`` that score under 0.5, all columns, never shuffled whole."""
    class_of, weights = fitted(docs, labels, fixed, most_words)
    whole = docs.select(F.struct("*").alias("row"), clause_counts(class_of, "text"))
    return whole.where(score_of(weights, "k.") < 0.5).select("row.*")
