"""Toxicity by a weighted finite-state pattern grammar.

A lexicon turns the words of a clause into symbols: insult, threat verb, target, negator, reporting verb or
other.  Small transducers rewrite the symbols one after the other: `NEGATION` marks an insult or a threat
shortly after a negator, `REPORT` one in reported or quoted speech, `TARGET` an insult in a clause that has named
its target, `THREAT` turns a threat verb beside a target into a threat.  `compose` joins them into one
deterministic machine at import, so that a clause is read once, a table lookup per word.  What comes out
is the kind of each match; a clause weighs the sum of its words' weights by kind, and a document's
score is a logistic function of the kinds' sums over its clauses.  A word outside of such a match counts
nothing.

Learned from labelled rows: the insults (words, and stems shared by several words, that stand out in
toxic documents, with their log odds as weights), and the weights of the kinds (a logistic regression drawn
towards the grammar's own weights).  Without labelled rows of both classes the seed words and those
weights are used.

Rows: one result per input row.  Null and empty texts have no clause and get the score of a text without matches.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sangloc.llm.common import column_type, is_held_out, map_text, removed, staged
from sangloc.llm.labelled import labelled_texts

#: A document is toxic if its score reaches this.
TOXIC_SCORE = 0.3
#: The grammar learns from about this many labelled rows.
FIT_ROWS = 30_000
#: A learned pattern occurs in this share of the toxic rows, and in this many.
LEAST_SHARE, LEAST_ROWS = 0.005, 4
#: and has this purity, by which twice the log likelihood ratio is this high.
LEAST_PURITY, LEAST_RATIO = 0.7, 30.0
#: Lengths of learned stems.
STEMS = (4, 5, 6)
SEED_WEIGHT = 3.0

TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;:\n\"«»“”]")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
BOUNDARY = frozenset(".!?;:\n")
QUOTES = frozenset('"«»“”')

# Seed words by symbol, in English, German, French and Spanish.
SEEDS = {
    "insult": "idiot moron stupid scum loser trash trottel abschaum dummkopf connard imbécile crétin idiota imbécil estúpido",
    "threaten": "kill hurt destroy stab burn töten schlagen vernichten tuer frapper détruire matar golpear destruir",
    "target": "you your yourself he him she her they them du dich dir euch ihr tu toi vous vos usted ustedes ellos",
    "negate": "not never no isn't aren't don't nicht kein keine nie pas jamais nunca jamás",
    "report": "said says told claims reported wrote called sagte sagt behauptet dit disait affirme dijo dice afirma",
}
SYMBOLS = ("other", "insult", "threaten", "target", "negate", "report", "quote")
#: Kinds of matches, and the weights that the regression starts from.
KINDS = {"plain": 2.0, "targeted": 2.5, "negated": 0.7, "reported": 1.2, "threat": 2.0}
START_BIAS = -4.0


@dataclass
class Transducer:
    """arcs: (state, symbol) to (state, symbol); a symbol without an arc passes and keeps the state."""

    arcs: dict[tuple[str, str], tuple[str, str]] = field(default_factory=dict)
    start: str = "0"

    def step(self, state: str, symbol: str) -> tuple[str, str]:
        return self.arcs.get((state, symbol), (state, symbol))


def _negation(reach: int) -> Transducer:
    """A negator reaches over the next `reach` words."""
    arcs = {("0", "negate"): (str(reach), "other")}
    for left in range(1, reach + 1):
        after = str(left - 1)
        for symbol in SYMBOLS:
            arcs[str(left), symbol] = (after, symbol)
        arcs[str(left), "negate"] = (str(reach), "other")
        arcs[str(left), "insult"] = (after, "negated")
        arcs[str(left), "threaten"] = (after, "other")
    return Transducer(arcs)


NEGATION = _negation(3)
REPORT = Transducer(
    {
        ("0", "report"): ("told", "other"),
        ("0", "quote"): ("quoted", "other"),
        ("told", "insult"): ("told", "reported"),
        ("told", "threaten"): ("told", "other"),
        ("told", "quote"): ("quoted", "other"),
        ("quoted", "insult"): ("quoted", "reported"),
        ("quoted", "threaten"): ("quoted", "other"),
        ("quoted", "quote"): ("0", "other"),
    }
)
TARGET = Transducer({("0", "target"): ("named", "target"), ("named", "insult"): ("named", "targeted")})
THREAT = Transducer(
    {
        ("0", "target"): ("named", "other"),
        ("0", "threaten"): ("verb", "other"),
        ("named", "threaten"): ("named", "threat"),
        ("verb", "target"): ("named", "threat"),
    }
)


def compose(machines: list[Transducer], symbols: tuple[str, ...]) -> tuple[list[list[tuple[int, str]]], dict]:
    """One machine that feeds each symbol through all of them: table[state][symbol] = (state, output)."""
    first = tuple(m.start for m in machines)
    number, table, todo = {first: 0}, [], [first]
    for states in todo:
        row = []
        for symbol in symbols:
            after = []
            for machine, state in zip(machines, states):
                state, symbol = machine.step(state, symbol)
                after.append(state)
            after = tuple(after)
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            row.append((number[after], "plain" if symbol == "insult" else symbol))
        table.append(row)
    return table, number


GRAMMAR, _ = compose([NEGATION, REPORT, TARGET, THREAT], SYMBOLS)
SYMBOL_OF = {word: SYMBOLS.index(name) for name, text in SEEDS.items() for word in text.split()}
KIND_OF = {name: i for i, name in enumerate(KINDS)}
INSULT, THREATEN, QUOTE = (SYMBOLS.index(x) for x in ("insult", "threaten", "quote"))


@dataclass
class Grammar:
    words: dict[str, float]
    stems: dict[str, float]
    weights: np.ndarray
    bias: float

    def weight(self, word: str) -> float:
        """The weight of an insult, 0 for other words."""
        found = self.words.get(word, 0.0)
        for size in STEMS:
            found = max(found, self.stems.get(word[:size], 0.0))
        return found

    def clauses(self, text: str | None) -> list[tuple[int, int, list[float]]]:
        """(start, end, weight by kind) of the clauses with a match."""
        if not text:
            return []
        low = text.lower()
        found = set(WORD.findall(low))
        weight = {w: x for w in found if (x := self.weight(w))}
        if not weight and not any(SYMBOL_OF.get(w) == THREATEN for w in found):
            return []
        out, state, sums, begin, last = [], 0, None, 0, 0
        for match in TOKEN.finditer(low):
            token = match.group()
            if token in BOUNDARY:
                if sums:
                    out.append((begin, match.start(), sums))
                state, sums, begin = 0, None, match.end()
                continue
            last = match.end()
            symbol = INSULT if token in weight else QUOTE if token in QUOTES else SYMBOL_OF.get(token, 0)
            state, said = GRAMMAR[state][symbol]
            kind = KIND_OF.get(said)
            if kind is not None:
                sums = sums or [0.0] * len(KINDS)
                sums[kind] += weight.get(token, SEED_WEIGHT)
        if sums:
            out.append((begin, last, sums))
        return out

    def features(self, clauses: list[tuple[int, int, list[float]]]) -> np.ndarray:
        return np.log1p(np.sum([c[2] for c in clauses], 0)) if clauses else np.zeros(len(KINDS))

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights + self.bias, -60, 60)))


def seeds() -> Grammar:
    words = {w: SEED_WEIGHT for w in SEEDS["insult"].split()}
    return Grammar(words, {}, np.array(list(KINDS.values())), START_BIAS)


def patterns_of(text: str) -> dict[str, str]:
    """The words of a text, as `word`, and their stems, as `stem*`, with one of the stem's words each."""
    found = set(WORD.findall(text.lower()))
    out = {w: w for w in found}
    for size in STEMS:
        out.update({w[:size] + "*": w for w in found if len(w) > size})
    return out


def count_patterns(rows: DataFrame, only: frozenset[str] | None = None) -> DataFrame:
    """(pattern, label, rows, first_word, last_word); each task sends a pattern once per label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = {}
        low: dict[str, str] = {}
        high: dict[str, str] = {}
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = patterns_of(text or "")
                if only is not None:
                    found = {p: w for p, w in found.items() if p in only}
                seen.setdefault(label, Counter()).update(found.keys())
                for p, w in found.items():
                    if w < low.get(p, "\U0010ffff"):
                        low[p] = w
                    if w > high.get(p, ""):
                        high[p] = w
        for label, counter in seen.items():
            names = list(counter)
            columns = [names, [label] * len(names), list(counter.values()), [low[p] for p in names], [high[p] for p in names]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string()))],
                ["pattern", "label", "n", "low", "high"],
            )

    counted = rows.select("text", F.col("label").cast("int")).mapInArrow(run, "pattern string, label int, n long, low string, high string")
    return counted.groupBy("pattern", "label").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def stands_out(toxic: int, clean: int, all_toxic: int, all_clean: int) -> float:
    """The smoothed log odds of a pattern, or 0 if it says little or could be chance."""
    share, base = toxic / (toxic + clean), all_toxic / (all_toxic + all_clean)
    if share < LEAST_PURITY or share <= base:
        return 0.0
    ratio = 2 * (toxic * math.log(share / base) + (clean * math.log((1 - share) / (1 - base)) if clean else 0.0))
    if ratio < LEAST_RATIO:
        return 0.0
    return math.log((toxic + 0.5) / (all_toxic + 1)) - math.log((clean + 0.5) / (all_clean + 1))


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS
) -> Grammar:
    """The driver gets patterns that a fixed share of the sampled toxic rows hold, and the sample's features."""
    # Copies of a text are one witness, not many; a text whose copies disagree is none.
    once = labelled_texts(docs, labels, label, key, text, fit_rows).groupBy("text").agg(F.min("label").alias("label"), F.max("label").alias("_max"))
    rows = staged(once.where("label = _max").drop("_max"), "labelled")
    try:
        return _learned(rows)
    finally:
        removed(rows)


def _learned(rows: DataFrame) -> Grammar:
    totals = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    grammar = seeds()
    if set(totals) != {0, 1}:
        return grammar
    least = max(LEAST_ROWS, math.ceil(LEAST_SHARE * totals[1]))
    often = count_patterns(rows.where("label = 1")).where(F.col("n") >= least)
    often = often.where(~F.col("pattern").endswith("*") | (F.col("low") < F.col("high")))
    toxic = {r.pattern: r.n for r in often.select("pattern", "n").collect()}
    clean = count_patterns(rows.where("label = 0"), frozenset(toxic)).select("pattern", "n").collect()
    clean = {r.pattern: r.n for r in clean}
    for pattern, n in toxic.items():
        found = stands_out(n, clean.get(pattern, 0), totals[1], totals[0])
        if found and pattern.endswith("*"):
            grammar.stems[pattern[:-1]] = found
        elif found and SYMBOL_OF.get(pattern, INSULT) == INSULT:
            grammar.words[pattern] = found
    return _regression(grammar, _features(rows, grammar))


def _features(rows: DataFrame, grammar: Grammar) -> pa.Table:
    """(label, features, rows): equal rows are one row with a count."""
    names = list(KINDS)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([grammar.features(grammar.clauses(t)) for t in batch.column(0).to_pylist()])
        return pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(x[:, i]) for i in range(len(names)))], ["label", *names])

    schema = "label int, " + ", ".join(f"{n} double" for n in names)
    made = map_text(rows.select("text", F.col("label").cast("int")), "text", run, schema)
    return made.groupBy("label", *names).count().toArrow()


def _regression(grammar: Grammar, table: pa.Table) -> Grammar:
    """Newton steps; the weights stay near the grammar's own unless the rows speak against them."""
    x = np.column_stack([np.ones(len(table)), *(table[k].to_numpy() for k in KINDS)])
    y, n = table["label"].to_numpy(), table["count"].to_numpy().astype(float)
    prior = np.array([START_BIAS, *KINDS.values()])
    pull = np.array([1e-3, *[2.0] * len(KINDS)])
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (p - y)) + pull * (w - prior)
        hessian = (x.T * (n * np.maximum(p * (1 - p), 1e-6))) @ x + np.diag(pull)
        step = np.linalg.solve(hessian, gradient)
        w = w - step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    # More of a match never makes a text less toxic.
    grammar.bias, grammar.weights = float(w[0]), np.maximum(0.0, w[1:])
    return grammar


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))


def score(docs: DataFrame, grammar: Grammar, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, clauses): start and end, in characters, and score of each clause with a match."""
    schema = T.StructType([T.StructField(key, column_type(docs, key)), T.StructField("score", T.DoubleType()), T.StructField("clauses", SPANS)])
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [grammar.clauses(t) for t in batch.column(1).to_pylist()]
        scores = grammar.score(np.array([grammar.features(c) for c in found]))
        clauses = [
            [{"start": a, "end": b, "score": float(grammar.score(np.log1p(s)))} for a, b, s in c] for c in found
        ]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(clauses, spans)], schema.names)

    return map_text(docs.select(key, F.col(text).cast("string").alias("_text")), "_text", run, schema)


def judged(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", toxic_score: float = TOXIC_SCORE) -> DataFrame:
    """(key, held_out, score, predicted, clauses) of every row, by a model of the rows that are not held out."""
    return score(docs, fit(docs, labels, label, key), key).select(
        key,
        is_held_out(F.col(key)).alias("held_out"),
        "score",
        (F.col("score") >= toxic_score).cast("int").alias("predicted"),
        "clauses",
    )
