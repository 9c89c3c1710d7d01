"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words are mapped to symbols (insult, threat, target, negation, report verb, quote, other) with a weight each. Five transducers
rewrite the symbols of a clause, one after the other:

* reported speech marks insults and threats after a report verb or inside quotes;
* negation marks those within three words after a negation;
* target guesses whether the clause addresses a person, marks what is left accordingly, and accepts only if the guess was right;
* insult takes marked insults out as matches, the first of a clause at full weight, further ones at half;
* threat does the same for threats.

Their composition is one machine, built once from the five. A clause is scored as a whole by its accepted path: the matches
with their classes (plain, targeted, negated, reported) and weights. A document's features are the weights of its clauses,
summed by class, and a logistic curve turns them into a score. Quotes that stay open go on in the next clause of the line.

Learned from labelled rows only (at most `train_rows` different texts, the smallest by hash): lexicon entries (words, and
prefixes of words that aren't entries themselves) that are significantly more common in toxic texts, and the weights of the
classes, drawn towards fixed ones. Entries need a share of the toxic texts, so their number is bounded. Labels don't tell insults from threats, so
a learned entry is a threat only if the seed lexicon says so. A fixed seed lexicon stands beside them.

Defined cases: null and empty texts have no matches and the lowest score; without labelled rows the seed lexicon and the
fixed weights hold; an id or a text labelled more than once is toxic if any label is; null labels are left out; repeated rows
are scored each; rows with a null doc_id are scored but not learned from; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import drop, materialize

TRAIN_ROWS = 200_000
THRESHOLD = 0.3
OTHER, TARGET, NEGATION, REPORT, QUOTE, THREAT, INSULT = range(7)
END = -1  # of a clause
#: Fixed seed words.
SEED = {
    INSULT: "idiot idiots moron morons imbecile stupid dumb loser losers scum trash garbage pathetic worthless disgusting clown fool jerk creep pig vermin filth",
    THREAT: "kill hurt destroy beat stab shoot burn strangle",
    TARGET: "you your yours yourself u ur he she they him her them this these those people everyone du dich dir ihr sie tu te toi vous usted ustedes ti",
    NEGATION: "not no never nobody isn aren wasn don doesn didn cannot without nicht kein keine nie ne pas jamais nunca jam tampoco",
    REPORT: "said says say wrote writes called calls claimed claims quoted alleged reported according sagte schrieb dit disait dijo",
}
CLASSES = ("plain", "targeted", "negated", "reported")
FEATURES = [f"{k}_{c}" for k in ("insult", "threat") for c in CLASSES]
#: Fixed weights that the learned ones are drawn to: bias, then FEATURES.
PRIOR = np.array([-3.0, 2.0, 3.0, 0.5, 0.5, 0.7, 3.0, 0.2, 0.2])
_TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n]+|[\"“”«»]")
_PREFIXES = (6, 5, 4, 3)


# -- the transducers and their composition ------------------------------------------------------------------
@dataclass
class Transducer:
    """Arcs by state and symbol read: (next state, symbol written, weight). Paths begin in start and are accepted in final."""

    start: int
    final: frozenset[int]
    arcs: dict[tuple[int, object], list[tuple[int, object, float]]]


#: What the transducers read and write: plain symbols, and matches (INSULT or THREAT, class number) once they are marked.
PLAIN, TARGETED, NEGATED, REPORTED = range(4)
MARKED = [(kind, c) for kind in (INSULT, THREAT) for c in range(4)]
TAPE = [*range(7), *MARKED]


def _machine(states: int, step, final=None, start: int = 0) -> Transducer:
    """The transducer whose arcs are those that step(state, symbol) lists."""
    return Transducer(start, frozenset(range(states) if final is None else final), {(q, x): out for q in range(states) for x in TAPE if (out := step(q, x))})


def reported_speech(inside: bool = False) -> Transducer:
    """Bit 0: after a report verb; bit 1: inside quotes."""

    def step(q, x):
        return [(q | 1 if x == REPORT else q ^ 2 if x == QUOTE else q, (x, REPORTED) if x in (INSULT, THREAT) and q else x, 1.0)]

    return _machine(4, step, start=2 if inside else 0)


def negation() -> Transducer:
    """The state is the number of words left under the last negation."""

    def step(q, x):
        return [(3 if x == NEGATION else max(0, q - 1), (x, NEGATED) if x in (INSULT, THREAT) and q else x, 1.0)]

    return _machine(4, step)


def target() -> Transducer:
    """0: nothing read; 1: guessed that there is no target; 2: guessed that one comes; 3: guessed so, and it came."""

    def step(q, x):
        out = []
        if q in (0, 1) and x != TARGET:
            out.append((1, (x, PLAIN) if x in (INSULT, THREAT) else x, 1.0))
        if q != 1:
            out.append((3 if x == TARGET or q == 3 else 2, (x, TARGETED) if x in (INSULT, THREAT) else x, 1.0))
        return out

    return _machine(4, step, final=(0, 1, 3))


def matches(kind: int, further: float = 0.5) -> Transducer:
    """Takes marked words of one kind as matches; those after the first of the clause count `further`."""

    def step(q, x):
        hit = isinstance(x, tuple) and x[0] == kind
        return [(1 if hit else q, x, further if hit and q else 1.0)]

    return _machine(2, step)


def compose(a: Transducer, b: Transducer) -> Transducer:
    """The transducer that rewrites by a, then by b; only states that can be reached."""
    number, todo, arcs = {(a.start, b.start): 0}, [(a.start, b.start)], {}
    by_state: dict[int, list] = {}
    for (q, x), out in a.arcs.items():
        by_state.setdefault(q, []).append((x, out))
    while todo:
        p, q = todo.pop()
        for x, out in by_state.get(p, []):
            found = [((p2, q2), z, v * w) for p2, y, v in out for q2, z, w in b.arcs.get((q, y), [])]
            for pair, _, _ in found:
                if pair not in number:
                    number[pair] = len(number)
                    todo.append(pair)
            if found:
                arcs[number[p, q], x] = [(number[pair], z, w) for pair, z, w in found]
    return Transducer(0, frozenset(i for (p, q), i in number.items() if p in a.final and q in b.final), arcs)


def grammar_machine(inside: bool = False) -> Transducer:
    out = reported_speech(inside)
    for part in (negation(), target(), matches(INSULT), matches(THREAT)):
        out = compose(out, part)
    return out


#: By whether the clause begins inside quotes.
_MACHINES = (grammar_machine(False), grammar_machine(True))


def clause_matches(machine: Transducer, clause: list[tuple[int, float]]) -> list[tuple[tuple[int, int], float]]:
    """((kind, class), weight) of the accepted path over (symbol, weight); every clause has exactly one."""
    paths: list[tuple[int, list]] = [(machine.start, [])]
    for x, weight in clause:
        paths = [(q2, [*found, (z, w * weight)] if isinstance(z, tuple) else found) for q, found in paths for q2, z, w in machine.arcs.get((q, x), [])]
    return next(found for q, found in paths if q in machine.final)


class Grammar:
    """words: entry -> (symbol, weight); prefixes: entry -> weight, all insults."""

    def __init__(self, words: dict[str, tuple[int, float]], prefixes: dict[str, float]):
        self.words, self.prefixes, self.known = words, prefixes, {}

    def symbol(self, token: str) -> tuple[int, float]:
        if token in self.words:
            return self.words[token]
        if token in '"“”«»':
            return QUOTE, 0.0
        if token[0] in ".!?;:\n":
            return END, float("\n" in token)
        for k in _PREFIXES:
            if (w := self.prefixes.get(token[:k])) is not None and len(token) >= k:
                return INSULT, w
        return OTHER, 0.0

    def symbols(self, tokens: list[str]) -> list[tuple[int, float]]:
        known = self.known
        try:
            return [known[t] for t in tokens]
        except KeyError:
            if len(known) > 500_000:
                known.clear()
            for t in tokens:
                if t not in known:
                    known[t] = self.symbol(t)
            return [known[t] for t in tokens]

    def features(self, text: str | None) -> list[float]:
        """Weights of the matched clauses by class, as log1p."""
        out = [0.0] * len(FEATURES)
        symbols = self.symbols(_TOKEN.findall((text or "").lower()))
        if not symbols or max(symbols)[0] < THREAT:
            return out
        start, inside = 0, False
        for i, (s, new_line) in enumerate([*symbols, (END, 1.0)]):
            if s == END:
                clause = symbols[start:i]
                if clause and max(clause)[0] >= THREAT:
                    for (kind, c), w in clause_matches(_MACHINES[inside], clause):
                        out[(4 if kind == THREAT else 0) + c] += w
                inside = not new_line and inside ^ (sum(x == QUOTE for x, _ in clause) & 1 == 1)
                start = i + 1
        return np.round(np.log1p(out), 3).tolist()


# -- learning -----------------------------------------------------------------------------------------------
def _lower_bound(a: Column, b: Column, z: float = 1.96) -> Column:
    """Lower end of the score interval for a of b."""
    p = a / b
    return (p + z * z / (2 * b) - z * F.sqrt(p * (1 - p) / b + z * z / (4 * b * b))) / (1 + z * z / b)


def learn_lexicon(train: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """(words, prefixes) with weights, from train (text, toxic), one row per text."""

    def count(batches):
        import pyarrow as pa

        n: dict[str, list[int]] = {}
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for w in set(_TOKEN.findall((text or "").lower())):
                    x = n.setdefault(w, [0, 0])
                    x[0] += toxic
                    x[1] += 1
        items = list(n.items())
        for at in range(0, len(items), 50_000):
            some = items[at : at + 50_000]
            yield pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in some]), "a": pa.array([x[0] for _, x in some], pa.int64()), "b": pa.array([x[1] for _, x in some], pa.int64())})

    texts, toxic = train.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not toxic or toxic == texts:
        return {}, {}
    least = max(4, -(-toxic // 200))  # a share of the toxic texts bounds the number of entries
    words = train.select("text", "toxic").mapInArrow(count, "word string, a long, b long").groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    words = materialize(words.where("length(word) > 1 and a > 0").withColumn("low", _lower_bound(F.col("a"), F.col("b"))), "words")
    sure = (F.col("a") >= least) & ((F.col("low") >= 0.8) | (F.col("a") == F.col("b")))
    chosen = words.where(sure)
    rest = words.where(~sure)
    prefix = rest.withColumn("k", F.explode(F.array(*[F.lit(k) for k in _PREFIXES]))).where("length(word) >= k")
    prefix = prefix.groupBy(F.expr("substring(word, 1, k)").alias("word")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    prefix = prefix.withColumn("low", _lower_bound(F.col("a"), F.col("b")))
    # words without any toxic text were left out above, so prefixes are held against all words once more
    candidates = prefix.where((F.col("a") >= least) & (F.col("low") >= 0.5))
    weight = lambda rows: {r["word"]: float(np.log(r["low"] / (1 - min(r["low"], 0.99))) + 1.0) for r in rows}
    return weight(chosen.collect()), weight(candidates.collect())


def prefix_precision(train: DataFrame, prefixes: dict[str, float], words: dict[str, float]) -> dict[str, float]:
    """The prefixes whose texts, counted over all training words but the entries, are toxic nine times of ten."""
    if not prefixes:
        return {}

    def count(batches):
        import pyarrow as pa

        n: dict[str, list[int]] = {}
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = {w[:k] for w in set(_TOKEN.findall((text or "").lower())) if w not in words for k in _PREFIXES}
                for p in found.intersection(prefixes):
                    x = n.setdefault(p, [0, 0])
                    x[0] += toxic
                    x[1] += 1
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(n), pa.string()), "a": pa.array([x[0] for x in n.values()], pa.int64()), "b": pa.array([x[1] for x in n.values()], pa.int64())})

    counted = train.select("text", "toxic").mapInArrow(count, "word string, a long, b long").groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    kept = counted.withColumn("low", _lower_bound(F.col("a"), F.col("b"))).where("low >= 0.9 or (a = b and a >= 4)").collect()
    return {r["word"]: float(np.log(r["low"] / (1 - min(r["low"], 0.99))) + 1.0) for r in kept}


def fit_weights(rows: list[tuple[list[float], int, int]], strength: float = 2.0, rounds: int = 50) -> np.ndarray:
    """Logistic weights (bias first) of (features, toxic, times), drawn towards PRIOR; Newton's steps."""
    w = PRIOR.copy()
    if not rows or len({t for _, t, _ in rows}) < 2:
        return w
    x = np.array([[1.0, *f] for f, _, _ in rows])
    y, n = np.array([t for _, t, _ in rows], float), np.array([k for _, _, k in rows], float)
    pull = np.full(len(w), strength)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (n * (p - y)) + pull * (w - PRIOR)
        h = (x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(h, g)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    """Lexicon and weights, bounded by the share of toxic texts that an entry needs."""

    words: dict[str, tuple[int, float]]
    prefixes: dict[str, float]
    weights: np.ndarray


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, train_rows: int = TRAIN_ROWS) -> Model:
    """Learn from the labelled documents outside held_out. labels: doc_id, toxic."""
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    known = labels.where(F.col("toxic").isNotNull() & ~F.coalesce(held_out, F.lit(False))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = F.broadcast(materialize(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows), "train"))  # at most train_rows rows
    hashed = rows.join(known, "doc_id").groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    once = F.broadcast(materialize(hashed.orderBy("h").limit(train_rows), "texts"))  # ids may repeat: texts are bounded too
    # one row a text, whatever repeats: the copies of a text are one row before anything is shuffled
    train = materialize(rows.join(once, ["doc_id", "h"]).dropDuplicates(["h"]).select("text", "toxic"), "training")
    words, prefixes = learn_lexicon(train)
    prefixes = prefix_precision(train, prefixes, words)
    entries = {w: (s, 1.0) for s, line in SEED.items() for w in line.split()}
    entries |= {w: (entries.get(w, (INSULT,))[0], x) for w, x in words.items() if entries.get(w, (INSULT,))[0] >= THREAT}
    seen = train.select("toxic", _features(entries, prefixes)(F.col("text")).alias("features")).groupBy("features", "toxic").count().collect()  # at most train_rows rows
    drop(train)
    return Model(entries, prefixes, fit_weights([(r["features"], int(r["toxic"]), r["count"]) for r in seen]))


def _features(words, prefixes):
    @F.pandas_udf("array<double>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        grammar = Grammar(words, prefixes)
        for texts in batches:
            yield texts.map(grammar.features)

    return features


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """rows (with a column text) with found: struct of score and features. One narrow pass that leaves other columns inside the JVM."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, features array<double>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        grammar = Grammar(m.words, m.prefixes)
        for texts in batches:
            f = [grammar.features(t) for t in texts]
            z = np.array(f, float).reshape(len(f), len(FEATURES)) @ m.weights[1:] + m.weights[0]
            yield pd.DataFrame({"score": 1 / (1 + np.exp(-np.clip(z, -500, 500))), "features": f})

    return rows.withColumn("found", score(F.col("text")))


def score_toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted and the matched weights by class. labels: doc_id, toxic; those of held-out rows aren't read."""
    model = fit(docs, labels, held_out, train_rows)
    rows = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    found = scored(rows, model).select("doc_id", "held_out", F.col("found").alias("found"))
    return found.select("doc_id", "held_out", "found.*").select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), *[F.col("features")[i].alias(n) for i, n in enumerate(FEATURES)])


def drop_toxic(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """The rows that score below the threshold: one narrow pass, no text is shuffled."""
    whole = docs.select(F.struct(*docs.columns).alias("doc"), "text")
    return scored(whole, fit(docs, labels, held_out)).where(F.col("found.score") < THRESHOLD).select("doc.*")
