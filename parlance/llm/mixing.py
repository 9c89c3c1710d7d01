"""Mixing sources to target weights by soft membership.

A naive Bayes classifier over hashed words, fitted on a labelled table (at most `train_rows` of its rows, the smallest
by hash; half for the counts, half for the temperature), predicts each document's posterior over the domains.
Nonnegative rates, one per document, are then fitted by projected gradient steps so that the expected
tokens of each domain, sum(tokens * posterior * rate), meet the targets in least squares, with a small pull towards rate 1. The squares are weighed by
the inverse of the K x K second moments of the posteriors (of the rows whose rate isn't 0 yet), so a domain of a hundred-thousandth of the tokens counts like any other and few steps are needed.

Domains are any column of the labelled documents whose values a text betrays; production uses `lang`. (A classifier of `source` does no better on
held-out rows than its commonest value, so its posteriors are the prior for every text and no rates could change the mix.)

A step needs one vector of K numbers for all documents, so an iteration is one aggregation of K (K + 2) sums. A document's rate
follows from its posterior and the steps so far; tasks replay them, so no state is kept between
iterations and a lost executor costs one task.

The budget is (just over) the smallest total at which no domain as a whole must shrink; weights are met by repeating, not by
throwing away. mixture_totals gives the totals achieved, and the column missed of mixing_rates the largest relative distance to a target. A domain that is the likeliest of no document can't be
made by repeating documents: it isn't steered, the others meet their targets in proportion, and missed is 1 (with a warning). copies is the rate rounded by a hash of doc_id, so expected totals stay.

Tokens are words. Defined cases: null or empty text has 0 tokens, the prior as posterior and rate 1; labelled rows with a
null or unlisted domain aren't learned from; without labelled rows all domains are equally likely; repeated rows get equal
rates; rows with a null doc_id get rates but aren't learned from; empty tables give no rows; further columns are ignored. Ties between domains go to
the first in the order of targets.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import drop, materialize
from parlance.llm.wordhash import chunks, word_hashes

TRAIN_ROWS = 200_000
CELLS = 1 << 15
#: Production weights of the domains (languages).
TARGETS = {"en": 0.45, "de": 0.2, "fr": 0.2, "es": 0.15}


def _cells(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    h, bound = word_hashes(texts)
    return (h >> np.uint64(49)).astype(np.int64), bound


def _domain_counts(train: DataFrame, k: int) -> np.ndarray:
    """Words by cell and domain over train (text, domain number): CELLS x k, summed by cell before they meet."""

    def count(batches):
        import pyarrow as pa

        n = np.zeros((k, CELLS), np.int64)
        for b in batches:
            domain = b.column(1).to_numpy()
            for at, some in chunks(b.column(0).cast(pa.binary()).to_pylist()):
                cell, bound = _cells(some)
                np.add.at(n, (np.repeat(domain[at : at + len(some)], np.diff(bound)), cell), 1)
        d, c = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(d.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(n[d, c])], names=["d", "c", "n"])

    out = np.zeros((CELLS, k))
    for r in train.select("text", "domain").mapInArrow(count, "d int, c int, n long").groupBy("d", "c").agg(F.sum("n").alias("n")).toPandas().itertuples():  # at most CELLS * k rows
        out[r.c, r.d] = r.n
    return out


def posteriors(means: np.ndarray, words: np.ndarray, prior: np.ndarray, temperature: float) -> np.ndarray:
    """From mean log probabilities by domain; long texts count as `temperature` words."""
    z = means * np.minimum(words, temperature)[:, None] + np.log(prior)
    z -= z.max(1, keepdims=True)
    p = np.exp(z)
    return p / p.sum(1, keepdims=True)


def mean_logs(texts: list[bytes], logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, mean log probability of a word by domain) of each text."""
    cell, bound = _cells(texts)
    n = np.diff(bound)
    total = np.zeros((len(texts), logs.shape[1]))
    full = n > 0
    if full.any():
        total[full] = np.add.reduceat(logs[cell], bound[:-1][full], axis=0) / n[full, None]
    return n, total


def _with_means(rows: DataFrame, shared, kind: str) -> DataFrame:
    """id columns, tokens and mean log probabilities of rows (id, text)."""

    def mean(batches):
        import pyarrow as pa

        logs = shared.value
        for b in batches:
            for at, some in chunks(b.column(1).cast(pa.binary()).to_pylist()):
                n, total = mean_logs(some, logs)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(some)), pa.array(n), pa.array(list(total), pa.list_(pa.float64()))], names=["id", "tokens", "means"])

    return rows.mapInArrow(mean, f"id {kind}, tokens long, means array<double>")


def replay(p: np.ndarray, history: list[np.ndarray], step: float, pull: float) -> np.ndarray:
    """Rates of rows with posteriors p after the steps in history (directions)."""
    r = np.ones(len(p))
    for direction in history:
        r = np.maximum(0.0, r - step * (p @ direction + pull * (r - 1)))
    return r


def _inverse(m: np.ndarray, present: np.ndarray) -> np.ndarray:
    """The inverse of the second moments of the domains that are present; directions in which no rates differ count nothing."""
    out = np.zeros_like(m)
    values, axes = np.linalg.eigh(m[np.ix_(present, present)])
    keep = values > 1e-12 * max(values.max(), 1e-300)
    out[np.ix_(present, present)] = (axes[:, keep] / values[keep]) @ axes[:, keep].T
    return out


def _moments(soft: DataFrame, total: float, k: int, history: list[np.ndarray], step: float, pull: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(expected tokens by domain under the rates so far, second moments of the rows with a rate, tokens by likeliest domain), as shares of total."""

    def add(batches):
        import pandas as pd

        out, m, h = np.zeros(k), np.zeros((k, k)), np.zeros(k)
        for b in batches:
            if len(b):
                q, w = np.stack(b["posterior"].to_numpy()), b["tokens"].to_numpy() / total
                rate = replay(q, history, step, pull)
                out += q.T @ (w * rate)
                on = rate > 0
                m += q[on].T @ (w[on, None] * q[on])
                np.add.at(h, q.argmax(1), w)
        yield pd.DataFrame({"i": np.arange(k * (k + 2)), "x": np.concatenate([out, m.ravel(), h])})

    sums = dict(soft.select("tokens", "posterior").mapInPandas(add, "i int, x double").groupBy("i").agg(F.sum("x")).collect())  # k * (k + 2) rows
    x = np.array([sums[i] for i in range(k * (k + 2))])
    return x[:k], x[k : k + k * k].reshape(k, k), x[k + k * k :]


def fit_rates(soft: DataFrame, targets: np.ndarray, pull: float = 1e-4, rounds: int = 60, tolerance: float = 1e-3) -> tuple[list[np.ndarray], float, float]:
    """(history, step, missed) for soft (tokens, posterior array): targets are shares of the mix; missed is the largest relative distance that is left."""
    k = len(targets)
    total = float(soft.agg(F.sum("tokens")).first()[0] or 0)
    if not total:
        return [], 0.0, 0.0
    step, history = 1 / (1 + pull), []
    share, m, likeliest = _moments(soft, total, k, history, step, pull)
    present = np.flatnonzero((likeliest > 0) & (targets > 0))
    if not len(present):
        return [], step, 1.0
    goal = targets * float((share[present] / targets[present]).max()) * (1 + 4 * tolerance)  # so that no rate falls under 1 by the tolerance alone
    left = lambda r: float(np.abs(r[present] / goal[present]).max())
    residual, still = share - goal, 0
    best = left(residual), 0
    while left(residual) > tolerance and len(history) < rounds and still < 5:  # further steps that bring nothing are not taken
        history.append(_inverse(m, present) @ residual)
        now, m, _ = _moments(soft, total, k, history, step, pull)
        residual = now - goal
        still = 0 if left(residual) < 0.95 * best[0] else still + 1
        best = min(best, (left(residual), len(history)))
    history = history[: best[1]]
    missed = 1.0 if len(present) < (targets > 0).sum() else best[0]
    if missed > tolerance:
        warnings.warn(f"targets are met within {best[0]:.2%} after {len(history)} steps; {int((targets > 0).sum()) - len(present)} domains have no documents", stacklevel=2)
    return history, step, missed


@dataclass
class Mixture:
    """What rates are computed from: bounded by CELLS x domains, and the steps of the fit."""

    names: list[str]
    logs: np.ndarray
    prior: np.ndarray
    temperature: float
    history: list[np.ndarray]
    step: float
    pull: float
    missed: float = 0.0

    def posterior(self, means: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        return posteriors(means, tokens, self.prior, self.temperature)

    def rates(self, p: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        return np.where(tokens > 0, replay(p, self.history, self.step, self.pull), 1.0)


def _softened(rows: DataFrame, shared) -> DataFrame:
    """rows with soft: struct of tokens, posterior and rate, by one narrow pass over column text."""

    @F.pandas_udf("tokens long, posterior array<double>, rate double")
    def soften(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            parts = [mean_logs(some, m.logs) for _, some in chunks([(t or "").encode() for t in texts])]
            n, means = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros((0, len(m.names))))
            p = m.posterior(means, n)
            yield pd.DataFrame({"tokens": n, "posterior": list(p), "rate": m.rates(p, n)})

    return rows.withColumn("soft", soften(F.col("text")))


def fit_mixture(docs: DataFrame, labels: DataFrame, domain: str = "lang", targets: dict[str, float] | None = None, train_rows: int = TRAIN_ROWS, pull: float = 1e-4) -> tuple[Mixture, DataFrame]:
    """The mixture, and the table (id, tokens, posterior) it was fitted on. labels: doc_id of the labelled table."""
    targets = targets or TARGETS
    names = list(targets)
    goal = np.array([targets[x] for x in names], float)
    goal /= goal.sum()
    k, spark = len(names), docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col(domain).alias("domain"))
    number = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)])
    chosen = materialize(labels.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows), "chosen")  # at most train_rows rows
    known = rows.join(F.broadcast(chosen), "doc_id").where(F.col("domain").isin(names)).withColumn("domain", number[F.col("domain")])
    half = F.pmod(F.xxhash64(F.lit(2), "doc_id"), F.lit(2))
    counts = _domain_counts(known.where(half == 0), k)
    prior = (counts.sum(0) + 1) / (counts.sum() + k)
    shared = spark.sparkContext.broadcast(np.log((counts + 0.1) / (counts.sum(0) + 0.1 * CELLS)).astype(np.float32))
    kind = docs.schema["doc_id"].dataType.simpleString()
    # equal means and truths are one row; the limit is for ids that repeat
    tried = _with_means(known.where(half == 1).select(F.struct("doc_id", "domain").alias("id"), "text"), shared, f"struct<doc_id:{kind},domain:int>")
    tried = tried.select("id.domain", "tokens", "means").orderBy(F.xxhash64("id.doc_id", "means")).limit(train_rows).toPandas()  # at most train_rows rows
    temperature = 8.0
    if len(tried):
        means, words, truth = np.stack(tried["means"].to_numpy()), tried["tokens"].to_numpy(), tried["domain"].to_numpy()
        loss = lambda t: -np.log(posteriors(means, words, prior, t)[np.arange(len(truth)), truth] + 1e-12).mean()
        temperature = min((1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0), key=loss)
    mixture = Mixture(names, shared.value, prior, temperature, [], 0.0, pull)
    soft = _softened(rows.select(F.col("doc_id").alias("id"), "text"), spark.sparkContext.broadcast(mixture)).select("id", F.col("soft"))
    soft = materialize(soft.select("id", "soft.tokens", "soft.posterior"), "soft")
    drop(chosen)
    mixture.history, mixture.step, mixture.missed = fit_rates(soft, goal, pull)
    return mixture, soft


def _copies(rate: Column, key: Column) -> Column:
    """The rate rounded up or down by a hash of the key, so that expected totals stay."""
    return F.floor(rate + F.pmod(F.xxhash64(F.lit(4), key), F.lit(1 << 32)) / (1 << 32)).cast("int")


def mixing_rates(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, tokens, domain (likeliest), posterior (array in the order of targets), rate, copies, missed (the same for all). options: those of fit_mixture."""
    mixture, soft = fit_mixture(docs, labels, **options)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rate(batches):
        for b in batches:
            p = np.stack(b["posterior"].to_numpy()) if len(b) else np.zeros((0, len(mixture.names)))
            yield b.assign(rate=mixture.rates(p, b["tokens"].to_numpy()))

    rated = soft.mapInPandas(rate, f"id {kind}, tokens long, posterior array<double>, rate double")
    likeliest = F.array(*[F.lit(n) for n in mixture.names])[(F.array_position("posterior", F.array_max("posterior")) - 1).cast("int")]
    return rated.select(F.col("id").alias("doc_id"), "tokens", likeliest.alias("domain"), "posterior", "rate", _copies(F.col("rate"), F.col("id")).alias("copies"), F.lit(mixture.missed).alias("missed"))


def mixture_totals(rates: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """domain, expected_tokens, share, target: what the rates achieve. One row a domain."""
    targets = targets or TARGETS
    names, whole = list(targets), sum(targets.values())
    sums = rates.agg(*[F.coalesce(F.sum(F.col("tokens") * F.col("rate") * F.col("posterior")[i]), F.lit(0.0)).alias(f"t{i}") for i in range(len(names))])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("domain"), F.col(f"t{i}").alias("expected_tokens"), F.lit(targets[n] / whole).alias("target")) for i, n in enumerate(names)]))
    total = sum((F.col(f"t{i}") for i in range(len(names))), F.lit(0.0))
    return sums.select(total.alias("total"), rows.alias("r")).select("r.domain", "r.expected_tokens", F.try_divide("r.expected_tokens", "total").alias("share"), "r.target")


def mix(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as its copies say. One more narrow pass over the texts instead of a shuffle of them."""
    mixture, soft = fit_mixture(docs, labels, **options)
    drop(soft)
    whole = docs.select(F.struct(*docs.columns).alias("doc"), "text", F.col("doc_id").alias("id"))
    copies = _copies(F.col("soft.rate"), F.col("id"))
    times = _softened(whole, docs.sparkSession.sparkContext.broadcast(mixture)).select("doc", copies.alias("copies"))
    return times.select("doc", F.explode(F.expr("array_repeat(0, copies)"))).select("doc.*")
