"""Quality rules whose cutoffs come with an exact bound on false rejection.

Every rule rejects a document when a ratio of its text exceeds a cutoff. Cutoffs are chosen per stratum
(language) on labelled holdout documents: a cutoff is certified when the exact binomial upper bound on
the share of good documents it rejects is at most `false_rejection / number of rules`, at level
`level / (strata x rules x cutoffs)` (Bonferroni), so all chosen cutoffs hold together with probability
1 - level. Among the certified cutoffs of a rule the one that rejects the most bad less good documents
is taken; if none rejects more bad than good documents, the rule is off in that stratum.

Built-in functions only: text work stays inside the JVM, one narrow pass. The bounds are computed by stratum in Spark;
the driver sees nothing but the number of strata.

Defined cases: null text counts as no words; empty tables give empty results; a null stratum is a
stratum of its own (''); a document labelled more than once counts once, as good only if all its labels
are; repeated rows are judged one by one; further columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import SPACE, materialize

#: Fixed values of the base rules.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "[#*$%&|<>]"
#: Parts into which a stratum is dealt where its cutoffs are joined to it.
SALTS = 16


@dataclass(frozen=True)
class Risk:
    """false_rejection: share of good documents that all rules together may reject, per stratum; level: 1 - confidence."""

    false_rejection: float = 0.03
    level: float = 0.05
    #: ratio -> its candidate cutoffs, fixed before any data are seen
    cutoffs: dict[str, tuple[float, ...]] = field(
        default_factory=lambda: {
            "symbols_per_char": (0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02),
            "marks_per_word": (0.9, 0.7, 0.5, 0.35, 0.25, 0.15),
            "upper_share": (0.9, 0.7, 0.5, 0.35, 0.25),
            "dup_line_share": (0.8, 0.6, 0.45, 0.3, 0.2),
            "repeat_share": (0.5, 0.4, 0.3, 0.2, 0.15, 0.1),
            "chars_per_word": (30.0, 22.0, 17.0, 14.0, 12.0),
        }
    )


def text_features(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, lang and exact counts over the whole text; with carry the whole row too, as the struct doc."""
    t = F.coalesce(F.col("text"), F.lit(""))
    whole = [F.struct(*docs.columns).alias("doc")] if carry else []
    step = docs.select("doc_id", F.coalesce(F.col("lang"), F.lit("")).alias("lang"), t.alias("t"), *whole)
    step = step.withColumn("w", F.filter(F.split("t", f"{SPACE}+"), lambda x: x != ""))
    step = step.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    step = step.withColumn("n", F.size("w"))
    hashed = lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))
    step = step.withColumn("g", F.when(F.col("n") >= 3, F.transform(F.sequence(F.lit(0), F.col("n") - 3), hashed)).otherwise(F.expr("array(cast(null as bigint))")))
    # the windows found twice or more, in order of place; sorting is skipped where all are distinct
    pairs = F.array_sort(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = step.withColumn("s", F.when(F.size(F.array_distinct("g")) < F.size("g"), pairs))
    again = F.filter("s", lambda x, i: (F.get("s", i - 1)["h"].eqNullSafe(x["h"]) & (i > 0)) | F.get("s", i + 1)["h"].eqNullSafe(x["h"]))
    step = step.withColumn("p", F.array_sort(F.transform(again, lambda x: x["i"])))
    # each such window adds the words that lie before the next one, three at most
    covered = F.aggregate("p", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at")), lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["at"])).alias("n"), p.alias("at")), lambda a: a["n"])
    return step.select(
        "doc_id",
        "lang",
        F.col("n").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("t", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.char_length(F.regexp_replace("t", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.char_length(F.regexp_replace("t", "[^!?]+", "")).cast("long").alias("n_marks"),
        *(["doc"] if carry else []),
    )


def _ratios() -> dict[str, Column]:
    over = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return {
        "symbols_per_char": over("n_symbols", "word_chars"),
        "marks_per_word": over("n_marks", "n_words"),
        "upper_share": over("n_upper", "word_chars"),
        "dup_line_share": over("n_dup_lines", "n_lines"),
        "repeat_share": over("n_repeat_words", "n_words"),
        "chars_per_word": over("word_chars", "n_words"),
        "shortness": F.greatest(F.lit(0.0), 1 - F.col("n_words") / MIN_WORDS),
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def log_binomial_at_most(k: Column, n: Column, p: float) -> Column:
    """Exact ln P(X <= k) for X binomial(n, p): terms by their ratio, summed as logarithms.

    Beyond the mean the probability is at least a half, which meets no level: 0 is returned there.
    """
    odds = math.log(p) - math.log1p(-p)

    def add(a: Column, i: Column) -> Column:
        term = a["term"] + F.ln((n - i + 1) / i) + odds
        high = F.greatest(a["sum"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(F.least(a["sum"], term) - high))).alias("sum"))

    first = (n * math.log1p(-p)).cast("double")
    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.expr("cast(array() as array<bigint>)"))
    total = F.aggregate(terms, F.struct(first.alias("term"), first.alias("sum")), add, lambda a: a["sum"])
    return F.when(k > n * p + 1, F.lit(0.0)).otherwise(total)


#: The rules of the pipeline's stage, where a short or repetitive text is no failure in itself: its length and repeats are
#: certified like all else, so that the bound on false rejection covers every reason to reject.
CERTIFIED = Risk(cutoffs=Risk().cutoffs | {"repeat_share": (0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1), "shortness": (0.96, 0.9, 0.8, 0.6, 0.4, 0.2, 0.0)})


def choose_cutoffs(features: DataFrame, labels: DataFrame, risk: Risk, base: bool = True) -> DataFrame:
    """One row per stratum: lang and, by rule, its certified cutoff (null: off). labels: doc_id, quality (1 is good); null labels are left out."""
    ratios = {r: c for r, c in _ratios().items() if r in risk.cutoffs}
    held = labels.where("quality is not null").groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    judged = features.where(~base_failed()) if base else features
    rows = judged.select("doc_id", "lang", *[c.alias(k) for k, c in ratios.items()]).join(held, "doc_id")
    good, bad = F.col("good"), ~F.col("good")
    tries = [(r, i, c) for r, cuts in risk.cutoffs.items() for i, c in enumerate(cuts)]
    sums = [F.struct(F.lit(r).alias("rule"), F.lit(i).alias("i"), F.lit(c).alias("cutoff"), F.count_if(good & (F.col(r) > c)).alias("k"), F.count_if(bad & (F.col(r) > c)).alias("bad")) for r, i, c in tries]
    strata = materialize(rows.groupBy("lang").agg(F.count_if(good).alias("n"), F.array(*sums).alias("tries")), "strata")
    tests = strata.agg(F.count("*")).first()[0] * len(tries)
    if not tests:
        return strata.select("lang", *[F.lit(None).cast("double").alias(r) for r in risk.cutoffs])
    # the exact (Clopper-Pearson) upper bound is at most the allowed share; looked for only where it may matter
    tried = strata.select("lang", "n", F.inline("tries")).where("n > 0 and bad > k")
    sure = tried.where(F.ln(F.lit(risk.level / tests)) >= log_binomial_at_most(F.col("k"), F.col("n"), risk.false_rejection / len(risk.cutoffs)))
    best = sure.groupBy("lang", "rule").agg(F.min_by("cutoff", F.struct(F.col("k") - F.col("bad"), "i")).alias("cutoff"))
    return materialize(best.groupBy("lang").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(r) for r in risk.cutoffs]), "cutoffs")


def _judged(features: DataFrame, labels: DataFrame, risk: Risk, base: bool) -> DataFrame:
    """features with base_failed, failed_rule (the first, null if none) and kept.

    Cutoffs are a row a stratum. Salts deal a stratum of many documents over tasks where there are too many strata to broadcast.
    """
    cut = choose_cutoffs(features, labels, risk, base).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = F.struct(F.col("lang").alias("lang"), *[F.col(r).alias(r) for r in risk.cutoffs])
    cut = cut.select("lang", "salt", own.alias("cut"))
    rows = features.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(cut, ["lang", "salt"], "left")
    ratios = _ratios()
    failed = F.coalesce(*[F.when(ratios[r] > F.col("cut")[r], F.lit(r)) for r in sorted(risk.cutoffs)])
    reason = F.when(F.col("base_failed"), F.lit("base")).otherwise(failed) if base else failed
    return rows.withColumn("base_failed", base_failed()).withColumn("failed_rule", reason).withColumn("kept", F.col("failed_rule").isNull())


def quality_rules(docs: DataFrame, labels: DataFrame, risk: Risk | None = None) -> DataFrame:
    """doc_id, the counts, base_failed, kept, and the first failed rule (null if none)."""
    features = materialize(text_features(docs), "quality")
    return _judged(features, labels, risk or Risk(), True).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rule")


def keep_good(docs: DataFrame, labels: DataFrame, risk: Risk = CERTIFIED) -> DataFrame:
    """The rows of docs that no certified rule rejects (a null doc_id is judged like any other).

    Rows and counts are written in one pass, so that texts are neither counted twice nor shuffled.
    """
    features = materialize(text_features(docs, carry=True), "quality")
    return _judged(features, labels, risk, False).where("kept").select("doc.*")
