"""A baseline's training material as cached stages: what changed is made anew, with all that hangs on it, and nothing else."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators import datasets as D
from parlance.operators import evidence as V
from parlance.operators.stages import Stage, run_stages

#: Settings of the stages; any of them may be given anew.
DEFAULTS = {
    "filter": {"speakers": None, "sources": None, "share": 0.8, "active": 2, "least": 0.8, "most": 15.0},
    "balance": {"targets": [], "cap": 500},
    "coverage": {"sessions": 3, "ratio": 0.5},
    "passes": 1,
    "bank": {"most": 500},
}


def _rejection(c: dict):
    return D.dataset_rejection(c["speakers"], c["sources"], c["share"], c["active"], c["least"], c["most"])


def baseline_stages(config: dict | None = None) -> list[Stage]:
    """The stages over the sources dataset (row_id, label, domain, source, session, duration, dominant_share, active_speakers), bank, aliases and holdout (session)."""
    c = {**DEFAULTS, **(config or {})}
    c = {k: {**DEFAULTS[k], **v} if isinstance(v, dict) else v for k, v in c.items()}

    def kept(t, f):
        rows = t["dataset"].where(_rejection(f).isNull())
        D.assert_disjoint(rows, t["holdout"])
        return rows

    count = lambda t, f: t["dataset"].select(F.coalesce(_rejection(f), F.lit("kept")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    samples = lambda t, f: D.bank_samples(t["bank"], t["aliases"], f["most"]).select(F.col("entry_idx").alias("row_id"), "label", F.lit("bank").alias("source"))
    return [
        Stage("rejections", ("dataset",), count, c["filter"]),
        Stage("filtered", ("dataset", "holdout"), kept, c["filter"]),
        Stage("bank_samples", ("bank", "aliases"), samples, c["bank"]),
        Stage("balanced", ("filtered",), lambda t, f: D.balanced(t["filtered"], f["targets"], f["cap"]), c["balance"]),
        Stage("coverage", ("filtered",), lambda t, f: D.coverage(t["filtered"], f["sessions"], f["ratio"]), c["coverage"]),
        Stage("breakdown", ("balanced",), lambda t, f: D.breakdown(t["balanced"]), {}),
        Stage("training", ("balanced", "bank_samples"), lambda t, f: V.passes(t["balanced"].select("row_id", "label", "source"), f["passes"]).unionByName(V.passes(t["bank_samples"], 1)), {"passes": c["passes"]}),
    ]


def prepare_baseline(spark: SparkSession, folder: str, sources: dict[str, tuple[DataFrame, str]], config: dict | None = None, progress=None, force: tuple[str, ...] = ()) -> tuple[dict[str, DataFrame], list[str]]:
    """(tables by name, stages that were built) below folder. sources: dataset, bank, aliases and holdout with their signatures. Held-out sessions in what is kept are an error."""
    return run_stages(spark, folder, baseline_stages(config), sources, progress, force)


def stage_sizes(tables: dict[str, DataFrame], names: list[str]) -> DataFrame:
    """stage, n: the rows of each stage's table."""
    parts = [tables[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("stage"), "n") for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
