"""Trained classifiers of segment vectors: softmax regression, nearest neighbours, and both on discriminant axes; saved and read back as tables.

The regression is fitted by Spark's own L-BFGS over the rows; the discriminant axes come from sums of the vectors and of their outer products, which tasks add
up, so the driver sees one d x d problem however many rows there are. Scores are products of blocks of vectors with the weights.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.functions.vectors import doubles

MODELS = ("logreg", "logreg_unbalanced", "knn", "lda_knn", "lda_logreg")
_MODEL = "model string, labels array<string>, weights array<array<double>>, bias array<double>, mean array<double>, axes array<array<double>>, summary string"
_EXAMPLES = "entry_idx long, speaker string, embedding array<double>"


@dataclass
class Classifier:
    """labels in order; weights and bias of the regression; mean and axes of the projection; examples (entry_idx, speaker, embedding) of the neighbours."""

    model: str
    labels: list[str]
    weights: np.ndarray | None = None
    bias: np.ndarray | None = None
    mean: np.ndarray | None = None
    axes: np.ndarray | None = None
    examples: DataFrame | None = None
    summary: dict = field(default_factory=dict)

    @property
    def neighbours(self) -> int:
        return int(self.summary["model_params"]["n_neighbors"])


def scatter(rows: DataFrame, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, sum of vectors) of each class and the sum of outer products of all. rows: at (number of the class), x; vectors of one length."""

    def add(batches):
        import pandas as pd

        n, s, m = np.zeros(classes), None, 0.0
        for b in batches:
            if len(b):
                x = np.stack(b["x"].to_numpy())
                s = np.zeros((classes, x.shape[1])) if s is None else s
                np.add.at(n, b["at"].to_numpy(int), 1)
                np.add.at(s, b["at"].to_numpy(int), x)
                m = m + x.T @ x
        if s is not None:
            v = np.concatenate([n, s.ravel(), m.ravel()])
            yield pd.DataFrame({"i": np.arange(len(v)), "v": v})

    total = rows.select("at", "x").mapInPandas(add, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
    v = total.sort_values("i")["v"].to_numpy()
    d = int(round((-classes + (classes**2 + 4 * (len(v) - classes)) ** 0.5) / 2))
    return v[:classes], v[classes : classes * (1 + d)].reshape(classes, d), v[classes * (1 + d) :].reshape(d, d)


def discriminant_axes(n: np.ndarray, sums: np.ndarray, outer: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, axes): x -> (x - mean) @ axes makes the classes' common covariance the unit matrix, the axes in order of how far they part the classes' means."""
    rows, k = n.sum(), len(n)
    means = sums / n[:, None]
    mean = sums.sum(0) / rows
    within = outer - (means * n[:, None]).T @ means
    spread = np.sqrt(np.maximum(np.diag(within) / rows, 0))
    spread[spread < 1e-12] = 1.0
    values, vectors = np.linalg.eigh(within / np.outer(spread, spread) / max(rows - k, 1))
    keep = values > max(values.max() * 1e-10, 1e-20)
    white = (vectors[:, keep] / spread[:, None]) / np.sqrt(values[keep])
    between = (np.sqrt(n / max(k - 1, 1))[:, None] * (means - mean)) @ white
    _, s, axes = np.linalg.svd(between, full_matrices=False)
    rank = int((s > 1e-4 * s[0]).sum()) if len(s) and s[0] > 0 else 0
    return mean, white @ axes[: max(1, min(most, rank))].T


def projected(df: DataFrame, mean: np.ndarray, axes: np.ndarray, vector: str = "embedding") -> DataFrame:
    """df with the vector replaced by its coordinates on the axes."""

    @F.pandas_udf("array<double>")
    def turn(x):
        import pandas as pd

        return pd.Series(list((np.stack(x.to_numpy()) - mean) @ axes), index=x.index) if len(x) else x

    return df.withColumn(vector, turn(doubles(F.col(vector))))


def _regression(rows: DataFrame, labels: list[str], balanced: bool, c: float, max_iter: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) that minimise |W|^2 / 2 + c * sum of weighted log losses. rows: at, x."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    counts = {r["at"]: r["n"] for r in rows.groupBy("at").agg(F.count("*").alias("n")).collect()}  # a row a speaker
    n = sum(counts.values())
    weight: Column = F.lit(1.0)
    if balanced:
        weight = F.element_at(F.array(*[F.lit(n / (len(labels) * counts[i])) for i in range(len(labels))]), F.col("at") + 1)
    ready = rows.select(F.col("at").cast("double").alias("label"), array_to_vector("x").alias("features"), weight.alias("weight"))
    lr = LogisticRegression(maxIter=max_iter, tol=1e-12, regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, weightCol="weight")
    model = lr.fit(ready)
    w, b = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    if len(labels) == 2:  # one row of weights: the second label against the first
        w, b = np.vstack([np.zeros_like(w[0]), w[0]]), np.array([0.0, b[0]])
    return w, b


def fit(rows: DataFrame, model: str = "logreg", c: float = 1.0, n_neighbors: int = 7, max_iter: int = 5000) -> Classifier:
    """A classifier of rows (label, embedding; entry_idx too for neighbours). Rows without label or vector are left out; the vectors are taken as they are.

    The vectors must have one length, and a regression needs two labels.
    """
    if model not in MODELS:
        raise ValueError(f"no model {model!r}, but {', '.join(MODELS)}")
    from parlance.tables import materialize

    entry = F.col("entry_idx") if "entry_idx" in rows.columns else F.monotonically_increasing_id()
    rows = materialize(rows.where("label is not null and embedding is not null").select(entry.cast("long").alias("entry_idx"), "label", doubles(F.col("embedding")).alias("x")), "labelled")
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    labels = sorted(counts)
    sizes = [r[0] for r in rows.select(F.size("x")).distinct().limit(2).collect()]
    if len(sizes) != 1:
        raise ValueError("a classifier needs vectors of one length")
    if len(labels) < 2 and model != "knn":
        raise ValueError("a classifier needs at least two labels")
    number = F.create_map(*[F.lit(v) for i, x in enumerate(labels) for v in (x, i)])[F.col("label")]
    rows = rows.withColumn("at", number)
    out = Classifier(model, labels, summary={"model_name": model, "model_params": {"c": c, "n_neighbors": n_neighbors, "max_iter": max_iter}, "samples": sum(counts.values()), "dimensions": sizes[0], "speakers": counts})
    if model.startswith("lda"):
        out.mean, out.axes = discriminant_axes(*scatter(rows, len(labels)), max(1, min(len(labels) - 1, sizes[0] - 1)))
        rows = materialize(projected(rows, out.mean, out.axes, "x"), "projected")
        out.summary["model_params"]["projected_dimensions"] = out.axes.shape[1]
    if model.endswith("knn"):
        out.examples = rows.select("entry_idx", F.col("label").alias("speaker"), F.col("x").alias("embedding"))
    else:
        out.weights, out.bias = _regression(rows, labels, model != "logreg_unbalanced", c, max_iter)
    return out


def score(fitted: Classifier, segments: DataFrame) -> DataFrame:
    """session, seg_idx, rank, speaker, score, the first name on ties: every label with its probability, or those among the nearest entries. segments: session, seg_idx, embedding."""
    from parlance.operators.bank import knn_votes

    rows = segments.where("embedding is not null").select("session", "seg_idx", doubles(F.col("embedding")).alias("embedding"))
    if fitted.axes is not None:
        rows = projected(rows, fitted.mean, fitted.axes)
    if fitted.examples is not None:
        found = knn_votes(rows, fitted.examples, fitted.neighbours).withColumnRenamed("probability", "score")
    else:
        w, b = fitted.weights, fitted.bias

        @F.pandas_udf("array<double>")
        def chances(x):
            import pandas as pd

            if not len(x):
                return x
            z = np.stack(x.to_numpy()) @ w.T + b
            z = np.exp(z - z.max(1, keepdims=True))
            return pd.Series(list(z / z.sum(1, keepdims=True)), index=x.index)

        each = rows.select("session", "seg_idx", F.posexplode(chances("embedding")).alias("at", "score"))
        found = each.withColumn("speaker", F.element_at(F.array(*map(F.lit, fitted.labels)), F.col("at") + 1)).drop("at")
    rank = F.row_number().over(Window.partitionBy("session", "seg_idx").orderBy(F.desc("score"), "speaker"))
    return found.select("session", "seg_idx", rank.cast("long").alias("rank"), "speaker", "score")


def predict(fitted: Classifier, segments: DataFrame, confidence: float = 0.0, margin: float = 0.0) -> DataFrame:
    """session, seg_idx, speaker, score, margin, second, matched: the best label if it meets both bars."""
    from parlance.operators.bank import accepted

    return accepted(score(fitted, segments), confidence, margin)


def train_accuracy(fitted: Classifier, rows: DataFrame) -> float:
    """Share of rows (label, embedding, entry_idx) whose best label is theirs."""
    asked = rows.where("label is not null and embedding is not null").select(F.lit(0).alias("session"), F.col("entry_idx").alias("seg_idx"), "embedding", "label")
    best = score(fitted, asked).where("rank = 1").select("seg_idx", "speaker")
    return asked.join(best, "seg_idx", "left").agg(F.avg(F.coalesce(F.col("speaker") == F.col("label"), F.lit(False)).cast("int"))).first()[0] or 0.0


def save_classifier(fitted: Classifier, spark: SparkSession, path: str) -> None:
    """The model as one row, and its examples as a table, in place of what path holds."""
    from parlance.tables import replace

    flat = lambda a: None if a is None else a.tolist()
    row = (fitted.model, fitted.labels, flat(fitted.weights), flat(fitted.bias), flat(fitted.mean), flat(fitted.axes), json.dumps(fitted.summary, sort_keys=True))

    def write(folder: str) -> None:
        spark.createDataFrame([row], _MODEL).coalesce(1).write.parquet(f"{folder}/model")
        if fitted.examples is not None:
            fitted.examples.write.parquet(f"{folder}/examples")

    replace(spark, path, write)


def load_classifier(spark: SparkSession, path: str) -> Classifier | None:
    """The classifier at path; None where there is none."""
    from parlance.sources.readers import missing

    try:
        r = spark.read.schema(_MODEL).parquet(f"{path}/model").first()
    except Exception as e:
        if missing(e):
            return None
        raise
    array = lambda x: None if x is None else np.array(x, np.float64)
    examples = spark.read.schema(_EXAMPLES).parquet(f"{path}/examples") if r["model"].endswith("knn") else None
    return Classifier(r["model"], list(r["labels"]), array(r["weights"]), array(r["bias"]), array(r["mean"]), array(r["axes"]), examples, json.loads(r["summary"]))


def train_from_bank(bank: DataFrame, aliases: DataFrame, spark: SparkSession, path: str, most: int = 500, **options) -> Classifier:
    """Fit to at most `most` entries a speaker of the bank (bank_samples()), save at path, and return it with its accuracy in the summary."""
    from parlance.operators.datasets import bank_samples

    rows = bank_samples(bank, aliases, most).select("entry_idx", "label").join(bank.select("entry_idx", "embedding"), "entry_idx")
    return train_from_dataset(rows, spark, path, source="bank", **options)


def train_from_dataset(dataset: DataFrame, spark: SparkSession, path: str, source: str = "dataset", keep: Callable[[DataFrame], DataFrame] = lambda d: d, **options) -> Classifier:
    """Fit to keep(dataset) (entry_idx, label, embedding), save at path, and return it with its accuracy in the summary."""
    rows = keep(dataset)
    fitted = fit(rows, **options)
    fitted.summary |= {"source": source, "train_accuracy": train_accuracy(fitted, rows)}
    save_classifier(fitted, spark, path)
    return fitted
