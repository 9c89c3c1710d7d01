"""Keys and passages that a third or more of all rows share, and tables with one label or many strata: whole results, against plain versions."""

import random

import numpy as np
import pytest


def test_passage_in_thousands_of_documents(spark):
    """A passage that two thirds of 6,000 documents hold links none of them; their copies and near copies are linked all the same."""
    from parlance.llm.jaccard import jaccard_components

    r = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = []
    for i in range(6000):
        own = " ".join(f"w{r.randrange(10**9)}" for _ in range(60))
        rows.append((i, f"{own[: len(own) // 2]} {passage} {own[len(own) // 2 :]}" if i % 3 else own))
    pairs = {}
    for k, i in enumerate(r.sample(range(6000), 300)):  # one word of a hundred changed, or none
        w = rows[i][1].split(" ")
        if k % 2:
            w[len(w) // 2] = "changed"
        rows.append((10_000 + k, " ".join(w)))
        pairs[10_000 + k] = i
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    got = {x["doc_id"]: x["component_id"] for x in jaccard_components(docs, 4, 85).collect()}
    assert got == {i: pairs.get(i, i) for i, _ in rows}


def test_one_url_of_most_pages(spark):
    """12,000 pages under one listed URL, beside listed hosts and pages that are on no list."""
    from parlance.llm.urls import filter_urls

    hot = "http://Hot.example.info/a/?utm_source=x"
    rows = [(i, hot) for i in range(12_000)] + [(20_000 + i, f"http://h{i}.example.info/{i}") for i in range(300)]
    listed = spark.createDataFrame([("url", "https://www.hot.example.info/a"), ("host", "h7.example.info"), *[("url", f"http://other{i}.info/x") for i in range(500)]], "kind string, value string")
    got = {r["page_id"]: (r["verdict"], r["listed"]) for r in filter_urls(spark.createDataFrame(rows, "page_id long, url string").repartition(8), listed).collect()}
    assert len(got) == 12_300 and {got[i] for i in range(12_000)} == {("block", True)}
    assert {i for i in range(20_000, 20_300) if got[i] == ("block", True)} == {20_007} and {got[i] for i in got if i >= 20_000} == {("block", True), ("allow", False)}


@pytest.mark.parametrize("label", [0, 1])
def test_toxicity_of_one_label(spark, label):
    """Labels that say the same of every row can't tell words apart: the weights stay those that the grammar begins with."""
    from pyspark.sql import functions as F

    from parlance.llm.toxicity import PRIOR, fit, score_toxicity

    docs = spark.createDataFrame([(i, f"you are a {'fool' if i % 2 else 'friend'} of number {i}") for i in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, label) for i in range(80)], "doc_id long, quality int, toxic int")
    got = score_toxicity(docs, labels, F.lit(False)).collect()
    assert len(got) == 80 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert (fit(docs, labels, F.lit(False)).weights == PRIOR).all()
    assert min(r["score"] for r in got if r["doc_id"] % 2) > max(r["score"] for r in got if r["doc_id"] % 2 == 0)


def test_links_of_embeddings_are_all_found(spark):
    """Equality with brute force, a third of the vectors being copies of one."""
    from parlance.llm.embeddings import near_duplicates

    r = np.random.default_rng(11)
    base = r.normal(size=(120, 16))
    x = np.concatenate([base, base[r.integers(0, 120, 500)] + r.normal(size=(500, 16)) * r.choice([0.02, 0.05, 0.08, 0.12], 500)[:, None], np.repeat(base[:1], 300, axis=0)])
    x = x.astype(np.float32).astype(np.float64)
    label = r.integers(0, 3, len(x))
    label[620:] = label[0]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T >= 0.98) & (label[:, None] == label[None, :])
    sure = np.abs(u @ u.T - 0.98).min() > 1e-9
    np.fill_diagonal(link, False)
    root = np.arange(len(x))
    while True:
        new = np.array([min(root[i], root[link[i]].min(initial=len(x))) for i in range(len(x))])
        if (new == root).all():
            break
        root = new
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], int(label[i])) for i in range(len(x))], "vec_id long, embedding array<double>, label int").repartition(7)
    got = {g["vec_id"]: (g["n_links"], g["component_id"]) for g in near_duplicates(df).collect()}
    assert sure and got == {i: (int(link[i].sum()), int(root[i])) for i in range(len(x))}


def test_strata_without_broadcasts(spark):
    """The same verdicts where Spark may broadcast nothing by itself."""
    from parlance.llm.quality import quality_rules

    r = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(70)) if i % 3 else " ".join(f"$$${j} !!!{r.random()}" for j in range(40)), f"lang{i // 3 % 3 if i % 100 else i}") for i in range(12_000)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0, 0) for i in range(12_000)], "doc_id long, quality int, toxic int")
    text = lambda: sorted(map(str, quality_rules(docs, labels).collect()))
    before, old = text(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert text() == before and any("kept=False" in x for x in before) and any("kept=True" in x for x in before)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
