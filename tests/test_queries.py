"""Every query with SQL gives the same rows in DuckDB."""

import math
import numbers

import duckdb
import numpy as np
import pandas as pd
import pytest

from parlance.plans.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    return c


def rows(df):
    def one(x):
        if x is None or x is pd.NA or isinstance(x, float) and math.isnan(x):
            return "null"
        if isinstance(x, numbers.Number) and not isinstance(x, (bool, np.bool_)):
            return repr(float(x))
        return str(list(x)) if hasattr(x, "__len__") and not isinstance(x, str) else str(x)

    return sorted(tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(SQL[name]).df())


# -- queries without SQL, against plain versions on one machine
def vectors(duck):
    t = duck.sql("select vec_id, label, embedding from embeddings order by vec_id").fetchall()
    x = np.array([r[2] for r in t], float)
    return [r[0] for r in t], [f"spk_{r[1]}" for r in t], x / np.linalg.norm(x, axis=1, keepdims=True)


def test_whitened_scores_equal_plain_ones(spark, duck):
    ids, who, x = vectors(duck)
    values, axes = np.linalg.eigh(np.cov(x, rowvar=False))
    w = (x - x.mean(0)) @ ((axes / np.sqrt(values)) @ axes.T)
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    got = {(r["seg_idx"], r["speaker"]): r["score"] for r in QUERIES["e15_whitened_scores"](spark, SF).collect()}
    for i in (0, 7, 100):
        for s in set(who):
            m = w[[j for j in range(len(ids)) if who[j] == s and j != i]].mean(0)
            assert abs(got[ids[i], s] - w[i] @ m / np.linalg.norm(m)) < 1e-6
    assert len(got) == len(ids) * len(set(who))


def test_smoothing_equals_plain_steps(spark, duck):
    from parlance.plans.sequence_queries import A

    rows = duck.sql(f"with {A.SEGMENTS} select session, seg_idx, start, \"end\", speaker from segments order by session, start, \"end\", seg_idx").fetchall()
    want, by = {}, {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    for session, part in by.items():
        who = [r[4] for r in part]
        for size in (2, 1):
            for i in range(1, len(part) - size):
                inner = range(i, i + size)
                left, right = who[i - 1], who[i + size]
                if left == right and left not in ("", "unknown", None) and all(who[j] != left and part[j][1] % 4 != 0 for j in inner) and sum(part[j][3] - part[j][2] for j in inner) <= 60 and all(part[j + 1][2] - part[j][3] <= 1e6 for j in range(i - 1, i + size)):
                    for j in inner:
                        who[j] = left
        want |= {(session, r[1]): w for r, w in zip(part, who, strict=True)}
    got = {(r["session"], r["seg_idx"]): r["smoothed"] for r in QUERIES["f6_smooth_flips"](spark, SF).collect()}
    assert got == want and any(got[k] != s for k, s in ((r[:2], r[4]) for r in rows))


def test_augmented_vectors_equal_plain_ones(spark, duck):
    from parlance.operators import augment

    got = {(r["row_id"], r["pass_index"]): (r["rms"], r["peak"]) for r in QUERIES["j14_augmented"](spark, SF).collect()}
    x = {i: np.array(v, np.float32) for i, v in duck.sql("select vec_id, embedding from embeddings").fetchall()}
    assert got.keys() == {(i, p) for i in x for p in range(3)}
    assert all(abs(got[i, 0][0] - augment.rms(x[i])) < 1e-5 and abs(got[i, 0][1] - np.abs(x[i]).max()) < 1e-5 for i in x)
    seeds = augment.augmented_passes(spark.createDataFrame([(int(i), 16000, v.tolist()) for i, v in x.items()], "row_id long, sample_rate int, samples array<float>"), ["row_id"], "heavy", 2)
    for r in seeds.where("pass_index = 2 and row_id % 9 = 0").collect():
        y = augment.augmented(x[r["row_id"]], 16000, r["seed"], "heavy")
        assert abs(got[r["row_id"], 2][0] - augment.rms(y)) < 2e-5 and abs(got[r["row_id"], 2][1] - np.abs(y).max()) < 2e-5


def test_every_query_is_tested():
    assert set(QUERIES) - set(SQL) == {"e15_whitened_scores", "j14_augmented", "j5_lda_knn", "j5_lda_logreg", "j5_logreg", "j5_logreg_unbalanced"}
