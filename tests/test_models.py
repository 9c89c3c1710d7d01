"""Trained classifiers and sweeps against plain solvers on one machine."""

import itertools

import numpy as np
import pytest

from parlance.operators import classifier as C
from parlance.operators import sweeps as W

ROWS = "entry_idx long, label string, embedding array<double>"


def voices(n=240, seed=2, d=6):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(4, d))
    who = r.choice(4, n, p=[0.6, 0.2, 0.15, 0.05])
    x = middle[who] + r.normal(size=(n, d)) * 0.7
    return x / np.linalg.norm(x, axis=1, keepdims=True), who


def frame(spark, x, who, names="DACB"):
    return spark.createDataFrame([(i, names[w], v.tolist()) for i, (v, w) in enumerate(zip(x, who, strict=True))], ROWS).repartition(5)


def plain_softmax(x, y, k, c, weight):
    """Newton's steps on |W|^2 / 2 + c * sum of weighted log losses, the bias free but for its common shift."""
    n, d = x.shape
    z = np.hstack([x, np.ones((n, 1))])
    theta, pen = np.zeros((k, d + 1)), np.append(np.ones(d), 0.0)
    hot = np.eye(k)[y]
    for _ in range(100):
        s = z @ theta.T
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = c * ((p - hot) * weight[:, None]).T @ z + theta * pen
        h = np.zeros((k * (d + 1),) * 2)
        for a in range(k):
            for b in range(k):
                m = c * weight * (p[:, a] * ((a == b) - p[:, b]))
                h[a * (d + 1) : (a + 1) * (d + 1), b * (d + 1) : (b + 1) * (d + 1)] = (z * m[:, None]).T @ z + (a == b) * np.diag(pen)
        step = np.linalg.lstsq(h, g.ravel(), rcond=1e-13)[0].reshape(k, d + 1)
        theta -= step
        if np.abs(step).max() < 1e-12:
            break
    s = z @ theta.T
    p = np.exp(s - s.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def probabilities(spark, fitted, x):
    asked = spark.createDataFrame([("s", i, v.tolist()) for i, v in enumerate(x)], "session string, seg_idx long, embedding array<double>")
    out = np.zeros((len(x), len(fitted.labels)))
    for r in C.score(fitted, asked).collect():
        out[r["seg_idx"], fitted.labels.index(r["speaker"])] = r["score"]
    return out


@pytest.mark.parametrize("model", ["logreg", "logreg_unbalanced", "lda_logreg"])
def test_regression_equals_a_plain_solver(spark, model):
    x, who = voices()
    names = "DACB"
    fitted = C.fit(frame(spark, x, who), model, c=4.0)
    assert fitted.labels == ["A", "B", "C", "D"]
    y = np.array(["ABCD".index(names[w]) for w in who])
    weight = np.ones(len(y)) if model == "logreg_unbalanced" else (len(y) / (4 * np.bincount(y)))[y]
    z = x if fitted.axes is None else (x - fitted.mean) @ fitted.axes
    want = plain_softmax(z, y, 4, 4.0, weight)
    assert np.abs(probabilities(spark, fitted, x) - want).max() < 1e-6


def test_two_labels(spark):
    x, who = voices(120, 5)
    who = np.minimum(who, 1)
    fitted = C.fit(frame(spark, x, who, "ab"), "logreg", c=2.0)
    w = (len(who) / (2 * np.bincount(who)))[who]
    # one row of weights: half the penalty of two rows that mirror each other, so c counts twice
    theta = np.zeros(x.shape[1] + 1)
    z = np.hstack([x, np.ones((len(x), 1))])
    pen = np.append(np.ones(x.shape[1]), 0.0)
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ theta))
        theta -= np.linalg.solve((z * (2.0 * w * p * (1 - p))[:, None]).T @ z + np.diag(pen), 2.0 * z.T @ (w * (p - who)) + pen * theta)
    assert np.abs(probabilities(spark, fitted, x)[:, 1] - 1 / (1 + np.exp(-z @ theta))).max() < 1e-6


def test_axes_equal_those_of_the_whole_matrix(spark):
    x, who = voices()
    fitted = C.fit(frame(spark, x, who), "lda_knn", n_neighbors=5)
    z = (x - fitted.mean) @ fitted.axes
    names = np.array(["DACB"[w] for w in who])
    centred = np.concatenate([z[names == s] - z[names == s].mean(0) for s in "ABCD"])
    assert np.allclose(centred.T @ centred / (len(x) - 4), np.eye(3), atol=1e-8)
    # the generalised eigenproblem, solved at once
    means = {s: x[names == s].mean(0) for s in "ABCD"}
    within = sum((x[names == s] - means[s]).T @ (x[names == s] - means[s]) for s in "ABCD")
    between = sum((names == s).sum() * np.outer(means[s] - x.mean(0), means[s] - x.mean(0)) for s in "ABCD")
    values, vectors = np.linalg.eig(np.linalg.solve(within, between))
    for i, j in enumerate(np.argsort(-values.real)[:3]):
        a, b = fitted.axes[:, i], vectors[:, j].real
        assert abs(abs(a @ b) / np.linalg.norm(a) / np.linalg.norm(b) - 1) < 1e-8
    # votes of the nearest entries on the axes, itself left out
    u = z / np.linalg.norm(z, axis=1, keepdims=True)
    asked = frame(spark, x, who).selectExpr("'s' as session", "entry_idx as seg_idx", "embedding")
    got = {(r["seg_idx"], r["speaker"]): r["score"] for r in C.score(fitted, asked).collect()}
    for i in range(0, len(x), 17):
        near = [j for j in np.argsort(-(u @ u[i]), kind="stable") if j != i][:5]
        vote = {s: sum(1 / max(1 - u[j] @ u[i], 1e-6) for j in near if names[j] == s) for s in set(names[near])}
        assert all(abs(got[i, s] - v / sum(vote.values())) < 1e-6 for s, v in vote.items())


@pytest.mark.parametrize("model", ["logreg", "knn", "lda_knn", "lda_logreg"])
def test_saved_and_read_back(spark, tmp_path, model):
    x, who = voices(80, 7)
    path = f"file://{tmp_path}/model"
    assert C.load_classifier(spark, path) is None
    rows = frame(spark, x, who)
    bank = rows.selectExpr("entry_idx", "label as speaker", "embedding")
    aliases = spark.createDataFrame([("a", "D")], "key string, value string")
    fitted = C.train_from_bank(bank, aliases, spark, path, 30, model=model)
    C.train_from_bank(bank, aliases, spark, path, 30, model=model)  # in place of the first
    again = C.load_classifier(spark, path)
    assert again.labels == fitted.labels == ["B", "C", "D"] and again.summary == fitted.summary and again.summary["speakers"]["D"] <= 30 and again.summary["train_accuracy"] > 0.5
    assert np.allclose(probabilities(spark, again, x[:20]), probabilities(spark, fitted, x[:20]))
    sure = C.predict(again, rows.selectExpr("'s' as session", "entry_idx as seg_idx", "embedding"), 0.6, 0.3).collect()
    assert len(sure) == 80 and all(r["matched"] == (r["score"] >= 0.6 and r["margin"] >= 0.3) for r in sure)


def test_what_cannot_be_trained(spark):
    x, who = voices(20)
    with pytest.raises(ValueError, match="two labels"):
        C.fit(frame(spark, x, who * 0), "logreg")
    with pytest.raises(ValueError, match="one length"):
        C.fit(spark.createDataFrame([(0, "A", [1.0]), (1, "B", [1.0, 2.0])], ROWS))
    with pytest.raises(ValueError, match="no model"):
        C.fit(frame(spark, x, who), "forest")


def test_grid_equals_each_point_by_itself(spark):
    r = np.random.default_rng(9)
    truth = [(f"s{i % 3}", f"L{i % 5}", i, "ABC"[r.integers(3)]) for i in range(200)]
    cand = []
    for s, lab, i, _ in truth:
        for p in ("one", "two"):
            if r.random() < 0.9:
                scores = sorted(r.random(3).round(2), reverse=True)
                cand += [(p, s, lab, i, k + 1, n, float(v)) for k, (n, v) in enumerate(zip(r.permutation(list("ABC")), scores, strict=True))]
    df = spark.createDataFrame
    c = df(cand, "profile string, session string, label string, seg_idx long, rank long, speaker string, score double")
    t = df(truth, "session string, label string, seg_idx long, actual string")
    grid = W.Grid((0.5, 0.2, 0.9), (0.0, 0.25), (1, 13, 14))
    got = {(x["profile"], x["threshold"], x["margin"], x["least"]): (x["segments"], x["taken"], x["right"]) for x in W.grid_scores(W.graded(c, t, ["one", "two"]), grid).collect()}
    assert len(got) == 2 * 18
    for p, th, m, n in itertools.product(("one", "two"), grid.thresholds, grid.margins, grid.least):
        own, lab = {}, {}
        for q, s, lb, i, k, who, v in cand:
            if q == p:
                own.setdefault(i, []).append((v, who))
                lab.setdefault((s, lb), {}).setdefault(i, []).append((who, v))
        taken = right = 0
        for s, lb, i, actual in truth:
            who = None
            if i in own and own[i][0][0] >= th and own[i][0][0] - own[i][1][0] >= m:
                who = own[i][0][1]
            else:
                each = lab.get((s, lb), {})
                means = sorted(((sum(v for rows in each.values() for w, v in rows if w == x) / len(each), x) for x in "ABC"), key=lambda z: (-z[0], z[1])) if each else []
                if each and len(each) >= n and means[0][0] >= th and means[0][0] - means[1][0] >= m:
                    who = means[0][1]
            taken += who is not None
            right += who == actual
        assert got[p, th, m, n] == (200, taken, right), (p, th, m, n)


def test_from_tracks_to_a_classifier(spark, tmp_path):
    """Segments of speakers with a track are cut, embedded by a stub, balanced and learned from; held-out sessions never come near."""
    from parlance.operators import training

    rows = [("s1" if i % 3 else "s2", i, 10.0 * i, 10.0 * i + (0.5 if i % 10 == 0 else 4.0 + i % 5), "ABX"[i % 3 if i % 7 else 0]) for i in range(90)] + [("held", 200 + i, 0.0, 5.0, "A") for i in range(5)]
    records = spark.createDataFrame(rows, "session string, seg_idx long, start double, end double, speaker string")
    stems = spark.createDataFrame([("A", 1.0), ("B", -1.0)], "speaker string, side double")
    holdout = spark.createDataFrame([("held",)], "session string")

    def embed(batches):
        for b in batches:
            yield b.assign(embedding=[[s, 0.01 * (t % 7)] for s, t in zip(b["side"], b["start"], strict=True)])

    path = f"file://{tmp_path}/model"
    fitted, data = training.train_from_tracks(records, stems, embed, path, holdout, targets=["A", "B"], cap=10, dataset_options={"least": 1.0, "size": 2.0, "stride": 2.0})
    got = data.collect()
    assert {r["label"] for r in got} == {"A", "B"} and sum(r["label"] == "A" for r in got) == sum(r["label"] == "B" for r in got) == 10
    assert all(r["session"] != "held" and r["duration"] >= 1.0 - 1e-9 and r["source"] == "multitrack" for r in got) and len({r["row_id"] for r in got}) == 20
    assert fitted.summary["train_accuracy"] == 1.0 and C.load_classifier(spark, path).summary == fitted.summary
    more = spark.createDataFrame([(1, "C", "held", [0.0, 1.0]), (2, "C", "s9", [0.0, 1.0])], "row_id long, label string, session string, embedding array<double>")
    fitted, data = training.train_from_tracks(records, stems, embed, path, holdout, more, model="knn", dataset_options={"least": 1.0})
    assert fitted.labels == ["A", "B", "C"] and [r["session"] for r in data.where("label = 'C'").collect()] == ["s9"]
