"""Small scenarios with known results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators import attribution, bank, datasets, graph, intervals, names, sequences


def test_word_alignment(spark):
    kind = "session string, seg_idx long, word_idx long, start double, end double, speaker string"
    ref = spark.createDataFrame([("s", 0, 0, 0.0, 0.4, "Alice"), ("s", 0, 1, 0.5, 0.9, "Alice"), ("s", 0, 2, 1.0, 1.4, "Bob")], kind)
    pred = spark.createDataFrame([("s", 0, 0, 0.0, 0.4, "Alice"), ("s", 0, 1, 0.5, 0.9, "Carol"), ("s", 0, 2, 1.0, 1.4, "Bob")], kind)
    got = {r["word_idx"]: r["predicted"] for r in intervals.nearest_words(ref, pred, 0.2).collect()}
    assert got == {0: "Alice", 1: "Carol", 2: "Bob"}


def test_words_without_overlap_take_the_nearest_turn(spark):
    words = spark.createDataFrame([("s", 0, 0, 5.0, 5.2), ("s", 0, 1, 9.0, 9.2), ("s", 0, 2, 100.0, 100.5)], "session string, seg_idx long, word_idx long, start double, end double")
    turns = spark.createDataFrame([("s", 0, 0.0, 4.0, "A"), ("s", 1, 8.0, 10.0, "B")], "session string, turn_idx long, start double, end double, speaker string")
    got = {r["word_idx"]: r["turn_speaker"] for r in intervals.label_by_overlap(words, turns).collect()}
    assert got == {0: "A", 1: "B", 2: "B"}


def test_training_windows(spark):
    s = spark.createDataFrame([("f", 0, 0.0, 25.0, "A")], "session string, seg_idx long, start double, end double, speaker string")
    got = sorted((r["start"], r["end"]) for r in sequences.training_windows(s, 5.0, 12.0, 10.0, 7.5).collect())
    assert got[0][0] == 0.0 and got[-1][1] == 25.0 and len(got) == 3


def test_greedy_windows_do_not_overlap(spark):
    w = spark.createDataFrame([("s", 0.0, 60.0, 5.0, 2, 1), ("s", 30.0, 90.0, 9.0, 2, 1), ("s", 90.0, 150.0, 4.0, 2, 1)], "session string, start double, end double, score double, speaker_count long, speaker_turns long")
    assert [(r["rank"], r["start"]) for r in sequences.greedy_windows(w, 3).orderBy("rank").collect()] == [(1, 30.0), (2, 90.0)]


def test_smoothing(spark):
    kind = "session string, seg_idx long, start double, end double, speaker string, score double"
    rows = [("s", 0, 0.0, 2.0, "Alice", 0.9), ("s", 1, 2.0, 2.2, "Bob", 0.3), ("s", 2, 2.2, 4.0, "Alice", 0.9)]
    out = lambda r: [x["smoothed"] for x in attribution.smooth_flips(spark.createDataFrame(r, kind), 2, 2.0, 0.75, 0.4).orderBy("seg_idx").collect()]
    assert out(rows) == ["Alice"] * 3
    rows[1] = ("s", 1, 2.0, 2.2, "Bob", 0.6)
    assert out(rows) == ["Alice", "Bob", "Alice"]


def test_bank_match_and_whitening(spark):
    b = spark.createDataFrame([(0, "A", [1.0, 0.0, 0.0])], "entry_idx long, speaker string, embedding array<double>")
    q = spark.createDataFrame([("s", 0, [0.8, 0.6, 0.0]), ("s", 1, [0.0, 0.0, 0.0])], "session string, seg_idx long, embedding array<double>")
    got = bank.accepted(bank.bank_scores(q, bank.clusters_by_speaker(b)), 0.7, 0.0).collect()
    assert len(got) == 1 and got[0]["matched"] and abs(got[0]["score"] - 0.8) < 1e-12
    r = np.random.default_rng(0)
    x = r.normal(size=(200, 3)) * [5.0, 1.0, 0.2]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, "A", v.tolist()) for i, v in enumerate(x)], "entry_idx long, speaker string, embedding array<double>")
    mean, matrix = bank.whitening(df)
    assert np.allclose(np.cov((x - mean) @ matrix, rowvar=False), np.eye(3), atol=1e-6)


def test_whitened_vectors_are_written_once(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(60, 3)) * [5.0, 1.0, 0.2]
    odd = [(60, "A", None), (61, "B", [0.0, 0.0, 0.0]), (62, "B", [1.0, float("nan"), 0.0]), (63, None, [float("inf"), 0.0, 1.0])]
    df = spark.createDataFrame([(i, "AB"[i % 2], v.tolist()) for i, v in enumerate(x)] + odd, "entry_idx long, speaker string, embedding array<double>").repartition(3)
    mean, matrix = bank.whitening(df)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert np.allclose(mean, unit.mean(0)) and np.allclose(np.cov((unit - mean) @ matrix, rowvar=False), np.eye(3), atol=1e-6)
    white = bank.whitened(df, mean, matrix)
    # whoever reads it reads a table: no task has a worker for it beside its own
    assert "MapIn" not in white._jdf.queryExecution().toString() and white.columns == df.columns
    got = {t["entry_idx"]: t for t in white.collect()}
    want = (unit - mean) @ matrix
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    assert len(got) == 64 and all(np.allclose(got[i]["embedding"], want[i]) and got[i]["speaker"] == "AB"[i % 2] for i in range(60))
    assert all(got[i]["embedding"] is None and got[i]["speaker"] == who for i, who, _ in odd)
    assert {t["speaker"]: t["members"] for t in bank.clusters_by_speaker(white).collect()} == {"A": 30, "B": 30}
    assert bank.whitened(df.where("entry_idx = 60"), mean, matrix).collect()[0]["embedding"] is None


def test_vectors_come_in_short_runs(monkeypatch):
    import pyarrow as pa

    from parlance.functions import vectors

    monkeypatch.setattr(vectors, "PART_VALUES", 7)
    rows = [[float(i), 1.0] if i % 4 else None for i in range(10)]
    parts = list(vectors.vector_parts(pa.array([[9.0, 9.0], *rows], pa.list_(pa.float32())).slice(1)))
    assert [(at, len(part)) for at, part, _ in parts] == [(0, 3), (3, 3), (6, 3), (9, 1)]
    assert np.concatenate([x for _, _, x in parts]).tolist() == [v for v in rows if v] and all(x.dtype == float for _, _, x in parts)
    assert [x.shape for _, _, x in vectors.vector_parts(pa.array([None, None], pa.list_(pa.float64())))] == [(0, 0)]
    assert not list(vectors.vector_parts(pa.array([], pa.list_(pa.float64()))))
    with pytest.raises(ValueError, match="components"):
        list(vectors.vector_parts(pa.array([[1.0], [1.0, 2.0]])))


def test_label_mean_dilutes_rare_support(spark):
    rows = [("s", "L", i, 1, "A", 0.9) for i in range(2)] + [("s", "L", i, 1, "B", 0.61) for i in range(2, 6)]
    c = spark.createDataFrame(rows, "session string, label string, seg_idx long, rank long, speaker string, score double")
    got = attribution.label_speakers(c, 0.3, 0.03, 3).collect()[0]
    assert got["speaker"] == "B" and got["selected"] and got["score_max"] == 0.61


def test_propagation(spark):
    e = spark.createDataFrame([("s", 0, 1, 1.0), ("s", 1, 0, 1.0), ("s", 1, 2, 0.1), ("s", 2, 1, 0.1)], "session string, src long, dst long, w double")
    y = spark.createDataFrame([("s", 0, "A"), ("s", 2, "B")], "session string, node long, label string")
    got = {r["node"]: r["label"] for r in graph.best_labels(graph.propagate(e, y, alpha=0.6)).collect()}
    assert got == {0: "A", 1: "A", 2: "B"}


def test_names(spark):
    m = spark.createDataFrame([(1, "kinglizard7958_0", "King"), (2, "a", "No")], "ord int, key string, value string")
    f = spark.createDataFrame([(1, "6-kinglizard7958.ogg"), (2, "9.flac")], "id long, name string")
    assert {r["id"]: r["speaker"] for r in names.choose_speaker(f, "id", "name", m).collect()} == {1: "King", 2: "9"}


def test_clocks_and_lines(spark):
    line = T.transcript_line
    r = spark.range(1).select(T.srt_clock(F.lit(1.0005)).alias("a"), T.clock(F.lit(360000.9)).alias("b"), line(F.lit("Dungeon Master 00:00:10 hello there")).alias("c"), line(F.lit("0:01:02 : Ann : hi")).alias("d")).first()
    assert (r["a"], r["b"]) == ("00:00:01,000", "100:00:00")
    assert (r["c"]["speaker"], r["c"]["start"], r["d"]["speaker"], r["d"]["start"]) == ("Dungeon Master", 10.0, "Ann", 62.0)


def test_quality_reasons(spark):
    rows = [(1, True, True, 1.0, 0.9, 0.0), (2, True, True, 1.0, 0.0, 0.95), (3, True, False, 1.0, 0.0, 0.0), (4, True, True, 1.0, 0.0, 0.0)]
    d = spark.createDataFrame(rows, "id int, decode_ok boolean, finite_ok boolean, duration double, clipping_fraction double, silence_fraction double")
    assert [r[0] for r in d.orderBy("id").select(datasets.quality_rejection()).collect()] == ["clipping", "silence", "non_finite", None]


def test_whole_bank_scores_leave_the_vector_out(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(14, 4)) + 1
    who = ["a"] * 8 + ["b"] * 5 + ["c"]
    rows = [(0, i, who[i], v.tolist()) for i, v in enumerate(x)]
    q = spark.createDataFrame(rows, "session long, seg_idx long, own string, embedding array<double>")
    b = q.select(F.col("seg_idx").alias("entry_idx"), F.col("own").alias("speaker"), "embedding")
    got = {(s["seg_idx"], s["speaker"]): s["score"] for s in bank.bank_scores(q, bank.clusters_by_speaker(b), 1e9).collect()}
    v = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {}
    for i in range(14):
        for s in "abc":
            rest = [j for j in range(14) if who[j] == s and j != i]
            if rest:
                want[i, s] = v[i] @ (m := v[rest].mean(0)) / np.linalg.norm(m)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_bank_queries_without_sql_take_all_vectors(spark):
    from parlance.plans.catalog import QUERIES

    sf = "/root/testdata/sf0.001"
    ids = {r[0] for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect()}
    for name, key in (("e15_whitened_scores", "seg_idx"), ("e20_density_clusters", "entry_idx"), ("j5_knn_classifier", "seg_idx"), ("j3_graph_overrides", "seg_idx")):
        assert {r[0] for r in QUERIES[name](spark, sf).select(key).collect()} == ids, name


def test_nearest_entries_in_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(bank, "BLOCK", 16)
    r = np.random.default_rng(5)
    x = r.normal(size=(90, 6))
    x[40:50] = x[30:40]  # equal vectors tie
    s = spark.createDataFrame([(i % 2 if i != 89 else None, i, v.tolist()) for i, v in enumerate(x)], "session long, seg_idx long, embedding array<double>")
    u = {t["seg_idx"]: (t["session"], np.array(t["v"])) for t in bank.unit_rows(s).collect()}
    want = {}
    for i, (a, v) in u.items():
        near = sorted((-float(sum(p * q for p, q in zip(v, w, strict=True))), j) for j, (b, w) in u.items() if a is not None and a == b and i != j)
        for w, j in near[:4]:
            if -w >= 0.1:
                want[i, j] = want[j, i] = -w
    got = {(t["src"], t["dst"]): t["w"] for t in bank.nearest_neighbours(s, 4, 0.1).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_nearest_entries_write_no_pairs(spark):
    rows = spark.range(50).select(F.lit(0).alias("session"), F.col("id").alias("seg_idx"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"))
    plan = bank.nearest_neighbours(rows, 2, 0.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan.split("FlatMapGroupsInPandas")[0] and "FlatMapGroupsInPandas" in plan


def test_nearest_words_are_shuffled_once(spark):
    """Each side is dealt once; edges of buckets, odd rows and words without a neighbour come out as a plain search has them."""
    import random

    r = random.Random(5)
    kind = "session long, seg_idx long, word_idx long, start double, end double, speaker string"
    word = lambda i: (i % 2, i // 7, i % 7, (s := r.choice([5.0, 10.0, r.uniform(0, 40)]) + r.choice([-0.35, 0.0, 0.35])), s + r.choice([0.0, 0.2, 6.0, -0.1]), r.choice("abc"))
    ref, said = [word(i) for i in range(200)] + [(None, 0, 0, 1.0, 2.0, "a"), (1, 900, 0, None, 2.0, "a"), (5, 0, 0, 1.0, 1.0, "b")], [word(i) for i in range(150)]
    df = intervals.nearest_words(spark.createDataFrame(ref, kind).repartition(3), spark.createDataFrame(said, kind).repartition(3), 0.35, 5.0, ["start"])
    want = {}
    for s, g, i, a, z, who in ref:
        t, best = None if a is None else (a + z) / 2, None
        for s2, g2, i2, a2, z2, who2 in said if t is not None else []:
            gap = 0.0 if a2 <= t <= z2 else min(abs(t - a2), abs(t - z2))
            if s == s2 and gap <= 0.35 and z2 >= t - 0.35 and a2 <= t + 0.35:
                best = min(filter(None, (best, ((gap, abs((a2 + z2) / 2 - t), a2, z2, g2, i2), who2))))
        want[s, g, i] = (who, best[1] if best else "<unmatched>", a)
    got = {(x["session"], x["seg_idx"], x["word_idx"]): (x["actual"], x["predicted"], x["start"]) for x in df.collect()}
    assert got == want and len({v[1] for v in got.values()}) == 4
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        few = intervals.nearest_words(spark.createDataFrame(ref, kind), spark.createDataFrame(said, kind))
        few.collect()
        plan = few._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
