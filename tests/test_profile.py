"""A session under a profile, against the same steps written out for a few segments."""

import math

from pyspark.sql import functions as F

from parlance.operators import classifier as C
from parlance.operators import graph, profile

ENTRY = "entry_idx long, speaker string, embedding array<double>"
SEG = "session string, seg_idx long, start double, end double, speaker_raw string"
VEC = "session string, seg_idx long, embedding array<double>"


def unit(x, y):
    n = math.hypot(x, y)
    return [x / n, y / n]


def bank(spark):
    rows = [(i, "A", unit(1, 0.05 * i)) for i in range(-2, 3)] + [(10 + i, "B", unit(0.05 * i, 1)) for i in range(-2, 3)]
    return spark.createDataFrame(rows, ENTRY)


def test_segments_labels_and_fallbacks(spark):
    """Own match, the label's mean, the label's vector, nothing; then a short flip is smoothed."""
    seg = [(0, 0.0, 2.0, "L0"), (1, 2.1, 4.0, "L0"), (2, 4.1, 6.0, "L0"), (3, 6.1, 8.0, "L1"), (4, 8.1, 10.0, "L1"), (5, 10.1, 10.9, "L2"), (6, 11.0, 13.0, "L0"), (7, 13.1, 15.0, "L3")]
    vec = {0: unit(1, 0.02), 1: unit(1, 0.03), 2: unit(1, 0.8), 3: unit(0.9, 1), 4: unit(-0.9, 1), 5: unit(0.1, 1), 6: unit(1, 0.0), 7: unit(-1, -0.2)}
    s = spark.createDataFrame([("s", i, a, b, lab) for i, a, b, lab in seg], SEG)
    v = spark.createDataFrame([("s", i, x) for i, x in vec.items()], VEC)
    p = profile.Profile(threshold=0.9, margin=0.3, radius=1e9, least_segments=2, smooth=False)
    got = {r["seg_idx"]: (r["speaker"], r["how"]) for r in profile.apply_profile(s, v, bank(spark), p).collect()}
    # label L0: mean score of A is high enough over its four segments; L1's segments point apart, but their mean vector is B's
    assert got == {0: ("A", "segment_centroid"), 1: ("A", "segment_centroid"), 2: ("A", "label_segments"), 3: ("B", "label_vector"), 4: ("B", "label_vector"), 5: ("B", "segment_centroid"), 6: ("A", "segment_centroid"), 7: ("unknown", "none")}
    sums = profile.summary(profile.apply_profile(s, v, bank(spark), p)).first()
    assert (sums["segments"], sums["matched"], sums["unknown"], sums["overrides"]) == (8, 7, 1, 0) and sums["ways"] == {"label_segments": 1, "label_vector": 2, "none": 1, "segment_centroid": 4}
    s2 = s.where("seg_idx in (0, 5, 6)").withColumn("seg_idx", F.col("seg_idx"))
    p2 = profile.Profile(threshold=0.9, margin=0.3, radius=1e9, least_segments=5, smoothing={"cap": 2.0, "gap": 100.0})
    got = {r["seg_idx"]: (r["speaker"], r["how"]) for r in profile.apply_profile(s2, v, bank(spark), p2).collect()}
    assert got == {0: ("A", "segment_centroid"), 5: ("A", "smoothed"), 6: ("A", "segment_centroid")}


def test_classifier_first_and_both_added(spark):
    b = bank(spark)
    fitted = C.fit(b.selectExpr("entry_idx", "speaker as label", "embedding"), "logreg", c=100.0)
    s = spark.createDataFrame([("s", 0, 0.0, 3.0, "L0"), ("s", 1, 3.0, 3.5, "L1"), ("s", 2, 4.0, 9.0, "L2")], SEG)
    v = spark.createDataFrame([("s", 0, unit(1, 0.9)), ("s", 1, unit(1, 0.8)), ("s", 2, unit(0, 1))], VEC)
    chance = {(r["seg_idx"], r["speaker"]): r["score"] for r in C.score(fitted, v).collect()}
    p = profile.Profile(threshold=0.95, margin=0.0, radius=1e9, least_segments=9, classifier_confidence=0.5, smooth=False)
    got = {r["seg_idx"]: (r["speaker"], r["how"]) for r in profile.apply_profile(s, v, b, p, classifier=fitted).collect()}
    # half a second asks the classifier for 0.6 and a margin of 0.2, which it has not
    assert 0.5 < chance[1, "A"] and chance[1, "A"] - chance[1, "B"] < 0.8
    short = chance[1, "A"] >= 0.6 and chance[1, "A"] - chance[1, "B"] >= 0.2
    assert got[0] == ("A", "segment_segment_classifier") or got[0] == ("A", "segment_classifier")
    assert got[2][0] == "B" and got[2][1].endswith("classifier") and got[1][1].endswith("classifier") == short or got[1][1] == "label_classifier"
    both = profile.Profile(threshold=0.5, radius=1e9, fusion="score_sum", smooth=False)
    told = {(r["seg_idx"], r["speaker"]): (r["score"], r["source"]) for r in profile.candidates(s, v, b, both, classifier=fitted).collect()}
    cosine = {(r["seg_idx"], r["speaker"]): r["score"] for r in profile.candidates(s, v, b, profile.Profile(radius=1e9)).collect()}
    for k, (score, source) in told.items():
        assert source == "segment_fusion" and abs(score - 0.7 * chance[k] - 0.3 * cosine[k]) < 1e-9


def test_graph_in_the_same_call(spark):
    s = spark.createDataFrame([("s", i, 2.0 * i, 2.0 * i + 1.9, "S0") for i in range(5)], SEG)
    v = spark.createDataFrame([("s", i, unit(1, 0.02 * i) if i != 2 else unit(1, 0.95)) for i in range(5)], VEC)
    g = graph.SessionGraph(min_similarity=0.0, strong_seed_score=0.9, strong_seed_margin=0.5)
    p = profile.Profile(threshold=0.8, margin=0.3, radius=1e9, least_segments=99, graph=g, smooth=False)
    plain = {r["seg_idx"]: r["speaker"] for r in profile.apply_profile(s, v, bank(spark), profile.Profile(threshold=0.99, margin=0.3, radius=1e9, least_segments=99, smooth=False)).collect()}
    got = {r["seg_idx"]: (r["speaker"], r["how"], r["seed"], r["overridden"]) for r in profile.apply_profile(s, v, bank(spark), p).collect()}
    assert all(got[i] == ("A", "segment_centroid", True, False) for i in (0, 1, 3, 4)) and plain[0] == "A"
    assert got[2][0] == "A" and got[2][2] is False


def test_words_are_repaired_and_embedded_anew(spark):
    """A segment whose words change speaker is split; its boundary is trimmed; the parts are told apart by their own vectors."""
    w = [(0, 0, 0.0, 0.4, "X"), (0, 1, 0.4, 0.9, "X"), (0, 2, 0.9, 1.4, "Y"), (0, 3, 1.4, 2.2, "Y"), (1, 0, 2.05, 2.9, "X"), (1, 1, 2.9, 3.6, "X"), (2, 0, 3.7, 4.5, "X")]
    words = spark.createDataFrame([("s", a, b, c, d, e) for a, b, c, d, e in w], "session string, seg_idx long, word_idx long, start double, end double, speaker string")
    got = [tuple(r) for r in profile.repaired(words).orderBy("start").select("seg_idx", F.round("start", 3), F.round("end", 3), "speaker_raw", "overlap_heavy", "was_split").collect()]
    # Y's last word and X's first overlap by 0.15: cut in the middle; the two segments of X are 0.1 apart and become one
    assert [g[:4] for g in got] == [(0, 0.0, 0.9, "X"), (1, 0.9, 2.125, "Y"), (2, 2.125, 4.5, "X")] and [g[5] for g in got] == [True, True, False]

    def embed(batches):
        for b in batches:
            yield b.assign(embedding=[unit(1, 0.01) if r == "X" else unit(0.01, 1) for r in b["speaker_raw"]])

    out = profile.embedded_profile(words, embed, bank(spark), profile.Profile(threshold=0.8, radius=1e9, smooth=False))
    assert {r["seg_idx"]: r["speaker"] for r in out.collect()} == {0: "A", 1: "B", 2: "A"}
