"""Operators on lines: the same rows whether a session is one task or many, and equal to plain steps."""

import random

import pytest
from pyspark.sql import functions as F

from parlance.operators import attribution, intervals, lines, sequences

SEG = "session string, seg_idx long, start double, end double, speaker string, speaker_raw string, score double"


@pytest.fixture(params=["whole", "parts"])
def parted(request, monkeypatch):
    if request.param == "parts":
        monkeypatch.setattr(lines, "HOT", 20)
        monkeypatch.setattr(lines, "STRETCH", 11)
    return request.param


def segments(seed, n=220):
    r = random.Random(seed)
    rows = []
    for s in ("hot", "rare"):
        t = 0.0
        for i in range(n if s == "hot" else 9):
            t += r.choice([-0.2, -0.1, 0.0, 0.1, 0.3, 1.0])
            d = r.choice([0.2, 0.3, 0.5, 1.5, 3.0])
            rows.append((s, i, round(t, 3), round(t + d, 3), r.choice(["A", "A", "B", "b", None, "", "unknown"]), r.choice(["X", "X", "Y", "", None]), r.choice([0.1, 0.4, 0.6, None, float("nan")])))
            t += d
    return rows


def in_order(rows):
    by = {}
    for x in sorted(rows, key=lambda x: (x[0], x[2], x[3], x[1])):
        by.setdefault(x[0], []).append(x)
    return by


def test_runs_of_speakers(spark, parted):
    rows = segments(1)
    want = []
    for s, part in in_order(rows).items():
        run = None
        for x in part:
            if run and run[2] == x[4] and x[2] - run[1] <= 0.2:
                run[1] = max(run[1], x[3])
                run[3] += 1
            else:
                if run:
                    want.append((s, *run))
                run = [x[2], x[3], x[4], 1]
        want.append((s, *run))
    got = [tuple(r) for r in sequences.merge_turns(spark.createDataFrame(rows, SEG), 0.2, 0.8).select("session", "start", "end", "speaker", "parts").collect()]
    assert sorted(map(str, got)) == sorted(str(w) for w in want if w[2] - w[1] >= 0.8)


def test_repair(spark, parted):
    rows = segments(2)
    df = spark.createDataFrame(rows, SEG)
    trimmed, merged, absorbed = [], [], []
    for s, part in in_order(rows).items():
        for i, x in enumerate(part):
            a, b, heavy = x[2], x[3], False
            if i and 0 < part[i - 1][3] - x[2] <= 0.3:
                a, heavy = (x[2] + part[i - 1][3]) / 2, heavy or part[i - 1][3] - x[2] > 0.15
            if i + 1 < len(part) and 0 < x[3] - part[i + 1][2] <= 0.3:
                b, heavy = (x[3] + part[i + 1][2]) / 2, heavy or x[3] - part[i + 1][2] > 0.15
            trimmed.append((s, x[1], a, b, heavy))
        for out, joins in ((merged, lambda x, p: x[5] == p[5] and (x[5] or "").strip() and 0 <= x[2] - p[3] <= 0.2), (absorbed, lambda x, p: x[3] - x[2] < 0.35 and x[5] is not None and x[5] == p[5])):
            for i, x in enumerate(part):
                if i and joins(x, part[i - 1]):
                    _, a, b, n = out[-1]
                    out[-1] = (s, a, x[3] if out is merged else max(b, x[3]), n + 1)
                else:
                    out.append((s, x[2], x[3], 1))
    text = lambda rows: sorted(str(tuple(r)) for r in rows)
    assert text(sequences.trim_overlaps(df).select("session", "seg_idx", "start", "end", "overlap_heavy").collect()) == text(trimmed)
    assert text(sequences.merge_same_raw(df).select("session", "start", "end", "parts").collect()) == text(merged)
    assert text(sequences.absorb_short(df).select("session", "start", "end", "parts").collect()) == text(absorbed)


def smoothed_by_hand(part, most, seconds, gap, cap):
    who = [x[4] for x in part]
    for size in range(most, 0, -1):
        i = 1
        while i + size < len(part):
            inner = range(i, i + size)
            left, right = who[i - 1], who[i + size]
            near = all(part[j + 1][2] - part[j][3] <= gap for j in range(i - 1, i + size))
            weak = all(part[j][6] is None or part[j][6] != part[j][6] or part[j][6] <= cap for j in inner)
            if left == right and left and left != "unknown" and all(who[j] != left for j in inner) and near and weak and sum(part[j][3] - part[j][2] for j in inner) <= seconds:
                for j in inner:
                    who[j] = left
            i += 1
    return who


@pytest.mark.parametrize(("most", "seed"), [(1, 3), (2, 4), (3, 5)])
def test_smoothing(spark, parted, most, seed):
    r = random.Random(seed)
    rows = [(s, i, 1.0 * i, 1.0 * i + r.choice([0.2, 0.9]), r.choice("AAABB") if i % 40 else "unknown", "X", r.choice([0.1, 0.2, 0.3, 0.7, None])) for s in ("hot", "rare") for i in range(400 if s == "hot" else 7)]
    rows += [("flips", i, 1.0 * i, 1.0 * i + 0.5, "AB"[i % 2], "X", None) for i in range(90)] + [("pairs", i, 1.0 * i, 1.0 * i + 0.5, "ABB"[i % 3], "X", None) for i in range(90)]
    df = spark.createDataFrame(rows, SEG)
    got = {(x["session"], x["seg_idx"]): x["smoothed"] for x in attribution.smooth_flips(df, most, 1.5, 0.85, 0.5).collect()}
    want = {(s, x[1]): w for s, part in in_order(rows).items() for x, w in zip(part, smoothed_by_hand(part, most, 1.5, 0.85, 0.5), strict=True)}
    assert got == want and sum(want[x[0], x[1]] != x[4] for x in rows) > 20


def test_words_far_from_any_turn(spark, parted):
    r = random.Random(6)
    turns = [(s, i, t, t + r.choice([0.5, 2.0]), r.choice("ABC")) for s in ("hot", "rare") for i, t in enumerate(sorted(r.choice(range(0, 900, 7)) * 1.0 for _ in range(60)))]
    words = [(s, i, 0, t, t + 0.2) for s in ("hot", "rare", "none") for i, t in enumerate(r.uniform(-20, 950) for _ in range(80 if s == "hot" else 20))] + [("hot", 900, 0, turns[3][3] + 0.4, turns[3][3] + 0.6)]
    t = spark.createDataFrame(turns, "session string, turn_idx long, start double, end double, speaker string")
    w = spark.createDataFrame(words, "session string, seg_idx long, word_idx long, start double, end double")
    got = {(x["session"], x["seg_idx"]): x["turn_speaker"] for x in intervals.label_by_overlap(w, t).collect()}
    for s, i, _, a, b in words:
        mine = [x for x in turns if x[0] == s]
        over = [(-(min(b, x[3]) - max(a, x[2])), x[1], x[4]) for x in mine if min(b, x[3]) - max(a, x[2]) > 0]
        mid = (a + b) / 2
        holds = [(-x[1], x[4]) for x in mine if x[2] <= mid <= x[3]]
        near = [(min(abs(mid - x[2]), abs(mid - x[3])), x[1], x[4]) for x in mine]
        want = min(over)[2] if over else min(holds)[1] if holds else min(near)[2] if near else None
        assert got[s, i] == want, (s, i)


def test_running_values_and_neighbours(spark, parted):
    rows = [("k", i, (i * 7) % 13 if i % 5 else None) for i in range(100)] + [(None, i, i) for i in range(30)]
    df = spark.createDataFrame(rows, "key string, i long, v long").repartition(5)
    line = lines.Line(df, ["key"], ["i"], places=True)
    assert line.hot == (parted == "parts")
    out = line.running(line.running(line.running(line.rows, "total", F.col("v"), "sum"), "most", F.col("v"), "max", own=False), "least", F.struct("v", "i"), "min")
    out = line.beside(out, back=(F.col("v"), 3), ahead=(F.col("i"), -2))
    got = {(r["key"], r["i"]): r for r in out.collect()}
    assert len(got) == 130
    for k in ("k", None):
        part = [r for r in rows if r[0] == k]
        for n, (_, i, _) in enumerate(part):
            r, seen = got[k, i], [x[2] for x in part[: n + 1] if x[2] is not None]
            assert r["total"] == (sum(seen) if seen else None) and r["_i"] == n
            before = [x[2] for x in part[:n] if x[2] is not None]
            assert r["most"] == max(before, default=None)
            assert r["back"] == (part[n - 3][2] if n >= 3 else None) and r["ahead"] == (part[n + 2][1] if n + 2 < len(part) else None)


@pytest.mark.parametrize("most", [0, 10_000])
def test_greedy_windows_one_after_the_other(spark, monkeypatch, most):
    monkeypatch.setattr(sequences, "WINDOWS", most)
    r = random.Random(8)
    rows = [(s, float(a), a + 10.0, r.choice([5.0, 6.0, 7.0]), r.randint(1, 3), r.randint(0, 3)) for s in ("hot", "rare") for a in r.sample(range(0, 200, 2), 60 if s == "hot" else 2)]
    got = {}
    for x in sequences.greedy_windows(spark.createDataFrame(rows, "session string, start double, end double, score double, speaker_count long, speaker_turns long"), 5).orderBy("session", "rank").collect():
        got.setdefault(x["session"], []).append((x["rank"], x["start"], x["end"], x["score"]))
    want = {}
    for s in ("hot", "rare"):
        chosen = []
        for x in sorted((x for x in rows if x[0] == s), key=lambda x: (-x[3], -x[4], -x[5], x[1])):
            if len(chosen) < 5 and all(x[2] <= y[1] or x[1] >= y[2] for y in chosen):
                chosen.append(x)
        want[s] = [(i, x[1], x[2], x[3]) for i, x in enumerate(chosen, 1)]
    assert got == want
    assert sequences.greedy_windows(spark.createDataFrame([], "session string, start double, end double, score double, speaker_count long, speaker_turns long"), 3).count() == 0
