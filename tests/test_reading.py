"""Labelled records, mappings and payloads in their shapes; the evaluation of a session from windows to report."""

import json

import pytest
from pyspark.sql import functions as F

from parlance.operators import evaluation, graph, profile, sequences
from parlance.sources import readers


def test_mappings(spark, tmp_path):
    (tmp_path / "m.yaml").write_text("# names\nbob: Robert\n1: One\nlist: [a]\nnone:\n")
    (tmp_path / "empty.yml").write_text("")
    (tmp_path / "bad.yaml").write_text("a: [b")
    (tmp_path / "list.yaml").write_text("- a\n")
    (tmp_path / "m.json").write_text(json.dumps({"bob": "Robert", "x": "Y"}))
    read = lambda f: [(r["key"], r["value"]) for r in readers.read_mapping(spark, f"file://{tmp_path}/{f}").orderBy("ord").collect()]
    assert read("m.yaml") == [("bob", "Robert"), ("1", "One")] and read("empty.yml") == [] and read("m.json") == [("bob", "Robert"), ("x", "Y")]
    with pytest.raises(ValueError, match="YAML"):
        read("bad.yaml")
    with pytest.raises(ValueError, match="no mapping"):
        read("list.yaml")


def test_labelled_records_of_either_kind(spark, tmp_path):
    (tmp_path / "t.txt").write_text("Zed One 00:00:07 hello there\nDungeon Master 00:00:10 well met\nnot a line\nbob 00:00:12 hi\n")
    (tmp_path / "t.jsonl").write_text("".join(json.dumps(r) + "\n" for r in [{"file": "f", "start": 1, "end": 2, "speaker": "ZED ONE", "text": "a"}, {"file": "f", "start": 2, "end": 3, "speaker": "bob", "speaker_raw": "S1", "text": "b"}, {"file": "f", "start": 3, "end": 4, "text": "c"}]))
    mapping = spark.createDataFrame([(0, "bob", "Robert")], readers.MAPPING)
    read = lambda f: [tuple(r) for r in readers.read_labelled_records(spark, f"file://{tmp_path}/{f}", {"zed one ": "Zed"}, mapping).orderBy("start").select("start", "end", "speaker", "speaker_raw").collect()]
    assert read("t.txt") == [(7.0, 10.0, "Zed", "Zed One"), (10.0, 12.0, "Dungeon Master", "Dungeon Master"), (12.0, 13.0, "Robert", "bob")]
    got = read("t.jsonl")
    assert got[:2] == [(1.0, 2.0, "Zed", "ZED ONE"), (2.0, 3.0, "Robert", "S1")] and got[2][3] is None
    (tmp_path / "bad.jsonl").write_text("{nonsense\n")
    with pytest.raises(Exception, match="MALFORMED|alformed"):
        read("bad.jsonl")


def test_payload_shapes(spark):
    seg = {"start": 1.5, "end": 2.0, "speaker": "A", "text": "t", "words": [{"start": 1.5, "end": 2.0, "word": "t"}]}
    entries = [["a.wav", [seg, "junk", 3, None]], {"b.wav": [seg]}, {"c.wav": {"segments": [seg, seg]}}, {"d.wav": {"other": 1}}, ["e.wav", 7], ["f.wav", None], ["g.wav", "text"], ["too", "many", "parts"], {"two": [], "keys": []}, 5, "x", [], {}, {"h.wav": {"segments": None}}, {"i.wav": []}]
    df = spark.createDataFrame([(json.dumps(e),) for e in entries] + [("not json",), (None,)], "value string")
    got = {r["file"]: len(r["segments"]) for r in readers.normalised_payloads(df).collect()}
    assert got == {"a.wav": 1, "b.wav": 1, "c.wav": 2, "d.wav": 0, "h.wav": 0, "i.wav": 0}
    rows = sorted((r["file"], r["start"], r["speaker"], r["words"][0]["word"]) for r in readers.payload_segments(df).collect())
    assert rows == [("a.wav", 1.5, "A", "t"), ("b.wav", 1.5, "A", "t"), ("c.wav", 1.5, "A", "t"), ("c.wav", 1.5, "A", "t")]
    turns = spark.createDataFrame([(json.dumps({"a.wav": [seg, 1], "c.wav": {"segments": [seg]}, "gone.wav": [seg], "b.wav": [], "d.wav": 4}),)], "value string")
    kept = readers.normalised_payloads(df).select("file")
    assert {r["file"]: len(r["turns"]) for r in readers.normalised_turns(turns, kept).collect()} == {"a.wav": 1, "c.wav": 1}


def test_session_from_windows_to_report(spark):
    """Two voices, one of them hard to tell in one segment that the graph saves: words by phase, pairs, roll-up and purity, by hand."""
    seg, ref, words, vec = [], [], [], []
    for i in range(40):
        who = "A" if (i // 4) % 2 == 0 else "B"
        a = 3.0 * i
        seg.append(("s", i, a, a + 2.9, "S6" if i == 6 else "S" + who))
        weak = i == 6
        side = [1.0, 0.02 * (i % 5)] if who == "A" else [0.02 * (i % 5), 1.0]
        vec.append(("s", i, [0.75, 0.8] if weak else side))
        for j in range(4):
            t = a + 0.7 * j
            ref.append(("s", i, j, t, t + 0.5, who))
            words.append(("s", i, j, t + 0.1, t + 0.6, "raw"))
    df = spark.createDataFrame
    segments = df(seg, "session string, seg_idx long, start double, end double, speaker_raw string")
    word = "session string, seg_idx long, word_idx long, start double, end double, speaker string"
    bank = df([(100 + i, "A", [1.0, 0.05 * i]) for i in range(4)] + [(200 + i, "B", [0.05 * i, 1.0]) for i in range(4)], "entry_idx long, speaker string, embedding array<double>")
    records = df([(s, i, a, b, "A" if (i // 4) % 2 == 0 else "B", 4) for s, i, a, b, _ in seg], "session string, seg_idx long, start double, end double, speaker string, n_words long")
    windows = evaluation.name_windows(sequences.greedy_windows(sequences.sliding_windows(records, 30.0, 15.0, 2), 2))
    names = sorted((r["name"], r["start"]) for r in windows.collect())
    assert len(names) == 2 and names[0][0].startswith("s_window_01_000")
    p = profile.Profile(threshold=0.9, margin=0.4, radius=1e9, least_segments=99, smooth=False, graph=graph.SessionGraph(min_similarity=0.0, strong_seed_score=0.9, strong_seed_margin=0.4))
    frames = df([("s", st, float(t), t + 1.0, 0.9 if ((int(t) // 12) % 2 == 0) == (st == "A") else 0.1) for st in "AB" for t in range(120)], "session string, stem string, start double, end double, power double")
    out = evaluation.evaluate_session(windows, df(ref, word), segments, df(words, word), df(vec, "session string, seg_idx long, embedding array<double>"), bank, p, frames=frames)
    metrics = {(r["name"], r["phase"]): r for r in out["metrics"].collect()}
    assert len(metrics) == 4
    for name, start in names:
        inside = [r for r in ref if r[4] > start and r[3] < start + 30.0]
        assert metrics[name, "post_graph"]["total"] == len(inside) and metrics[name, "post_graph"]["session"] == "s"
        lost = [r for r in inside if r[1] == 6]
        assert metrics[name, "pre_graph"]["correct"] == len(inside) - len(lost)
    roll = {r["phase"]: r for r in out["rollup"].collect()}
    assert roll["post_graph"]["mean_accuracy"] >= roll["pre_graph"]["mean_accuracy"] and roll["pre_graph"]["windows"] == 2
    pure = {(r["session"], r["seg_idx"]): r["stem"] for r in out["purity"].collect()}
    assert pure and all(stem == ("A" if (i // 4) % 2 == 0 else "B") for (_, i), stem in pure.items())
    assert out["segments"].count() == out["purity"].count() and "delta" in out["pairs"].columns


def test_settings():
    from parlance.functions import config

    assert config.merged({"a": {"x": 1, "y": {"z": 2}}, "b": 3}, {"a": {"y": {"w": 4}}, "b": {"c": 5}}) == {"a": {"x": 1, "y": {"z": 2, "w": 4}}, "b": {"c": 5}}
    caps = config.pair_caps([{"pair": ["B ", "A"], "value": "3"}, {"pair": ["A"], "value": 1}, {"pair": ["", "C"], "value": 1}, {"value": 2}, {"pair": ["C", "A"], "value": 4}])
    assert caps == {"A::B": 3, "A::C": 4} and config.cap_items(caps) == [{"pair": ["A", "B"], "value": 3}, {"pair": ["A", "C"], "value": 4}] and config.pair_caps(config.cap_items(caps)) == caps
    name = config.profile_name("run", "Phase 2!", "--", "/x")
    assert name.startswith("run_phase_2_experiment_") and name != config.profile_name("run", "Phase 2!", "--", "/y")
    g = config.graph_of({"session_graph": {"enabled": True, "knn": 5.0, "alpha": 0.5, "pair_overrides": {"A::B": {"override_min_delta": 1}, "C::D": {"same_top1_weight": 2}}}}, {"session_graph": {"alpha": 0.7, "pair_overrides": {"B::A": {"override_min_margin": 3}}}})
    assert (g.knn, g.alpha) == (5, 0.7) and g.pairs == {"A::B": {"override_min_margin": 3.0}, "C::D": {"same_top1_weight": 2.0}}
    with pytest.raises(ValueError, match="unknown settings"):
        config.graph_of({"session_graph": {"nothing": 1}})


def test_equal_scores_stand_in_the_order_of_the_bank(spark):
    from parlance.operators import bank

    b = spark.createDataFrame([(5, "A", [0.0, 1.0]), (3, "Z", [0.0, 2.0]), (9, "M", [1.0, 0.0])], "entry_idx long, speaker string, embedding array<double>")
    q = spark.createDataFrame([("s", 0, [0.1, 1.0])], "session string, seg_idx long, embedding array<double>")
    assert [r["speaker"] for r in bank.bank_scores(q, bank.clusters_by_speaker(b), 1e9).orderBy("rank").collect()] == ["Z", "A", "M"]
