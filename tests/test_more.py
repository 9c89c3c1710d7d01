"""Bank tables, discovery, pools, evaluation, outputs and watching: small scenarios with known results."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators import attribution, bank, datasets, discovery, evaluation, pool, sequences
from parlance.sources import bank_tables, readers, writers
from parlance.streaming import watch

ENTRY = "entry_idx long, speaker string, embedding array<double>"


def test_bank_grows_is_saved_and_matches(spark, tmp_path):
    b = spark.createDataFrame([(0, "A", [3.0, 0.0]), (1, "A", [1.0, 0.2]), (2, "B", [0.0, 2.0])], ENTRY)
    with pytest.raises(ValueError, match="zero"):
        bank.add_entries(b, spark.createDataFrame([(9, "C", [0.0, 0.0])], ENTRY))
    grown = bank.add_entries(b, spark.createDataFrame([(3, "C", [-5.0, 0.1])], ENTRY))
    path = f"file://{tmp_path}/bank"
    assert bank_tables.load_bank(spark, path).count() == 0
    bank_tables.save_bank(grown, path)
    again = bank_tables.load_bank(spark, path)
    assert again.count() == 4 and spark.read.parquet(f"{path}/clusters").count() == 3
    q = spark.createDataFrame([("s", 100, [-1.0, 0.0]), ("s", 101, [0.0, 0.0])], "session string, seg_idx long, embedding array<double>")
    got = bank.match(q, again, 0.5, 0.1, examples=2).collect()
    assert [(r["seg_idx"], r["speaker"], r["matched"]) for r in got] == [(100, "C", True)]


def test_prototypes_can_beat_the_centroid(spark):
    b = spark.createDataFrame([(0, "A", [1.0, 0.0]), (1, "A", [0.0, 1.0]), (2, "B", [0.8, 0.6])], ENTRY)
    c = bank.clusters_by_speaker(b)
    q = spark.createDataFrame([("s", 50, [1.0, 0.0])], "session string, seg_idx long, embedding array<double>")
    plain = bank.bank_scores(q, c).where("speaker = 'A'").first()
    more = bank.bank_scores(q, c, examples=bank.prototypes(b, c, 5)).where("speaker = 'A'").first()
    assert plain["source"] == "centroid" and abs(plain["score"] - 0.5**0.5) < 1e-9
    assert more["source"] == "prototype" and abs(more["score"] - 1) < 1e-9 and more["rank"] == 1
    itself = bank.bank_scores(q.withColumn("seg_idx", F.lit(0).cast("long")), c, examples=bank.prototypes(b, c, 5)).where("speaker = 'A'").first()
    assert itself["source"] == "centroid"


def test_normalised_scores_equal_plain_ones(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(60, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    who = ["A" if i < 40 else "BCDE"[i % 4] for i in range(60)]  # one speaker holds most of the best entries
    b = spark.createDataFrame([(i, who[i], x[i].tolist()) for i in range(60)], ENTRY)
    q = spark.createDataFrame([(0, i, x[i].tolist()) for i in (0, 45)], "session int, seg_idx long, embedding array<double>")
    c = bank.clusters_by_speaker(b)
    centre = {v["speaker"]: np.array(v["centroid"]) for v in c.collect()}
    got = {(v["seg_idx"], v["speaker"]): v["score"] for v in bank.normalised_scores(q, b, c, 7).collect()}
    for i in (0, 45):
        for s in "ABCDE":
            top = lambda v, skip: np.sort([v @ x[j] for j in range(60) if who[j] != s and j != skip])[::-1][:7]  # noqa: E731,B023
            mine, theirs, raw = top(x[i], i), top(centre[s], -1), x[i] @ centre[s]
            want = 0.5 * ((raw - theirs.mean()) / theirs.std() + (raw - mine.mean()) / mine.std())
            assert abs(got[i, s] - want) < 1e-6


def test_even_samples_of_a_hot_key(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 10 == 0, "rare").otherwise("hot").alias("k"), (F.col("id") * 7 % 5003).alias("row_id"))
    got = sequences.sample_evenly(rows, ["k"], ["row_id"], 30).collect()
    for k in ("rare", "hot"):
        ids = sorted(r["row_id"] for r in rows.where(F.col("k") == k).collect())
        assert sorted(r["row_id"] for r in got if r["k"] == k) == [ids[round(j * (len(ids) - 1) / 29)] for j in range(30)]
    few = sequences.sample_evenly(rows, ["k"], ["row_id"], F.when(F.col("k") == "hot", 1).otherwise(0)).collect()
    assert [r["k"] for r in few] == ["hot"] and few[0]["row_id"] == min(r["row_id"] for r in rows.where("k = 'hot'").collect())


def test_transcript_lines(spark):
    lines = ["Ann Lee 0:01:05 hello there  ", "00:00:09 : Bob : time first", "0:00:09 : a:b : no", "Ann 0:00:07 ", "nothing", "X 1:00:00 : y : z"]
    got = [r["p"] for r in spark.createDataFrame([(x,) for x in lines], "line string").select(T.transcript_line(F.col("line")).alias("p")).collect()]
    assert [tuple(x) if x else None for x in got] == [("Ann Lee", 65.0, "hello there"), ("Bob", 9.0, "time first"), ("a", 9.0, "b : no"), None, None, ("X", 3600.0, ": y : z")]


def test_session_names(spark):
    paths = ["a/Session 12 2_3.txt", "a/session_7/x.wav", "Session-9/deep/talk 44.wav", "a/b/c.txt", "in/Session  3   1_2/y.zip"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = [r[0] for r in df.select(T.session_identity(F.col("path"))).collect()]
    assert [tuple(x) if x else None for x in got] == [(12, 2, 3), (7, None, None), (9, None, None), None, (3, 1, 2)]
    assert [r[0] for r in df.select(T.session_keys(F.col("path"))).collect()] == [["session 12 2_3"], [], [], [], ["session 3 1_2"]]
    assert df.limit(1).select(T.watch_name(F.lit(" My__Talk  x ")), T.slug(F.lit(" A b!c ")), T.human_bytes(F.lit(1536)), T.human_bytes(F.lit(None).cast("long"))).first()[:] == ("my talk x", "a-b-c", "1.5 KiB", "n/a")


def test_discovery(spark):
    files = spark.createDataFrame([("in/s.wav",), ("in/processed/t.wav",), ("in/sub/skip_me.mp3",), ("in/notes.txt",), ("in/Session 4.zip",), ("in/session_5/a.flac",)], "path string")
    assert sorted(r["path"] for r in discovery.candidate_media(files, ["skip*.mp3"]).collect()) == ["in/Session 4.zip", "in/s.wav", "in/session_5/a.flac"]
    assert sorted(tuple(r) for r in discovery.session_sources(files, "in").collect()) == [("in/Session 4.zip", "archive"), ("in/session_5", "folder")]
    assert [tuple(r) for r in discovery.session_sources(files.where("path like 'in/s%wav'"), "in").collect()] == [("in", "root")]
    texts = spark.createDataFrame([("out/session 4.txt",), ("out/copy of session 4.jsonl",), ("out/Session 4/all.jsonl",), ("out/session 5.txt",)], "path string")
    assert [tuple(r) for r in discovery.transcript_of(files.where("path like '%.zip'").select(F.col("path").alias("source")), texts).collect()] == [("in/Session 4.zip", "out/session 4.txt", 350.0)]
    done = discovery.already_done(spark.createDataFrame([("in/Session 4.zip",), ("in/My_Talk.mp3",), ("in/other.mp3",)], "path string"), spark.createDataFrame([("out/x/session  4/a.txt",), ("out/my talk.txt",)], "path string"))
    assert sorted(tuple(r) for r in done.collect()) == [("in/My_Talk.mp3", "out/my talk.txt"), ("in/Session 4.zip", "out/x/session  4/a.txt")]
    moves = discovery.archive_moves(spark.createDataFrame([("in/a.wav",), ("in/b/a.wav",), ("in/c.mp3",)], "path string"), spark.createDataFrame([("done/a.wav",), ("done/a__3.wav",)], "path string"), "done/")
    assert sorted(tuple(r) for r in moves.collect()) == [("in/a.wav", "done/a__2.wav"), ("in/b/a.wav", "done/a__4.wav"), ("in/c.mp3", "done/c.mp3")]


def test_pool(spark, tmp_path):
    path = f"file://{tmp_path}/pool"
    assert pool.load_pool(spark, path).count() == 0
    rows = [(1, "A", "B", "low_share", 0.6, "loud"), (2, "B", "A", "not_dominant", 0.7, "generic"), (3, "A", "unknown", "low_share", 0.9, "loud"), (4, "A", "B", "too_short", 0.9, "loud"), (5, "A", "B", "low_share", 0.5, "loud"), (6, "C", "A", "low_share", 0.6, "loud")]
    df = spark.createDataFrame(rows, "row_id long, speaker string, second_speaker string, rejection string, dominant_share double, style_profile string").withColumn("embedding", F.expr("array(cast(1 as float))"))
    pool.save_pool(df, path)
    weights = spark.createDataFrame([("A::B", 1.0)], "pair string, weight double")
    got = pool.hard_negatives(pool.load_pool(spark, path), weights, "loud").orderBy("row_id").collect()
    assert [(r["row_id"], r["partner"], r["selection_reason"]) for r in got] == [(1, "B", "mixed_rejection_low_share"), (2, "A", "mixed_rejection_not_dominant")]


def test_labels_and_words(spark):
    v = spark.createDataFrame([("s", "L", [1.0, 0.0]), ("s", "L", [-1.0, 0.0]), ("s", "M", [0.0, 3.0]), ("s", "", [1.0, 1.0])], "session string, label string, embedding array<double>")
    assert [(r["label"], r["embedding"]) for r in attribution.label_vectors(v).collect()] == [("M", [0.0, 1.0])]
    w = spark.createDataFrame([("s", 0, "A", 0.0, 1.0), ("s", 0, "B", 1.0, 1.4), ("s", 0, "B", 2.0, 2.6), ("s", 0, None, 3.0, 9.0)], "session string, seg_idx long, speaker string, start double, end double")
    assert attribution.duration_vote(w).first()["speaker"] == "A"
    d = spark.createDataFrame([(1, "x", "a"), (2, "y", "a")], "row_id long, label string, source string")
    assert datasets.appended(d, None) is d and datasets.subset(d, spark.createDataFrame([(2,), (2,)], "row_id long")).count() == 1


def test_end_to_end_evaluation(spark):
    kind = "session string, seg_idx long, word_idx long, start double, end double, speaker string"
    ref = spark.createDataFrame([("s", 0, i, i * 10.0, i * 10.0 + 0.4, "A" if i < 3 else "B") for i in range(6)], kind)
    said = spark.createDataFrame([("s", 0, i, i * 10.0, i * 10.0 + 0.4, "A") for i in range(5)], kind)
    got = {r["window"]: (r["total"], r["matched"], r["correct"]) for r in evaluation.evaluate(ref, said, 30.0).collect()}
    assert got == {0: (3, 3, 3), 1: (3, 2, 0)}


def test_outputs_and_stages(spark, tmp_path):
    s = spark.createDataFrame([("f", 0.0, 1.5, "A", "hi"), ("f", 2.0, 3.0, "B", " "), ("f", 4.0, 5.0, None, "yo")], "file string, start double, end double, speaker string, text string")
    turns = s.select(F.lit("s").alias("session"), "file", "start", "end", "speaker")
    writers.save_outputs(s, f"file://{tmp_path}/out", turns)
    assert [r["value"] for r in spark.read.text(f"file://{tmp_path}/out/txt").collect()] == ["[00:00:00] A: hi", "[00:00:04] unknown: yo"]
    assert spark.read.text(f"file://{tmp_path}/out/diarization").first()["value"].startswith('{"f":[{"start":0.0,"end":1.5,"speaker":"A"}')
    made = []

    def build():
        made.append(1)
        return s

    for signature in ({"a": 1}, {"a": 1}, {"a": 2}):
        assert writers.cached_stage(spark, f"file://{tmp_path}/cache", "stage", signature, build).count() == 3
    assert len(made) == 2
    (tmp_path / "map.json").write_text('{"z": "Zoe", "a b": "Ann"}')
    assert [tuple(r) for r in readers.read_mapping(spark, f"file://{tmp_path}/map.json").orderBy("ord").collect()] == [(0, "z", "Zoe"), (1, "a b", "Ann")]
    assert readers.read_records(spark, f"file://{tmp_path}/none.jsonl", "a int").count() == 0
    mapped = readers.with_mapping(s.withColumn("speaker_raw", F.lit(None).cast("string")), spark.createDataFrame([(0, "A", "Ann")], "ord int, key string, value string"))
    assert sorted((r["speaker"], r["speaker_raw"]) for r in mapped.collect()) == [("Ann", "A"), ("B", "B"), ("unknown", None)]


def test_vectors_from_segments(spark):
    s = spark.createDataFrame([("s", 0, 0.0, 1.0), ("s", 1, 1.0, 1.1), ("s", 2, 2.0, 4.0), ("s", 3, 5.0, 6.0)], "session string, seg_idx long, start double, end double")

    def embed(batches):
        for b in batches:
            yield b.assign(embedding=[[0.0, 0.0] if i == 3 else [e - a, 0.0] for i, a, e in zip(b["seg_idx"], b["start"], b["end"], strict=True)])

    assert sorted((r["seg_idx"], r["embedding"]) for r in bank.embedded(s, embed, 0.4, 0.1).collect()) == [(0, [1.0, 0.0]), (2, [1.0, 0.0])]
    flat = bank.plane(spark.createDataFrame([(i, [float(i), 1.0, 2.0]) for i in range(5)], "id int, embedding array<double>")).collect()
    assert len(flat) == 5 and all(np.isfinite([r["x"], r["y"]]).all() for r in flat)


def test_watching(spark, tmp_path):
    now = datetime.datetime(2024, 1, 1, 12, 0, 10)
    old, young = datetime.datetime(2024, 1, 1, 12), datetime.datetime(2024, 1, 1, 12, 0, 8)
    files = spark.createDataFrame([("in/Session 1.zip", old), ("in/Session 2.zip", old), ("in/new.wav", young), ("in/x.txt", old)], "path string, modificationTime timestamp")
    texts = spark.createDataFrame([("out/session 2.txt",)], "path string")
    seen = {"transcribe": [], "postprocess": []}
    status = f"file://{tmp_path}/status"
    work = lambda k: lambda df: seen[k].extend(sorted(r["path"] for r in df.collect()))
    step = lambda backfill=False: watch.watch_step(spark, files, status, texts, work("transcribe"), work("postprocess"), now, 5.0, backfill)
    assert {r["path"]: r["task"] for r in step().collect()} == {"in/Session 1.zip": "transcribe", "in/Session 2.zip": "skip"}
    assert seen == {"transcribe": ["in/Session 1.zip"], "postprocess": []}
    step(True)
    assert seen["postprocess"] == ["in/Session 2.zip"]
    assert {r["path"]: r["state"] for r in writers.states(spark, status).collect()}["in/Session 2.zip"] == "completed"


def test_many_clusters_are_met_in_parts(spark, monkeypatch):
    b = spark.createDataFrame([(i, f"S{i % 9}", [1.0, i / 10, 0.3]) for i in range(40)], ENTRY)
    q = spark.createDataFrame([("s", 100 + i, [1.0, i / 3, 0.0]) for i in range(5)], "session string, seg_idx long, embedding array<double>")
    c = bank.clusters_by_speaker(b)
    whole = sorted(map(str, bank.bank_scores(q, c, examples=bank.prototypes(b, c, 2)).collect()))
    monkeypatch.setattr(bank, "BROADCAST_VALUES", 0)
    assert sorted(map(str, bank.bank_scores(q, c, examples=bank.prototypes(b, c, 2)).collect())) == whole and len(whole) > 5
