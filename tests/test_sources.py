"""Readers, writers and the stream."""

import datetime
import json
import zipfile

import pytest

from parlance.sources import readers, writers
from parlance.streaming import watch


def test_segments_jsonl_skips_bad_lines(spark, tmp_path):
    p = tmp_path / "part.jsonl"
    p.write_text(json.dumps({"start": 0.5, "end": 4.5, "speaker": "S0", "words": [{"word": "hi", "start": 0.5, "end": 0.7}, {"word": "x"}]}) + "\nnot json\n")
    got = readers.read_segments(spark, str(p))
    r = got.collect()
    assert len(r) == 1 and r[0]["file"] == "part" and r[0]["speaker_raw"] == "S0"
    assert [w["text"] for w in readers.words_of(got).collect()] == ["hi"]
    with pytest.raises(Exception):
        readers.read_segments_jsonl(spark, str(p), strict=True).collect()


def test_segments_json_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"f1": [{"start": 1, "end": 2, "speaker": "A"}], "f2": "no list"}))
    (tmp_path / "b.json").write_text(json.dumps([{"start": 3, "end": 4, "speaker": "B"}]))
    got = sorted((r["file"], r["start"]) for p in ("a", "b") for r in readers.read_segments(spark, str(tmp_path / f"{p}.json")).collect())
    assert got == [("b", 3.0), ("f1", 1.0)]


def test_timed_transcript(spark, tmp_path):
    (tmp_path / "t.txt").write_text("Zariel Torgan 00:00:07 hello\nDungeon Master 00:00:10 one two three four\n")
    r = readers.read_timed_transcript(spark, str(tmp_path / "t.txt")).orderBy("line_no").collect()
    assert [(x["start"], round(x["end"], 2)) for x in r] == [(7.0, 10.0), (10.0, 11.4)]


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.wav", b"1")
        z.writestr("y.txt", b"2")
    assert [r["member"] for r in readers.zip_members(spark, str(tmp_path)).collect()] == ["x.wav"]


def test_missing_parts(spark):
    f = spark.createDataFrame([("s", 1, 3), ("s", 3, 3)], "session string, part int, total int")
    assert [tuple(r) for r in readers.missing_parts(f).collect()] == [("s", 2)]
    assert watch.complete_sessions(f).count() == 0


def test_srt_and_manifest(spark, tmp_path):
    s = spark.createDataFrame([("f", 0.0, 1.0, "A", "one"), ("f", 1.0, 2.0, "A", " "), ("f", 2.0, 3.0, "B", "three")], "file string, start double, end double, speaker string, text string")
    assert [r["idx"] for r in writers.srt_blocks(s).orderBy("idx").collect()] == [1, 3]
    writers.write_srt(s, str(tmp_path / "srt"))
    writers.write_manifest(spark, str(tmp_path / "m"), "bank", {"a": 1})
    assert writers.reusable(spark, str(tmp_path / "m"), {"a": 1}) and not writers.reusable(spark, str(tmp_path / "m"), {"a": 2})
    assert not writers.reusable(spark, str(tmp_path / "none"), {"a": 1})


def test_watched_folder_gives_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    run = lambda: watch.process(watch.new_segments(spark, str(tmp_path / "in")), lambda b: b.select("speaker"), str(tmp_path / "out"), str(tmp_path / "ck"), True).awaitTermination()
    for i in range(2):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"start": 0, "end": 1, "speaker": f"S{i}"}))
        run()
    run()
    assert sorted(r["speaker"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["S0", "S1"]


def test_stability_and_tasks(spark):
    now = datetime.datetime(2024, 1, 1, 0, 0, 10)
    f = spark.createDataFrame([("a", datetime.datetime(2024, 1, 1)), ("b", datetime.datetime(2024, 1, 1, 0, 0, 8))], "path string, modificationTime timestamp")
    ready, later = watch.stable(f, now)
    assert [r["path"] for r in ready.collect()] == ["a"] and [r["path"] for r in later.collect()] == ["b"]
    i = spark.createDataFrame([("a", False), ("b", True), ("c", False)], "path string, has_transcript boolean")
    s = spark.createDataFrame([("c", "completed"), ("b", "in_progress")], "path string, state string")
    assert {r["path"]: r["task"] for r in watch.pending(i, s).collect()} == {"a": "transcribe", "b": "postprocess", "c": "skip"}


def test_windows_on_a_stream(spark):
    s = spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").option("pathGlobFilter", "events.parquet").parquet("/root/testdata/sf0.001")
    s = s.selectExpr("cast(ts as timestamp) ts", "event_type", "value")
    q = watch.turn_counts(s).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counts").count() > 0
