"""Streams with state, engines as table functions, augmentation, staged runs and progress: small scenarios with known results."""

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.operators import augment, discovery, stages
from parlance.sources import engines, readers
from parlance.streaming import progress, state, watch


def put(folder, name, rows):
    """One JSON-lines file, complete at once."""
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f".{name}").write_text("".join(json.dumps(r) + "\n" for r in rows))
    (folder / f".{name}").rename(folder / name)


def rows_of(spark, out):
    try:
        return sorted(map(tuple, spark.read.parquet(f"file://{out}").collect()))
    except Exception as e:
        if readers.missing(e) or "Unable to infer schema" in str(e):
            return []
        raise


def run(spark, make, source, schema, out, checkpoint, available=False):
    s = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"file://{source}"))
    w = s.writeStream.format("parquet").option("path", f"file://{out}").option("checkpointLocation", f"file://{checkpoint}").outputMode("append")
    return (w.trigger(availableNow=True) if available else w.trigger(processingTime="300 milliseconds")).start()


def until(query, done, seconds=60):
    end = time.time() + seconds
    while not done():
        assert time.time() < end and query.exception() is None, query.exception()
        time.sleep(0.2)


LISTING = "path string, modified long, bytes long"


def test_files_that_change_are_asked_again(spark, tmp_path):
    state.with_state_store(spark)
    src, out, check = tmp_path / "in", tmp_path / "out", tmp_path / "check"
    make = lambda s: state.settled_files(s, 2.0)
    now = int(time.time() * 1000)
    put(src, "1.json", [{"path": "old.wav", "modified": now - 60_000, "bytes": 5}, {"path": "fresh.wav", "modified": now + 60_000, "bytes": 1}, {"path": None, "modified": 1, "bytes": 1}])
    q = run(spark, make, src, LISTING, out, check)
    until(q, lambda: ("old.wav", now - 60_000, 5) in rows_of(spark, out))
    later = int(time.time() * 1000) + 2000
    put(src, "2.json", [{"path": "fresh.wav", "modified": later, "bytes": 9}, {"path": "old.wav", "modified": now - 60_000, "bytes": 5}])
    until(q, lambda: any(r["numInputRows"] == 2 for r in q.recentProgress))
    q.stop()
    # a restart from the checkpoint remembers what is being waited for
    q = run(spark, make, src, LISTING, out, check)
    until(q, lambda: ("fresh.wav", later, 9) in rows_of(spark, out))
    q.stop()
    assert rows_of(spark, out) == [("fresh.wav", later, 9), ("old.wav", now - 60_000, 5)] and int(time.time() * 1000) >= later + 2000


def test_sessions_wait_for_all_parts(spark, tmp_path):
    state.with_state_store(spark)
    src, out, check = tmp_path / "in", tmp_path / "out", tmp_path / "check"
    schema = "path string, session string, part int, total int"
    part = lambda p, s, k, n: {"path": p, "session": s, "part": k, "total": n}
    put(src, "1.json", [part("a1", "7", 1, 3), part("b", "8", 1, 1), part("a1 again", "7", 1, 3), part("x", "7", 4, 3), part("other", "7", 1, 2)])
    put(src, "2.json", [part("a3", "7", 3, 3)])
    run(spark, state.released_sessions, src, schema, out, check, True).awaitTermination(120)
    assert [r[0] for r in rows_of(spark, out)] == ["8"]
    put(src, "3.json", [part("a2", "7", 2, 3), part("b", "8", 1, 1), part("no", None, 1, 1)])
    put(src, "4.json", [part("a2 late", "7", 2, 3)])
    run(spark, state.released_sessions, src, schema, out, check, True).awaitTermination(120)
    assert rows_of(spark, out) == [("7", 3, ["a1", "a2", "a3"]), ("8", 1, ["b"])]


def test_stages_that_stall_or_grow(spark, tmp_path):
    state.with_state_store(spark)
    src, out, check = tmp_path / "in", tmp_path / "out", tmp_path / "check"
    line = lambda stage, status, rss, t: {"timestamp": f"2024-01-01T00:00:0{t}", "stage": stage, "status": status, "rss_bytes": rss}
    put(src, "1.json", [line("slow", "started", 10, 1), line("big", "started", 900, 1), line("big", "completed", 800, 2), line("fine", "started", 5, 1), line("fine", "completed", None, 2)])
    q = run(spark, lambda s: state.stream_alarms(s, 1.5, 500), src, watch.METRIC, out, check)
    until(q, lambda: sum(r[:2] == ("slow", "stall") for r in rows_of(spark, out)) >= 2)
    put(src, "2.json", [line("slow", "completed", 20, 5), line("big", "started", 950, 6), line("big", "failed", 40, 7)])
    until(q, lambda: any(r[3] == 950 for r in rows_of(spark, out)))
    q.stop()
    got = {r for r in rows_of(spark, out)}
    assert got == {("slow", "stall", "started", 10), ("big", "memory", "completed", 900), ("big", "memory", "failed", 950)}


def test_engine_feeds_the_word_join(spark, tmp_path):
    """Files through an engine as a table function, to words, to the turns they overlap."""
    from parlance.operators.intervals import label_by_overlap

    files = spark.createDataFrame([("a.wav", b"ann 0 hello there\nbob 2 good day you"), ("b.wav", b"zoe 1 hi"), ("bad.wav", b"x notanumber w"), ("empty.wav", None)], "path string, content binary").repartition(3)
    words = engines.transcribed(files, "engines_for_tests:reader").cache()
    got = sorted((r["path"], r["seg_idx"], r["word_idx"], r["speaker"], r["word"], r["start"]) for r in words.where("error is null").collect())
    assert got == [("a.wav", 0, 0, "ann", "hello", 0.0), ("a.wav", 0, 1, "ann", "there", 0.5), ("a.wav", 1, 0, "bob", "good", 2.0), ("a.wav", 1, 1, "bob", "day", 2.5), ("a.wav", 1, 2, "bob", "you", 3.0), ("b.wav", 0, 0, "zoe", "hi", 1.0)]
    assert [(r["path"], "ValueError" in r["error"]) for r in words.where("error is not null").collect()] == [("bad.wav", True)]
    s = {(r["file"], r["start"]): r for r in engines.segments_of(words).collect()}
    assert s["a.wav", 2.0]["text"] == "good day you" and [w["word"] for w in s["a.wav", 2.0]["words"]] == ["good", "day", "you"] and len(s) == 3
    turns = spark.createDataFrame([("a.wav", 0, 0.0, 2.4, "S1"), ("a.wav", 1, 2.4, 9.0, "S2")], "session string, turn_idx long, start double, end double, speaker string")
    w = words.where("error is null and path = 'a.wav'").selectExpr("path as session", "seg_idx", "word_idx", "start", "end")
    assert {(r["seg_idx"], r["word_idx"]): r["turn_speaker"] for r in label_by_overlap(w, turns).collect()} == {(0, 0): "S1", (0, 1): "S1", (1, 0): "S1", (1, 1): "S2", (1, 2): "S2"}


def test_a_model_of_ones_own(spark):
    v = spark.createDataFrame([("s", 0, [1.0]), ("s", 1, [-0.5]), ("s", 2, [0.0]), ("s", 3, None)], "session string, seg_idx long, embedding array<double>")
    got = sorted((r["seg_idx"], r["rank"], r["speaker"], r["score"]) for r in engines.scored_by(v, "engines_for_tests:sides").collect())
    assert got == [(0, 1, "right", 1.0), (0, 2, "left", 0.0), (1, 1, "left", 0.75), (1, 2, "right", 0.25), (2, 1, "left", 0.5), (2, 2, "right", 0.5)]


@pytest.mark.parametrize("profile", ["light", "heavy"])
def test_augmentation_does_not_depend_on_partitions(spark, profile):
    r = np.random.default_rng(1)
    rows = [(i, 16000, [float(x) for x in np.sin(np.arange(n) / 9) * 0.4 + r.normal(0, 0.02, n)]) for i, n in enumerate([0, 5, 31, 64, 200, 1000, 4000])] + [(90, 16000, [0.0] * 300), (91, 16000, None)]
    df = spark.createDataFrame(rows, "row_id long, sample_rate int, samples array<float>")
    one = {(x["row_id"], x["pass_index"]): x["samples"] for x in augment.augmented_passes(df.coalesce(1), ["row_id"], profile, 3).collect()}
    many = {(x["row_id"], x["pass_index"]): x["samples"] for x in augment.augmented_passes(df.repartition(8), ["row_id"], profile, 3).collect()}
    assert one == many and len(one) == 36
    for i, _, x in rows:
        assert one[i, 0] == (None if x is None else [float(np.float32(v)) for v in x])
        for p in (1, 2, 3):
            y = one[i, p]
            if x:
                assert len(y) == len(x) and np.isfinite(y).all() and max(map(abs, y)) <= max(0.98, max(map(abs, x))) + 1e-6
    assert one[6, 1] != one[6, 2] != one[6, 3] and max(map(abs, one[90, 1])) < 1e-5 and one[91, 2] is None
    own = augment.augment(df.where("row_id = 5"), F.lit(3), change=lambda x, rate, rng: x * 0).first()["samples"]
    assert set(own) == {0.0} and augment.augment(df, F.lit(1), "none") is df


def test_each_change_by_hand():
    r = lambda: np.random.default_rng(7)
    x, rate = np.sin(2 * np.pi * 1000 * np.arange(1600) / 16000) + np.sin(2 * np.pi * 6000 * np.arange(1600) / 16000), 16000
    assert np.allclose(augment.gain(x, rate, r(), (6.0, 6.0)), x * 10**0.3)
    assert np.allclose(augment.band(x, rate, r(), (100, 100), (3000, 3000)), np.sin(2 * np.pi * 1000 * np.arange(1600) / 16000), atol=1e-9)
    n = augment.noise(x, rate, r(), (20.0, 20.0)) - x
    assert abs(augment.rms(n) / (augment.rms(x) / 10) - 1) < 0.1
    low = np.abs(np.fft.rfft(augment.resample(x, rate, r(), (8000,))))
    assert low[600] < 0.5 * low[100]  # 6 kHz is beyond what 8000 samples a second hold
    assert np.allclose(augment.clip(np.array([0.0, 1.0]), rate, r(), (2.0, 2.0)), [0.0, 1.0])
    wet = augment.reverb(np.eye(1, 2000)[0], rate, r())
    assert wet[0] > 0.9 and 0 < abs(wet[100]) < 0.1 and np.allclose(wet[600:], 0, atol=1e-12)
    d = augment.dropout(np.ones(4000), rate, r(), (2, 2))
    assert 90 < (d < 0.3).sum() < 1000 and set(augment.CHANGES) == {"gain", "noise", "band", "resample", "reverb", "clip", "dropout"}


def test_only_what_hangs_on_a_change_is_built_again(spark, tmp_path):
    folder, calls = f"file://{tmp_path}/run", []

    def stage(name, *inputs, **config):
        def build(tables, config):
            calls.append(name)
            rows = [t.select(F.sum("x").alias("x")) for t in tables.values()]
            out = rows[0]
            for r in rows[1:]:
                out = out.unionByName(r)
            return out.withColumn("x", F.col("x") + config.get("add", 0))

        return stages.Stage(name, inputs, build, config)

    table = lambda n: spark.range(n).select(F.col("id").alias("x"))
    plan = lambda add=0: [stage("report", "windows", "pool"), stage("windows", "audio"), stage("pool", "labels", add=add), stage("model", "pool")]
    go = lambda audio, labels, add=0, **k: stages.run_stages(spark, folder, plan(add), {"audio": (table(audio), f"a{audio}"), "labels": (table(labels), f"l{labels}")}, **k)
    told = []
    p = progress.Progress(spark, f"file://{tmp_path}/log", lambda s, f: told.append((s, f["status"])))
    tables, built = go(5, 4, progress=p)
    assert built == calls == ["windows", "pool", "report", "model"] and sorted(r["x"] for r in tables["report"].collect()) == [6, 10]
    assert told[:2] == [("windows", "started"), ("windows", "completed")]
    calls.clear()
    assert go(5, 4)[1] == [] == calls
    assert go(6, 4)[1] == ["windows", "report"]  # one input changed
    assert go(6, 4, add=1)[1] == ["pool", "report", "model"]  # one setting changed
    assert go(6, 4, add=1, force=("pool",))[1] == ["pool", "report", "model"]
    told.clear()
    assert go(6, 4, add=1, progress=p)[1] == [] and {s for _, s in told} == {"reused"}
    with pytest.raises(ValueError, match="circle"):
        stages.ordered([stage("a", "b"), stage("b", "a")], set())
    with pytest.raises(ValueError, match="names of their own"):
        stages.ordered([stage("a"), stage("a")], set())
    # a stage that fails leaves no table that passes for done
    bad = [stages.Stage("windows", ("audio",), lambda t, c: t["audio"].select(F.raise_error(F.lit("boom")).cast("long").alias("x")), {"v": 2})]
    with pytest.raises(Exception, match="boom"):
        stages.run_stages(spark, folder, bad, {"audio": (table(6), "a6")}, progress=p)
    assert told[-1] == ("windows", "failed") and go(6, 4, add=1)[1] == ["windows", "report"]
    assert stages.folder_signature(spark, folder) == stages.folder_signature(spark, folder)


def test_progress_counts_without_a_second_job(spark, tmp_path):
    told = []
    p = progress.Progress(spark, f"file://{tmp_path}/log", lambda s, f: told.append((s, f["status"], f.get("rows"))), "session 4")
    facts = p.write(spark.range(50), f"file://{tmp_path}/out", "count", most=F.max("id"))
    assert facts == {"rows": 50, "most": 49} and told == [("count", "started", None), ("count", "completed", 50)]
    with pytest.raises(Exception, match="boom"):
        p.write(spark.range(3).select(F.raise_error(F.lit("boom"))), f"file://{tmp_path}/bad", "bad")
    log = readers.read_records(spark, f"file://{tmp_path}/log", "stage string, status string, session string, elapsed_seconds double, rss_bytes long, cpu_seconds double, rows long")
    assert sorted((r["stage"], r["status"], r["rows"]) for r in log.collect()) == [("bad", "failed", None), ("bad", "started", None), ("count", "completed", 50), ("count", "started", None)]
    assert all(r["rss_bytes"] > 0 and r["cpu_seconds"] > 0 and r["session"] == "session 4" for r in log.collect())
    seen = []
    listener = progress.StreamProgress(lambda name, f: seen.append((name, f["status"], f.get("rows"))))
    spark.streams.addListener(listener)
    put(tmp_path / "in", "1.json", [{"x": 1}, {"x": 2}])
    spark.readStream.schema("x int").json(f"file://{tmp_path}/in").writeStream.queryName("told").format("noop").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(60)
    end = time.time() + 20
    while ("told", "completed", None) not in seen and time.time() < end:
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    assert ("told", "started", None) in seen and ("told", "running", 2) in seen and ("told", "completed", None) in seen


def test_moves_and_quarantine(spark, tmp_path):
    for f in ("in/a.zip", "in/a.json", "in/b.wav", "done/a.json"):
        (tmp_path / f).parent.mkdir(exist_ok=True)
        (tmp_path / f).write_text(f)
    at = lambda *names: spark.createDataFrame([(f"{tmp_path}/{n}",) for n in names], "path string")
    moves = discovery.bundle_moves(at("in/a.zip", "in/b.wav"), at("in/a.zip", "in/a.json", "in/b.wav"), at("done/a.json"), f"{tmp_path}/done")
    moves = spark.createDataFrame(moves.collect(), moves.schema)  # the plan, before anything moves
    want = {"in/a.zip": "done/a__2.zip", "in/a.json": "done/a__2.json", "in/b.wav": "done/b.wav"}
    assert {r["path"]: r["target"] for r in moves.collect()} == {f"{tmp_path}/{a}": f"{tmp_path}/{b}" for a, b in want.items()}
    (tmp_path / "done/b.wav").write_text("something else")
    assert sorted((r["path"].rsplit("/", 1)[1], r["outcome"]) for r in discovery.moved(moves).collect()) == [("a.json", "moved"), ("a.zip", "moved"), ("b.wav", "taken")]
    assert (tmp_path / "done/a__2.json").read_text() == "in/a.json" and (tmp_path / "done/b.wav").read_text() == "something else"
    again = discovery.moved(moves.where("path not like '%wav'").union(at("in/none.mp3").withColumn("target", F.lit(f"{tmp_path}/done/none.mp3"))))
    assert sorted(r["outcome"] for r in again.collect()) == ["missing", "there", "there"]
    t = lambda k: f"2024-01-01 00:00:{k:02d}"
    rows = [("x", "failed", t(i)) for i in range(3)] + [("y", "failed", t(1)), ("y", "completed", t(2)), ("y", "failed", t(3)), ("y", "failed", t(4)), ("z", "started", t(5))]
    status = spark.createDataFrame(rows, "path string, state string, at string").withColumn("at", F.col("at").cast("timestamp"))
    assert [tuple(r) for r in discovery.failing(status).collect()] == [("x", 3)]


def test_folders_are_known_by_all_their_files(spark):
    rows = [(f"in/s{i % 2}/t{i}.wav", 10 * i, f"2024-01-0{i + 1}") for i in range(6)] + [("in/top.wav", 1, "2024-01-01")]
    df = spark.createDataFrame(rows, "path string, length long, modificationTime string")
    ids = lambda d: {r["folder"]: (r["files"], r["id"]) for r in discovery.folder_identity(d, 2).collect()}
    a = ids(df)
    assert {k: v[0] for k, v in a.items()} == {"in/s0": 3, "in/s1": 3} and a == ids(df.orderBy(F.desc("path")).repartition(4))
    b = ids(df.withColumn("length", F.when(F.col("path") == "in/s1/t3.wav", 31).otherwise(F.col("length"))))
    assert b["in/s0"] == a["in/s0"] and b["in/s1"] != a["in/s1"]


def test_transcripts_whose_names_hold_the_source(spark):
    sources = spark.createDataFrame([("in/foo bar.zip",), ("in/Ab.zip",), ("in/session 12.zip",)], "source string")
    files = spark.createDataFrame([("t/my foo bar folder/my foo bar.jsonl",), ("t/xaby/zab.jsonl",), ("t/foo/bar.jsonl",), ("t/a/session 12.txt",), ("t/foo_bar/test foo_bar.txt",)], "path string")
    got = {r["source"]: (r["transcript"], r["points"]) for r in discovery.transcript_of(sources, files).collect()}
    assert got == {"in/foo bar.zip": ("t/foo_bar/test foo_bar.txt", 20.0 + 120 + 30 + 20 - 20), "in/Ab.zip": ("t/xaby/zab.jsonl", 90.0), "in/session 12.zip": ("t/a/session 12.txt", 20.0 + 200 + 100 + 30)}
    alone = discovery.transcript_of(sources.limit(1), files.where("path like 't/my%'")).first()
    assert alone["points"] == 90.0


def test_transcripts_of_many_alike_names_are_few_pairs(spark, monkeypatch):
    """4,000 sources and 4,000 transcripts of one session and with one ending: a pair of each with each would be 16 million."""
    sources = spark.range(4000).select(F.concat(F.lit("in/session 7 take "), "id", F.lit(" 1_3.zip")).alias("source"))
    files = spark.range(4000).select(F.concat(F.lit("out/x/session 7 take "), "id", F.lit(" 1_3"), F.when(F.col("id") % 2 == 0, ".txt").otherwise(" x.txt")).alias("path"))
    points, pairs = discovery.likeness, spark.sparkContext.accumulator(0)
    count = F.udf(lambda x: pairs.add(1), "double")
    monkeypatch.setattr(discovery, "likeness", lambda path, wanted: points(path, wanted) + F.coalesce(count(path), F.lit(0.0)))
    for most in (100_000, 0):  # by beginnings and lengths of names, and by lengths alone
        monkeypatch.setattr(discovery, "BROADCAST_HEADS", most)
        got = {r["source"]: (r["transcript"], r["points"]) for r in discovery.transcript_of(sources, files).collect()}
        want = lambda i: (f"out/x/session 7 take {i} 1_3.txt", 20.0 + 200 + 100 + 30) if i % 2 == 0 else (f"out/x/session 7 take {i} 1_3 x.txt", 20.0 + 100 + 30)
        assert got == {f"in/session 7 take {i} 1_3.zip": want(i) for i in range(4000)}
    assert 8000 <= pairs.value < 1_000_000


def test_moves_of_many_inputs_of_one_name(spark):
    """Free numbers are counted, not listed for each input; 0 and repeated numbers in the archive take nothing."""
    inputs = spark.range(60_000).select(F.format_string("in/%06d/a.wav", "id").alias("path"))
    there = spark.range(1, 60_001).select(F.concat(F.lit("done/a__"), (F.col("id") * 2).cast("string"), F.lit(".wav")).alias("path")).union(spark.createDataFrame([("done/a__0.wav",), ("done/x/a__2.wav",), ("done/b.wav",)], "path string"))
    got = {r["path"]: r["target"] for r in discovery.archive_moves(inputs, there, "done").collect()}
    assert got == {f"in/{i:06d}/a.wav": "done/a.wav" if i == 0 else f"done/a__{2 * i + 1}.wav" for i in range(60_000)}


def test_watched_folder_from_arrival_to_archive(spark, tmp_path):
    """One file is done and archived with its companion, one fails three times and goes to quarantine, one is too young."""
    import datetime

    root = tmp_path / "in"
    now = datetime.datetime(2024, 1, 1, 12, 0, 0)
    for f in ("good 1.zip", "good 1.json", "bad.wav", "young.wav"):
        root.mkdir(exist_ok=True)
        (root / f).write_text(f)

    def listing():
        rows = [(str(p), now + datetime.timedelta(seconds=0 if p.name == "young.wav" else -60)) for p in root.rglob("*") if p.is_file()]
        return spark.createDataFrame(rows, "path string, modificationTime timestamp")

    status, worked, none = f"file://{tmp_path}/status", [], spark.createDataFrame([], "path string")

    def transcribe(paths):
        worked.extend(r["path"].rsplit("/", 1)[1] for r in paths.collect())
        if any(w == "bad.wav" for w in worked[-paths.count() :]):
            raise RuntimeError("cannot decode")

    step = lambda only, out: watch.watch_step(spark, listing().where(F.col("path").like(f"%{only}%")), status, out, transcribe, lambda paths: None, now, backfill=True)
    assert [r["task"] for r in step("good", none).collect()] == ["transcribe"]
    text = spark.createDataFrame([(f"{tmp_path}/out/good 1.txt",)], "path string")
    assert [r["task"] for r in step("good", text).collect()] == ["postprocess"]
    for _ in range(3):
        with pytest.raises(RuntimeError, match="decode"):
            step("bad", none)
    assert step("young", none).count() == 0 and worked == ["good 1.zip", "bad.wav", "bad.wav", "bad.wav"]
    from parlance.sources.writers import set_state, states

    # a file that fails after it was transcribed is still to be postprocessed, not to be skipped
    one = spark.createDataFrame([("z.wav",)], "path string")
    set_state(spark, status, one, "transcribed")
    set_state(spark, status, one, "failed")
    assert {r["path"]: r["state"] for r in states(spark, status, without=("failed",)).collect()}["z.wav"] == "transcribed"
    got = {(r["path"].rsplit("/", 1)[1], r["target"].replace(str(root), ""), r["outcome"]) for r in watch.archive_step(spark, listing(), status, str(root)).collect()}
    assert got == {("good 1.zip", "/processed/good 1.zip", "moved"), ("good 1.json", "/processed/good 1.json", "moved"), ("bad.wav", "/quarantine/bad.wav", "moved")}
    assert sorted(str(p.relative_to(root)) for p in root.rglob("*") if p.is_file()) == ["processed/good 1.json", "processed/good 1.zip", "quarantine/bad.wav", "young.wav"]
    assert watch.archive_step(spark, listing(), status, str(root)).count() == 0
