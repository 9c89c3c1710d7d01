"""The corpus operators against brute force, and their defined cases."""

import collections
import gzip
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, word string"


def documents(spark, texts):
    """With further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "src0", len(t or ""), 0, "x") for i, t in enumerate(texts)], DOCS)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def shingle_set(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# -- 1 packing
def test_packing_places_every_piece_once(spark):
    import public_tokenizers as P

    from parlance.llm.packing import pack_documents

    texts = ["word " * n for n in (1, 5, 40, 700, 5000, 2047, 3)] + [None, "", "a" * 9000] + ["same text"] * 40
    got = pack_documents(documents(spark, texts), P.path("byte_bpe_50k.json"), P.PATTERN).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(range(len(texts)))
    for rows in by_doc.values():
        rows.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in rows] == list(range(len(rows)))
        assert rows[0]["start"] == 0 and all(a["start"] + a["length"] == b["start"] for a, b in itertools.pairwise(rows))
        assert all(r["length"] == 2048 for r in rows[1:])
    for spans in by_seq.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(spans)) and sum(spans[-1]) <= 2048


def test_pieces_equal_the_tokenizers(spark):
    """Length and checksum of every piece of sf0.001 and of odd texts, against default `tokenizers`."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from parlance.llm.packing import pieces_of, token_pieces

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    texts += ["", None, " ", "a  b\n\n c", "don't stop", "été naïve 12 345", "x" * 300, "<|endoftext|> a", "a<|endoftext|>", "Der eingeä erer.%%% athe***", " " * 1_000_000, "\n" * 1_000_000, "a" + "\u3000 \t" * 3000 + "b", "y" * 50_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = collections.defaultdict(list)
    for r in token_pieces(docs, P.path("byte_bpe_50k.json"), P.PATTERN).collect():
        got[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for i, text in enumerate(texts):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        want = [(j, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for j, (a, b) in enumerate(itertools.pairwise(cuts))]
        assert sorted(got[i]) == want, (i, (text or "")[:40])
    ids = np.arange(5, dtype="<u4").tobytes()
    assert list(pieces_of(ids, 4, 0)) == [(0, 0, 2, zlib.crc32(ids[:8])), (1, 2, 4, zlib.crc32(ids[8:] + b"\0\0\0\0"))]


def test_packing_of_odd_tables(spark):
    import public_tokenizers as P

    from parlance.llm.packing import pack_documents

    kind = "doc_id long, text string, length string, rank int, salt int, slot int, before int"
    rows = [(1, "same", "x", 0, 0, 0, 0)] * 3 + [(None, "no id", "x", 0, 0, 0, 0), (2, "same", None, None, None, None, None)]
    path = P.path("byte_bpe_50k.json")
    got = pack_documents(spark.createDataFrame(rows, kind), path, P.PATTERN).collect()
    assert sorted(((r["doc_id"] or -1), r["length"]) for r in got) == [(-1, 3), (1, 2), (1, 2), (1, 2), (2, 2)]
    assert sorted(r["offset"] for r in got) == [0, 3, 5, 7, 9] and len({r["sequence_id"] for r in got}) == 1
    assert pack_documents(spark.createDataFrame([], kind), path, P.PATTERN).count() == 0


def test_packing_plan_is_close_to_the_bound():
    from parlance.llm.packing import plan_patterns

    r = random.Random(1)
    counts = collections.Counter(min(2048, int(r.lognormvariate(5.5, 1.2)) + 1) for _ in range(30000))
    plan = plan_patterns(dict(counts), 2048)
    used = collections.Counter()
    for n, lengths in plan:
        assert sum(lengths) <= 2048
        for x in lengths:
            used[x] += n
    assert used == counts
    assert sum(n for n, _ in plan) <= 1.01 * -(-sum(k * n for k, n in counts.items()) // 2048)


# -- 2 near duplicates
def mutated(r, words, share):
    return [r.choice(["zu", "ve", "ka", "lo"]) + str(r.randrange(1000)) if r.random() < share else w for w in words]


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_components_equal_brute_force(spark, k, percent):
    from parlance.llm.jaccard import jaccard_components

    r = random.Random(k)
    texts = ["one two three", "ONE two\tthree ", "", None, "\n\t", "a b c d", "alone"]
    shared = [f"p{i}" for i in range(60)]
    for _ in range(12):
        base = [r.choice("abcdefghij") + str(r.randrange(300)) for _ in range(r.choice([6, 20, 80, 400]))]
        texts += [" ".join(mutated(r, base, x)) for x in (0, 0, 0.005, 0.01, 0.02, 0.03, 0.05)]
    for _ in range(30):
        texts.append(" ".join(shared + [f"q{r.randrange(10**6)}" for _ in range(r.choice([10, 40]))]))
    sets = {i: shingle_set(t, k) for i, t in enumerate(texts)}
    linked = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = components(sets, linked)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard_components(documents(spark, texts), k, percent).collect()}
    assert got == {i: (len(s), want[i]) for i, s in sets.items()}


def test_sketches_of_different_length_are_compared(spark):
    from parlance.llm.jaccard import _near, sketch

    x = np.random.default_rng(1).integers(0, 1 << 63, 1300).astype(np.uint64)
    sets = {1: x[:256], 2: x[:257], 3: x[100:357], 4: x[:128], 5: x[:520]}
    rows = [(i, len(v), sketch(v).tolist()) for i, v in sets.items()]
    table = spark.createDataFrame(rows, "node long, n long, sketch array<long>")
    pairs = spark.createDataFrame([(1, 2), (2, 1), (1, 3), (4, 5), (5, 4), (1, 1)], "a long, b long")
    got = {(r["a"], r["b"]): r["bound"] for r in _near(pairs, table, 85).collect()}
    assert got == {(1, 2): 1, (2, 1): 1, (1, 1): 0}
    bounds = {(r["a"], r["b"]): r["bound"] for r in _near(pairs, table, 0).collect()}
    assert bounds.keys() == {(1, 2), (2, 1), (1, 3), (4, 5), (5, 4), (1, 1)}
    assert all(v <= len(np.setxor1d(sets[a], sets[b])) for (a, b), v in bounds.items()) and bounds[4, 5] == bounds[5, 4] > 0


@pytest.mark.parametrize("percent", [70, 80, 85, 95])
def test_signatures_lose_no_link(percent):
    from parlance.llm.jaccard import signatures

    r = np.random.default_rng(0)
    for size in (1, 5, 7, 12, 30, 100, 500, 3000):
        for _ in range(10):
            a = np.unique(r.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2))
            most = (100 - percent) * 2 * len(a) // (100 + percent)
            out = most // 2 if r.random() < 0.5 else int(r.integers(0, most // 2 + 1))
            b = np.unique(np.concatenate([a[out:], r.integers(0, 1 << 63, out).astype(np.uint64)]))
            inter = len(np.intersect1d(a, b))
            if out:
                assert 100 * inter < percent * (len(a) + len(b) - inter) or np.intersect1d(signatures(a, percent, 1 << 13), signatures(b, percent, 1 << 13)).size


def test_empty_tables(spark):
    from parlance.llm.embeddings import near_duplicates
    from parlance.llm.jaccard import jaccard_components
    from parlance.llm.mixing import mixing_rates
    from parlance.llm.ppm import score_documents
    from parlance.llm.quality import quality_rules
    from parlance.llm.toxicity import score_toxicity
    from parlance.llm.urls import filter_urls, production_list
    from parlance.llm.warc import archive_round_trip

    docs, none = documents(spark, []), labels(spark)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    no = F.lit(False)
    for got in (jaccard_components(docs), mixing_rates(docs, none), quality_rules(docs, none), score_documents(docs, no), score_toxicity(docs, none, no), archive_round_trip(pages), filter_urls(pages, production_list(spark)), near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))):
        assert got.count() == 0


# -- 3 mixing
def test_rates_meet_targets(spark):
    from parlance.llm.mixing import mix, mixing_rates

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    targets = {"en": 0.4, "de": 0.3, "fr": 0.2, "es": 0.1}
    got = mixing_rates(docs, spark.read.parquet(f"{SF}/labels.parquet"), targets=targets).toPandas()
    p = np.stack(got["posterior"].to_numpy())
    total = (p * (got["tokens"] * got["rate"]).to_numpy()[:, None]).sum(0)
    assert np.abs(total / total.sum() - list(targets.values())).max() < 0.002
    assert (got["rate"] >= 0).all() and len(got) == docs.count()
    assert mix(docs, spark.read.parquet(f"{SF}/labels.parquet"), targets=targets).columns == docs.columns


def test_replay_equals_the_plain_iteration():
    from parlance.llm.mixing import replay

    r = np.random.default_rng(1)
    p, w = r.dirichlet([0.3] * 3, 50), r.random(50)
    goal, step = np.array([5.0, 1.0, 3.0]), 0.05
    x, history = np.ones(50), []
    for _ in range(30):
        residual = p.T @ (w * x) - goal
        x = np.maximum(0, x - step * (p @ residual + 0.001 * (x - 1)))
        history.append(residual)
    assert np.allclose(replay(p, history, step, 0.001), x)


def test_rates_equal_a_plain_solver(spark):
    """The same least squares by many plain projected gradient steps on one machine."""
    from parlance.llm.mixing import fit_mixture, mixture_totals

    docs, some = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    targets = {"en": 0.3, "de": 0.3, "fr": 0.2, "es": 0.2}
    mixture, soft = fit_mixture(docs, some, targets=targets, pull=0.01)
    t = soft.toPandas()
    p, w, goal = np.stack(t["posterior"].to_numpy()), (t["tokens"] / t["tokens"].sum()).to_numpy(), np.array(list(targets.values()))
    share = p.T @ w
    goal = goal * (share / goal).max() * 1.004
    r, metric = np.ones(len(p)), np.linalg.inv(p.T @ (w[:, None] * p))
    for _ in range(20_000):
        r = np.maximum(0, r - mixture.step * (p @ (metric @ (p.T @ (w * r) - goal)) + 0.01 * (r - 1)))
    got = mixture.rates(p, t["tokens"].to_numpy())
    assert np.abs(p.T @ (w * got) / (p.T @ (w * r)) - 1).max() < 0.01 and np.abs(got - r).max() < 0.05
    rates = soft.withColumn("rate", F.lit(2.0))
    totals = {x["domain"]: x for x in mixture_totals(rates, targets).collect()}
    assert math.isclose(totals["de"]["expected_tokens"], 2 * (p[:, 1] * t["tokens"]).sum()) and math.isclose(sum(x["share"] for x in totals.values()), 1) and totals["de"]["target"] == 0.3


@pytest.mark.parametrize("rare", [1e-2, 1e-4, 1e-5])
def test_rare_domains_meet_their_targets(spark, rare):
    """A domain of a hundred-thousandth of the tokens, posteriors that are nearly sure, one domain that isn't there; against a plain solver."""
    from parlance.llm.mixing import fit_rates, replay

    r = np.random.default_rng(3)
    n, targets = 4000, np.array([0.5, 0.3, 0.2])
    who = np.where(np.arange(n) < 2500, 0, 1)
    tokens = r.integers(50, 400, n)
    who = np.append(who, [2] * 3)
    tokens = np.append(tokens, [max(1, int(rare * tokens.sum() / 3))] * 3)
    p = np.full((len(who), 3), 1e-7)
    p[np.arange(len(who)), who] = 1 - 2e-7
    p[:200] = r.dirichlet([3, 3, 0.01], 200)
    soft = spark.createDataFrame([(int(t), [float(x) for x in q]) for t, q in zip(tokens, p, strict=True)], "tokens long, posterior array<double>").repartition(4)
    history, step, missed = fit_rates(soft, targets)
    rates = replay(p, history, step, 1e-4)
    w = tokens / tokens.sum()
    got = p.T @ (w * rates)
    assert np.abs(got / got.sum() - targets).max() < 2e-3 * targets.min() and missed < 2e-3 and rates.min() >= 0 and len(history) < 20
    # the same least squares in its dual, by Newton's steps: rates max(0, 1 + posterior . x)
    goal, x = targets * ((p.T @ w) / targets).max() * 1.004, np.zeros(3)
    for _ in range(50):
        plain = np.maximum(0, 1 + p @ x)
        on = plain > 0
        x -= np.linalg.solve(p[on].T @ (w[on, None] * p[on]), p.T @ (w * plain) - goal)
    assert np.abs(p.T @ (w * plain) / got - 1).max() < 2e-3 and (rare < 1e-3 or np.abs(rates - plain).max() < 0.01 * plain.max())
    # no document of the third domain: the others keep their proportion
    few = soft.where("posterior[2] < 0.5")
    with pytest.warns(UserWarning, match="1 domains have no documents"):
        history, step, missed = fit_rates(few, targets)
    sure = np.array([x["posterior"] for x in few.collect()])
    t = np.array([x["tokens"] for x in few.collect()])
    got = sure.T @ (t / t.sum() * replay(sure, history, step, 1e-4))
    assert missed == 1 and abs(got[0] / got[1] - 5 / 3) < 0.01


def test_mixing_of_odd_documents(spark):
    from parlance.llm.mixing import mixing_rates

    got = {r["doc_id"]: r for r in mixing_rates(documents(spark, [None, "", "a b"]), labels(spark)).collect()}
    assert got[0]["tokens"] == 0 and got[0]["rate"] == 1.0 and got[0]["copies"] == 1 and got[2]["tokens"] == 2


# -- 4 quality
def features(text):
    t = text or ""
    w = WORD.findall(t)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = collections.Counter(tri)
    hit = {i + j for i, x in enumerate(tri) if n[x] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_quality_counts_equal_brute_force(spark):
    from parlance.llm.quality import quality_rules

    texts = [None, "", " ", "a", "a b c a b c", "x x x x x", "é # ü <b>\n\né # ü <b>\nq", "a b c d a b c", "l1\r\nl1\nl1\n", "ab " * 60, "\x0b\x0c a\x85b   c"]
    r = random.Random(3)
    texts += [" ".join(r.choice("abcde") for _ in range(r.randrange(1, 120))) for _ in range(40)]
    got = {x["doc_id"]: x for x in quality_rules(documents(spark, texts), labels(spark)).collect()}
    for i, t in enumerate(texts):
        f = features(t)
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == f, (i, t)
        failed = f[0] < 50 or 100 * f[4] > 50 * f[0]
        assert got[i]["base_failed"] == failed and got[i]["kept"] == (not failed)


def test_binomial_bound(spark):
    from parlance.llm.quality import log_binomial_at_most

    cases = [(10, 3, 0.3), (400, 2, 0.02), (50, 44, 0.9), (30, 0, 0.1), (20_000, 60, 0.005), (5, 5, 0.9)]
    for n, k, p in cases:
        got = spark.createDataFrame([(k, n)], "k long, n long").select(log_binomial_at_most(F.col("k"), F.col("n"), p)).first()[0]
        want = math.log(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))) if n < 1000 else math.log(sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1)))
        assert math.isclose(got, want, rel_tol=1e-8, abs_tol=1e-12), (n, k, p)
    assert spark.createDataFrame([(7, 10)], "k long, n long").select(log_binomial_at_most(F.col("k"), F.col("n"), 0.2)).first()[0] == 0.0


def test_cutoffs_are_certified(spark):
    from parlance.llm.quality import quality_rules

    good = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(3000)]
    bad = [" ".join(f"w{i}$$$###{j}" for j in range(60)) for i in range(200)]
    docs = documents(spark, good + bad)
    rows = [(i, 1, 0) for i in range(3000)] + [(3000 + i, 0, 0) for i in range(100)]
    got = quality_rules(docs, labels(spark, rows)).groupBy("kept").agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).collect()
    assert sorted(tuple(r) for r in got) == [(False, 200, 3000, 3199), (True, 3000, 0, 2999)]


# -- 5 WARC
def test_archives_round_trip(spark):
    from parlance.llm.common import new_path
    from parlance.llm.warc import coalesced, parse, read_records, with_types, write_archives

    big = "ü<p>\r\n\r\nWARC/1.1\r\n" * 100
    rows = [(1, "http://a/", big), (2, "http://b/\r\nx", big), (3, None, "small"), (4, "u", "small"), (5, "e", None), (9, "z", big), (6, "one", "x" * 5000), (None, "n", "y" * 2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = new_path(spark, "warc")
    index = write_archives(with_types(pages), folder)
    got = {r["page_id"]: r for r in read_records(index, folder).collect()}
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items()} == {1: ("revisit", 9), 2: ("revisit", 9), 9: ("response", None), None: ("response", None), **{i: ("response", None) for i in (3, 4, 5, 6)}}
    assert all(got[i]["payload_bytes"] == len((h or "").encode()) for i, _, h in rows)
    assert all(got[i]["html"] == (h or "") for i, _, h in rows if got[i]["record_type"] == "response")
    assert read_records(index.where("page_id = 6"), folder).count() == 1
    assert [(a, b, len(r)) for a, b, r in coalesced([(0, 10), (10, 10), (500_000, 5)])] == [(0, 20, 2), (500_000, 500_005, 1)]
    assert read_records(index, folder, 100).rdd.getNumPartitions() > read_records(index, folder).rdd.getNumPartitions()
    head, body = parse(gzip.decompress(gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nH: 1\r\n\r\nab\r\n\r\n")))
    assert head["Content-Length"] == "9" and body == b"a"


def test_archives_are_read_by_as_many_tasks(spark):
    from parlance.llm.common import new_path
    from parlance.llm.warc import read_records, with_types, write_archives

    kind = "page_id long, url string, html string, payload_bytes int, last long, file string, offset int"
    rows = [(i % 30, f"u{i}", f"{i % 20} " * 900, 1, 2, "f", 3) for i in range(60)]
    folder = new_path(spark, "warc")
    index = write_archives(with_types(spark.createDataFrame(rows, kind).coalesce(1)), folder, archive_bytes=500)
    files = index.select("file").distinct().count()
    assert files > 5
    back = read_records(index, folder).withColumn("task", F.spark_partition_id()).collect()
    # page_id repeats every 30 rows, payloads every 20
    assert len(back) == 60 and len({r["task"] for r in back}) >= files - 1
    last = {k: max(i % 30 for i in range(60) if i % 20 == k) for k in range(20)}
    by_text = collections.Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in back)
    assert by_text == collections.Counter((i % 30, *(("response", None) if i % 30 == last[i % 20] else ("revisit", last[i % 20]))) for i in range(60))


# -- 6 HTML
def test_labeller_on_held_out_pages():
    from parlance.llm.extract import labeller
    from parlance.llm.html_blocks import vectors
    from parlance.llm.html_pages import labelled_pages

    pages = labelled_pages(200, seed=77)
    found = labeller().label([vectors(b) for b, _ in pages])
    hit = np.concatenate([p == y for p, (_, y) in zip(found, pages, strict=True)])
    assert hit.mean() > 0.99


def test_lstm_gradients():
    from parlance.llm.lstm import BiLstm, padded

    r = np.random.default_rng(0)
    m = BiLstm(5, 3)
    m.w = {k: v.astype(np.float64) for k, v in m.w.items()}
    x, mask = padded([r.normal(size=(n, 5)).astype(np.float32) for n in (4, 2)])
    y = r.random(mask.shape) > 0.5
    _, g = m.gradients(x, mask, y)
    for k, v in m.w.items():
        i = tuple(r.integers(0, s) for s in v.shape)
        old, e = v[i], 1e-2
        v[i] = old + e
        up = m.gradients(x, mask, y)[0]
        v[i] = old - e
        down = m.gradients(x, mask, y)[0]
        v[i] = old
        assert abs((up - down) / (2 * e) - g[k][i]) < 2e-3


def test_blocks_and_odd_pages(spark):
    from parlance.llm.extract import main_text
    from parlance.llm.html_blocks import blocks

    text = [b.text for b in blocks("<p>a&amp;b <b>c</b>d<br>e\n f<p>g<script>x='</p>'</script><!-- <p>no --><div title='>'>h</div>tail")]
    assert text == ["a&b cd e f", "g", "h", "tail"]
    page = "<html><body><nav><a href='/'>Home</a></nav><article><h1>A title</h1><p>First words of it, here.</p><p>Second one.</p></article><footer>&copy; x</footer></body></html>"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<"), (5, "u", "<article>" + "<p>long text here.</p>" * 3000)]
    got = {r["page_id"]: r for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1]["text"] == "A title\nFirst words of it, here.\nSecond one." and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == "" and got[3]["text"] == "" and got[5]["text"].count("long text here.") == 3000


def test_blocks_keep_text_of_and_after_embedded_elements():
    from parlance.llm.html_blocks import blocks

    text = lambda page: " ".join(b.text for b in blocks(page)).split()
    assert [b.text for b in blocks('<p>One <svg class="i"/> two</p><p>three</p>')] == ["One two", "three"]
    for tag in "svg math noscript template object canvas select option button".split():
        assert text(f"<p>a <{tag} class=x>b</{tag}> c</p><p>d</p>") == list("abcd"), tag
        assert text(f"<article><p>a <{tag}>b<p>c</p></article><p>d</p>") == list("abcd"), tag
        assert [t for t, _ in blocks(f"<div><{tag}>a</{tag}></div>")[0].path] == ["div", tag]
    assert [b.path for b in blocks("<select><option>a<option>b</select>")] == [(("select", ()), ("option", ()))] * 2
    for tag in ("script", "style", "textarea", "iframe", "noembed"):
        assert text(f"<p>a<{tag}>b<p>c</{tag}> d") == ["a", "d"], tag
        assert text(f"<p>a <{tag}>b</{tag} x></{tag}>d<{tag}>rest") == ["a", "d"], tag


def test_markup_is_read_as_html_reads_it():
    """Quotes count only where a value begins; a tag once begun ends at >; comments and raw text as HTML has them."""
    from parlance.llm.html_blocks import blocks

    text = lambda page: [b.text for b in blocks(page)]
    assert text("<p>it's <a href=foo'bar>link</a> here</p>") == ["it's link here"]
    assert text("""<p a="x>y" b='z>w' c = "q>" d=e"f>one</p><p title="it's">two</p>""") == ["one", "two"]
    assert text("<p>a < b and 3<4, 5 <6> x</p>") == ["a < b and 3<4, 5 <6> x"]
    assert text("<p>a<!-- x > -->b<!-->c<!--->d<!-- - -- -->e<!DOCTYPE x>f<?php y ?>g</p>") == ["abcdefg"]
    assert text("<p>one<!-- never closed <p>two") == ["one"] and text("<p>one<p class='x>two</p>") == ["one"] and text("<p>one</p><p") == ["one"]
    assert text("<p>x<br/>y<img src=a>z</p><script>if (a<b) '</scripty>'</SCRIPT ><p>w</p>") == ["x yz", "w"]
    assert text("<div =x a==b c='1'd='2'>t</div>") == ["t"] and text("") == text("<") [:0] == [] and text("<") == ["<"]
    assert [t for t, _ in blocks("<ul><li>a<li>b<ul><li>c</ul></ul>")[-1].path] == ["ul", "li", "ul", "li"]


def test_pages_take_time_in_proportion_to_their_length():
    """Pages that made an earlier scan go back and forth: a megabyte of each in seconds."""
    import time

    from parlance.llm.extract import extract_texts, labeller
    from parlance.llm.html_blocks import DEPTH, blocks

    model = labeller()
    took = lambda f: (lambda t: (f(), time.process_time() - t)[1])(time.process_time())
    n = 330_000
    for page in ("<a " * n, "<!" * n, "<script " * (n // 8), "<p a='" * (n // 6), "</div>" * (n // 6), "<p><center>" * (n // 10), "<textarea>" * (n // 10), "<a href=\"x" * (n // 9), "< " * n, "&amp" * n, "<!--" * n, "</script " * (n // 9), "class " * n + ">", "<p " + "class " * n + ">x"):
        assert took(lambda page=page: blocks(page)) < 2.5, page[:20]
    deep = "<div>x" * 100_000
    assert took(lambda: blocks(deep)) < 2.5 and all(len(b.path) <= DEPTH for b in blocks(deep))
    assert len(extract_texts([deep, "<article><p>Some words of a text.</p></article>"], model)) == 2


#: Pages written and labelled by hand: the text that is the article, block by block.
BY_HAND = [
    ("<html><head><title>T</title></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></nav><article><h1>Rain in the north</h1><p>It rained for three days, and the river rose.</p><p>People left their houses at night.</p></article><footer>&copy; 2020 The Paper</footer></body></html>",
     "Rain in the north\nIt rained for three days, and the river rose.\nPeople left their houses at night."),
    ("<div class=header><h1>My site</h1></div><div id=content><h2>Baking bread</h2><p>Take flour &amp; water.<p>Knead it well, then wait an hour.<ul><li>Salt helps.</li><li>So does time.</li></ul></div><div class=sidebar><a href=a>About me</a> <a href=b>Archive</a></div>",
     "Baking bread\nTake flour & water.\nKnead it well, then wait an hour.\nSalt helps.\nSo does time."),
    ("<body><div class='cookie-notice'>We use cookies. <a href=ok>Accept</a></div><main id=main><h1>Ten years on</h1><p>The bridge was opened by the mayor, who spoke for an hour.</p><div class=ad>Buy now!</div><p>Nobody remembers what was said.</p></main><section class=comments><h2>Comments</h2><p>Great story, thanks for it.</p></section></body>",
     "Ten years on\nThe bridge was opened by the mayor, who spoke for an hour.\nNobody remembers what was said."),
    ("<header class=site-header><a href=/>Logo</a></header><div class=entry-content><p>A first line with <b>bold</b> and <i>slanted</i> words.<br>And a second one.</p><blockquote>Somebody said this, long ago.</blockquote></div><aside class=related><h3>Related</h3><ul><li><a href=x>Another story</a></li></ul></aside><footer><p>Imprint</p></footer>",
     "A first line with bold and slanted words. And a second one.\nSomebody said this, long ago."),
    ("<article><h1>Short</h1><p>One sentence only, but a whole one.</p><form class=newsletter><label>Your mail</label><input><button>Send</button></form></article><div class=footer>Copyright us</div>",
     "Short\nOne sentence only, but a whole one."),
    ("<nav class=menu><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></nav><div class=article-body><p>The first paragraph of the article goes here and is not short.</p><p>Then a <a href=y>link</a> in the middle of a sentence.</p><p>The end.</p></div><div id=disqus><p>first!</p><p>second, no, third</p></div>",
     "The first paragraph of the article goes here and is not short.\nThen a link in the middle of a sentence.\nThe end."),
    ("<div id=top-bar><ul class=nav><li><a href=a>A</a><li><a href=b>B</a></ul></div><div class=post><h1>Unclosed <em>things</em></h1><p>Paragraphs that nobody closes,<p>one after the other,<p>until the end of the post.</div><div class=popup>Subscribe today and save.</div>",
     "Unclosed things\nParagraphs that nobody closes,\none after the other,\nuntil the end of the post."),
    ("<script>var a='<p>no</p>';</script><style>p{}</style><section class=story><h1>What was found</h1><p>They dug for weeks. In the end there was a box, and in the box a letter.</p><h2>The letter</h2><p>It said: &quot;Too late.&quot;</p></section><footer class=site-footer>&copy; nobody &middot; all rights</footer>",
     "What was found\nThey dug for weeks. In the end there was a box, and in the box a letter.\nThe letter\nIt said: \"Too late.\""),
    ("<nav><a href=/>Home</a></nav><div class=sidebar><p>Popular now</p><ul><li><a href=q>Q</a></li></ul></div><footer>&copy; only furniture</footer>", ""),
    ("<header><h1>Daily</h1></header><main><article><h2>Eins zwei</h2><p>Ein Satz mit Umlauten: &auml;&ouml;&uuml;, und noch einer.</p><p>Der letzte Absatz.</p></article></main><div class=reader-comments><div><b>hans</b><p>Stimmt nicht.</p></div></div>",
     "Eins zwei\nEin Satz mit Umlauten: äöü, und noch einer.\nDer letzte Absatz."),
]


def test_pages_labelled_by_hand():
    from parlance.llm.extract import extract_texts, labeller

    assert extract_texts([page for page, _ in BY_HAND], labeller()) == [text for _, text in BY_HAND]


# -- 7 URLs
def test_urls(spark):
    from parlance.llm.urls import filter_urls

    urls = ["http://a.net/x", "http://EXAMPLE.net/en/1", "https://w.example.com/de/2?q#f", "http://b.org/fr/", "http://b.org/fra", "nothing", None, "http://net", "http://xnet/", "http://www.bad.info:80/p/?utm_source=x", "http://bad.info/q", "ftp://h?x/y", "http://a.net/x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = spark.createDataFrame([("url", "https://bad.info/p.html"), ("url", "http://b.org/fr/"), ("url", None), ("host", None), (None, "x")], "kind string, value string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in filter_urls(pages, listed).collect()}
    assert got[0] == ("a.net", "/x", "net/", "block") == got[12]
    assert got[1] == ("example.net", "/en/1", "example.net/en/", "allow")
    assert got[2] == ("w.example.com", "/de/2", "example.com/de/", "block")
    assert got[3][2:] == ("org/fr/", "allow") and got[4][2:] == (None, "allow")
    assert got[5] == ("", "", None, "allow") == got[6]
    assert got[7] == ("net", "", None, "allow") and got[8][2] is None
    assert got[9][3] == "block" and got[10][3] == "allow" and got[11][:2] == ("h", "")


def test_hosts_and_labels_are_listed(spark):
    from parlance.llm.urls import filter_urls, production_list

    urls = ["http://m.free-bets.info/", "https://ads-track.de:8080/x?y", "http://alphabet.info/bets", "http://a.bad.info/", "http://bad.info.de/", "http://notbad.info/", "casino", "http://CASINO.de", "http://a.info/q"]
    pages = spark.createDataFrame([(i % 8, u, "x", 1, "z") for i, u in enumerate(urls * 3)], "page_id long, url string, host string, block int, key string")
    more = spark.createDataFrame([("host", "Bad.info"), ("url", "http://a.info/q/")], "kind string, value string")
    got = filter_urls(pages, production_list(spark).unionByName(more)).collect()
    listed = {r["host"] + r["path"] for r in got if r["listed"]}
    assert listed == {"m.free-bets.info/", "ads-track.de:8080/x", "a.bad.info/", "casino.de", "a.info/q"} and len(got) == 27
    assert all((r["verdict"] == "block") == r["listed"] for r in got)


def test_exact_join_removes_false_positives(spark):
    """A filter of one block that is nearly full lets unlisted keys pass; the join takes them out again."""
    from parlance.llm import urls as U

    listed = spark.range(40).select(F.concat(F.lit("k"), "id").alias("key"))
    asked = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"), "id")
    passed = {r["id"] for r in U.possible_hits(asked, listed, 1, U.bloom_blocks(listed, 1)).collect()}
    assert set(range(40)) < passed and len(passed) < 2000
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.info/"), "id").alias("url"))
    third = pages.where("page_id % 3 = 0").select(F.lit("url").alias("kind"), F.col("url").alias("value"))
    for limit in (64 << 20, 0):
        got = U.filter_urls(pages, third, broadcast_limit=limit)
        assert [tuple(r) for r in got.groupBy("verdict").count().orderBy("verdict").collect()] == [("allow", 2000), ("block", 1000)]


# -- 8 PPM
@pytest.mark.parametrize("head_grams", [1 << 20, 12, 0])
def test_ppm_equals_brute_force(spark, head_grams):
    from parlance.llm.ppm import score_documents

    texts = [None, "", "The cat, the CAT", "abra cadabra abra", "ünï coded", "a" * 50, "zq zq", "abra cadabra abra"]
    held = {2, 6}
    docs = documents(spark, texts)
    got = {r["doc_id"]: r for r in score_documents(docs, F.col("doc_id").isin(*held), head=3, head_grams=head_grams).collect()}
    words = {i: [*WORD.findall((t or "").translate(LOWER)), None] for i, t in enumerate(texts)}
    c = collections.Counter(x for i, w in words.items() if i not in held for x in w)
    n, v = sum(c.values()), len(c)
    seen = collections.defaultdict(collections.Counter)
    coded = {i: [255] * 3 + list((t or "").encode()) + [254] for i, t in enumerate(texts)}
    for i, b in coded.items():
        for k in range(3, len(b)) if i not in held else ():
            for j in range(4):
                seen[tuple(b[k - j : k])][b[k]] += 1

    def p(b, k):
        gone, out = set(), 0.0
        for j in (3, 2, 1, 0):
            live = {s: m for s, m in seen.get(tuple(b[k - j : k]), {}).items() if s not in gone}
            if not live:
                continue
            if b[k] in live:
                return out + math.log10(live[b[k]] / (sum(live.values()) + len(live)))
            out += math.log10(len(live) / (sum(live.values()) + len(live)))
            gone |= set(live)
        return out - math.log10(255 - len(gone))

    for i, b in coded.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(words[i]), sum(c[x] > 0 for x in words[i]), n, i in held)
        assert math.isclose(r["base_score"], sum(math.log10((c[x] + 1) / (n + v + 1)) for x in words[i]), rel_tol=1e-9)
        assert math.isclose(r["score"], sum(p(b, k) for k in range(3, len(b))), rel_tol=1e-9)


def test_scores_dont_depend_on_the_heads(spark):
    """What is broadcast and what is joined give the same scores; ids that repeat, a null id and clashing names."""
    from parlance.llm.ppm import score_documents

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60)
    odd = spark.createDataFrame([(1, "the same id, another text"), (1, "the same id, another text"), (None, "no id"), (5000, "x" * 300_000)], "doc_id long, text string")
    docs = docs.unionByName(odd).selectExpr("*", "1 as row", "2 as n", "'z' as key", "3 as score")
    held = F.col("doc_id") % 5 == 0
    rows = lambda **o: sorted((tuple(r) for r in score_documents(docs, held, **o).collect()), key=str)
    whole, none, some = rows(), rows(head=1, head_grams=0), rows(head=50, head_grams=2000)
    assert len(whole) == docs.count()
    for a, b, c in zip(whole, none, some, strict=True):
        assert a[:5] == b[:5] == c[:5]
        assert max(abs(y / x - 1) for other in (b, c) for x, y in zip(a[5:], other[5:], strict=True)) < 1e-11, (a, b, c)


def test_scores_without_training_rows(spark):
    from parlance.llm.ppm import score_documents

    got = {r["doc_id"]: r for r in score_documents(documents(spark, ["ab", ""]), F.lit(True)).collect()}
    assert got[0]["train_tokens"] == 0 == got[0]["n_known"] and got[0]["n_tokens"] == 2
    assert math.isclose(got[0]["score"], -3 * math.log10(255)) and got[1]["base_score"] == 0.0


# -- 9 toxicity
def test_grammar_scores_clauses():
    from parlance.llm.toxicity import FEATURES, INSULT, NEGATION, REPORT, TARGET, THREAT, Grammar

    g = Grammar({"idiot": (INSULT, 1.0), "you": (TARGET, 1.0), "not": (NEGATION, 1.0), "said": (REPORT, 1.0), "kill": (THREAT, 1.0)}, {"scum": 2.0})
    hit = lambda t: [n for n, x in zip(FEATURES, g.features(t), strict=True) if x]
    assert hit("what an idiot") == ["insult_plain"] and hit("an idiot you are") == ["insult_targeted"]
    assert hit("not an idiot") == ["insult_negated"] and hit("she said idiot") == ["insult_reported"]
    assert hit("not so. an idiot") == ["insult_plain"] and hit("i kill you") == ["threat_targeted"]
    assert hit("not ½ an idiot") == ["insult_negated"]  # a number doesn't end a clause
    assert hit('"so. an idiot" he wrote') == ["insult_reported"] and hit('"so\nan idiot') == ["insult_plain"]
    assert hit("scumbags") == ["insult_plain"] and hit("nice day") == [] == hit("") == hit(None)
    # a clause is scored as a whole: further matches count half
    one, two, apart = (g.features(t)[0] for t in ("idiot", "idiot idiot", "idiot. idiot"))
    assert [round(math.expm1(x), 2) for x in (one, two, apart)] == [1.0, 1.5, 2.0]


def test_composition_equals_the_transducers_one_by_one():
    from parlance.llm import toxicity as T

    parts = [T.negation(), T.target(), T.matches(T.INSULT), T.matches(T.THREAT)]
    r = random.Random(3)

    def rewrites(m, tape):
        """All accepted (tape, weight) of one transducer."""
        paths = [(m.start, [], 1.0)]
        for x in tape:
            paths = [(q2, [*out, y], w * v) for q, out, w in paths for q2, y, v in m.arcs.get((q, x), [])]
        return [(out, w) for q, out, w in paths if q in m.final]

    for inside in (False, True):
        for _ in range(300):
            tape = [r.randrange(7) for _ in range(r.randrange(9))]
            found = [(tape, 1.0)]
            for m in [T.reported_speech(inside), *parts]:
                found = [(out, w * v) for x, w in found for out, v in rewrites(m, x)]
            assert len(found) == 1 and rewrites(T.grammar_machine(inside), tape) == found
            got = T.clause_matches(T.grammar_machine(inside), [(x, 1.0) for x in tape])
            assert [z for z, _ in got] == [z for z in found[0][0] if isinstance(z, tuple)] and math.isclose(math.prod(w for _, w in got), found[0][1])


def test_toxicity_on_held_out_labels(spark):
    from parlance.llm.ppm import fold_remainder
    from parlance.llm.toxicity import score_toxicity

    r = random.Random(5)
    texts, rows = [], []
    for i in range(800):
        w = [f"w{r.randrange(400)}" for _ in range(40)]
        if i % 8 == 0:
            w[r.randrange(40)] = r.choice(["grob", "grobian", "fieses"])
        texts.append(" ".join("".join(chr(97 + int(c)) if c.isdigit() else c for c in x) for x in w))
        rows.append((i, 1, int(i % 8 == 0)))
    texts += [None, ""]
    got = {x["doc_id"]: x for x in score_toxicity(documents(spark, texts), labels(spark, rows), fold_remainder(F.col("doc_id"), 4) == 2).collect()}
    held = [i for i in range(800) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] == (i in held) for i in range(800))
    assert sum(got[i]["predicted"] == (i % 8 == 0) for i in held) >= 0.98 * len(held)
    assert got[800]["predicted"] == 0 == got[801]["predicted"] and 0 <= got[800]["score"] <= 1


# -- 10 embeddings
def test_embeddings_equal_brute_force(spark):
    from parlance.llm.embeddings import near_duplicates

    r = np.random.default_rng(2)
    base = r.normal(size=(400, 16))
    v = np.concatenate([base, base[:60] + 0.02 * r.normal(size=(60, 16)), base[:30], np.repeat(base[:1], 30, 0) + 0.01 * r.normal(size=(30, 16))]).astype(np.float32)
    rows = [(i, x.tolist(), int(i % 2 if i < 400 else (i - 400) % 2 if i < 460 else (i - 460) % 2 if i < 490 else 0)) for i, x in enumerate(v)]
    odd = [None, [0.0] * 16, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [None] + [1.0] * 15, [], [1.0, 2.0]]
    rows += [(1000 + i, x, 0) for i, x in enumerate(odd)] + [(2000, v[0].tolist(), None), (2001, [2.0, 4.0], 0)]
    got = {x["vec_id"]: x for x in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert len(got) == len(rows)
    x = np.asarray(v, float) / np.linalg.norm(np.asarray(v, float), axis=1, keepdims=True)
    near = np.argwhere(x @ x.T >= 0.98)
    linked = [(int(a), int(b)) for a, b in near if a != b and rows[a][2] == rows[b][2]]
    n, found = collections.Counter(a for a, _ in linked), sum(got[i]["n_links"] for i in range(len(v)))
    assert all(got[i]["n_links"] <= n[i] for i in range(len(v))) and found >= 0.9 * len(linked)
    want = components(range(len(v)), linked)
    assert sum(got[i]["component_id"] == want[i] for i in range(len(v))) >= 0.95 * len(v)
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (1000, 1001, 1002, 1003, 1004, 1005, 2000))
    assert got[1006]["n_links"] == 1 and got[2001]["component_id"] == 1006


# -- shared
def test_embedding_links_across_many_borders(spark, monkeypatch):
    from parlance.llm import embeddings

    monkeypatch.setattr(embeddings, "PER_LIST", 4)
    v = np.random.default_rng(4).normal(size=(400, 3))
    got = {x["vec_id"]: x["n_links"] for x in embeddings.near_duplicates(spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = (u @ u.T >= 0.98).sum(1) - 1
    assert [got[i] for i in range(400)] == want.tolist() and want.sum() > 400


def test_connected_components(spark):
    from parlance.llm.common import connected_components

    r = random.Random(9)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)]
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    want = components(nodes, [e for e in edges if e[0] != e[1]])
    assert {k: got[k] for k in nodes} == want


def test_word_hashes_tell_words_apart():
    from parlance.llm.wordhash import word_hashes

    h, b = word_hashes([b"The the  THE", b"", b"\t\n", "é É x\x0by".encode()])
    assert b.tolist() == [0, 3, 3, 3, 7] and h[0] == h[1] == h[2] and len(set(h.tolist())) == 5


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and 0 < out.select("doc_id").distinct().count() <= docs.count(), name
        docs = spark.createDataFrame(out.toPandas(), docs.schema)
    assert corpus_pipeline.packing(spark, docs, SF).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
