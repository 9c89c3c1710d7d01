"""The session graph, clusters and tables in rounds, against plain versions on one machine."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance import tables
from parlance.operators import bank, clusters, graph
from parlance.sources import bank_tables

ENTRY = "entry_idx long, speaker string, embedding array<double>"


def plain_propagation(edges, pulls, seeds, alpha, rounds, tolerance):
    """Dense matrices, one session at a time: nodes, then one anchor for each label."""
    out = {}
    for s in {p[0] for p in pulls} | {y[0] for y in seeds}:
        nodes = sorted({n for e in edges if e[0] == s for n in e[1:3]} | {p[1] for p in pulls if p[0] == s} | {y[1] for y in seeds if y[0] == s})
        labels = sorted({p[2] for p in pulls if p[0] == s} | {y[2] for y in seeds if y[0] == s})
        w, y, held = np.zeros((len(nodes) + len(labels),) * 2), np.zeros((len(nodes) + len(labels), len(labels))), np.zeros(len(nodes) + len(labels), bool)
        for _, a, b, x in (e for e in edges if e[0] == s):
            w[nodes.index(a), nodes.index(b)] = x
        for _, n, lab, x in (p for p in pulls if p[0] == s):
            i, j = nodes.index(n), len(nodes) + labels.index(lab)
            w[i, j] = w[j, i] = x
        for i in range(len(labels)):
            y[len(nodes) + i, i], held[len(nodes) + i] = 1, True
        for _, n, lab in (x for x in seeds if x[0] == s):
            y[nodes.index(n), labels.index(lab)], held[nodes.index(n)] = 1, True
        total = w.sum(1, keepdims=True)
        share, f = w / np.where(total > 0, total, 1), y.copy()
        for _ in range(rounds):
            new = alpha * share @ f + (1 - alpha) * y
            new[held] = y[held]
            done = np.abs(new - f).max() <= tolerance
            f = new
            if done:
                break
        out |= {(s, n, lab): f[i, j] for i, n in enumerate(nodes) for j, lab in enumerate(labels) if f[i, j] > 0}
    return out


def test_propagation_equals_matrices(spark):
    r = np.random.default_rng(4)
    edges, pulls, seeds = [], [], []
    for s, n in (("fast", 12), ("slow", 60), ("bare", 5)):
        for a in range(n):
            for b in r.choice(n, 3, replace=False) if s != "slow" else [(a + 1) % n]:  # a ring takes long to settle
                if a != b and not any(e[:3] == (s, a, int(b)) for e in edges):
                    x = float(r.uniform(0.1, 1))
                    edges += [(s, a, int(b), x), (s, int(b), a, x)]
        if s != "bare":
            pulls += [(s, a, f"P{a % 3}", float(r.uniform(0.01, 0.1))) for a in range(0, n, 5)]
            seeds += [(s, 1, "P0"), (s, n - 2, "P7")]
    pulls.append(("only", 3, "P1", 0.5))
    seeds.append(("only", 4, "P2"))
    edges = list({e[:3]: e for e in edges}.values())
    both = {(s, min(a, b), max(a, b)): w for s, a, b, w in edges}
    edges = [(s, a, b, w) for (s, x, y), w in both.items() for a, b in ((x, y), (y, x))]
    df = spark.createDataFrame
    got = graph.propagate(df(edges, "session string, src long, dst long, w double"), df(seeds, "session string, node long, label string"), df(pulls, "session string, node long, label string, w double"), 0.85, 30, 1e-4)
    got = {(x["session"], x["node"], x["label"]): x["score"] for x in got.collect()}
    want = plain_propagation(edges, pulls, seeds, 0.85, 30, 1e-4)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert graph.propagate(df([], "session string, src long, dst long, w double"), df([], "session string, node long, label string")).count() == 0


def test_graph_rescues_an_unknown_between_sure_ones(spark):
    g = graph.SessionGraph(min_similarity=0.0, pairs={"A::B": {"override_min_confidence": 0.99}})
    s = spark.createDataFrame([("s", i, 2.0 * i, 2.0 * i + 1.9, "S0", False, False) for i in range(5)], "session string, seg_idx long, start double, end double, speaker_raw string, overlap_heavy boolean, was_split boolean")
    rows = [("s", i, 1, "A", 0.9) for i in (0, 1, 3)] + [("s", 2, 1, "A", 0.4), ("s", 4, 1, "B", 0.45), ("s", 4, 2, "A", 0.44)] + [("s", i, 2, "C", 0.1) for i in (0, 1, 2, 3)]
    c = spark.createDataFrame(rows, "session string, seg_idx long, rank long, speaker string, score double")
    v = spark.createDataFrame([("s", i, [1.0, 0.01 * i]) for i in range(5)], "session string, seg_idx long, embedding array<double>")
    known = graph.evidence(s, c, 0.5, 0.05, 0.0, g)
    assert {r["seg_idx"]: (r["local_speaker"], r["seed"], r["pair"]) for r in known.collect()} == {0: ("A", True, "A::C"), 1: ("A", True, "A::C"), 2: (None, False, "A::C"), 3: ("A", True, "A::C"), 4: (None, False, "A::B")}
    found = graph.session_graph(known, c, v, g)
    best = {r["node"]: r for r in found.collect()}
    assert best[2]["label"] == "A" and best[2]["score"] > 0.6 and best[0]["score"] == 1 and len(best[2]["neighbours"]) == 3
    local = known.select("session", "seg_idx", F.coalesce("local_speaker", F.lit("unknown")).alias("speaker"), "score", "seed", "pair")
    out = {r["seg_idx"]: (r["final"], r["overridden"]) for r in graph.overridden(local, found, g).collect()}
    # the pair of segment 4 asks for more than it gets
    assert out == {0: ("A", False), 1: ("A", False), 2: ("A", True), 3: ("A", False), 4: ("unknown", False)}


def plain_density(x, eps, least):
    near = [[j for j in range(len(x)) if 1 - x[i] @ x[j] <= eps] for i in range(len(x))]
    core, label, n = [len(v) >= least for v in near], {}, 0
    for i in range(len(x)):
        if core[i] and i not in label:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in label:
                    label[j] = n
                    todo += near[j] if core[j] else []
            n += 1
    return [label.get(i, -1) for i in range(len(x))]


def blobs(n, seed, dim=5, middles=4):
    r = np.random.default_rng(seed)
    x = r.normal(size=(middles, dim))[r.integers(0, middles, n)] + r.normal(size=(n, dim)) * 0.35
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("block", [7, 2048])
def test_density_clusters_equal_plain_ones(spark, monkeypatch, block):
    monkeypatch.setattr(clusters, "BLOCK", block)
    x = blobs(150, 1)
    x[100:120] = x[0]  # copies
    who = ["hot" if i % 6 else "rare" for i in range(150)]
    df = spark.createDataFrame([(3 * i, who[i], x[i].tolist()) for i in range(150)] + [(1, "zero", [0.0] * 5), (2, "one", [1.0, 0.0])], ENTRY)
    got = {r["entry_idx"]: r["cluster"] for r in clusters.density_clusters(df, 0.06, 5).collect()}
    want = {2: -1}
    for s in ("hot", "rare"):
        mine = [i for i in range(150) if who[i] == s]
        want |= {3 * i: c for i, c in zip(mine, plain_density(x[mine], 0.06, 5), strict=True)}
    assert got == want and len(set(want.values())) > 3


def test_clusters_score_apart(spark):
    """A speaker with two voices is two clusters: the better one counts, where one centroid would lie between them."""
    rows = [(i, "A", [1.0, 0.02 * i, 0.0]) for i in range(4)] + [(10 + i, "A", [-1.0, 0.02 * i, 0.0]) for i in range(4)] + [(20, "A", [0.0, 0.0, 1.0]), (30, "B", [0.3, 1.0, 0.0])]
    b = spark.createDataFrame(rows, ENTRY)
    m = clusters.members(b, clusters.density_clusters(b, 0.05, 3))
    c = clusters.clusters_of(m)
    assert {r["cluster_id"]: r["members"] for r in c.collect()} == {"A_c0": 4, "A_c1": 4, "A_solo_20": 1, "B_solo_30": 1}
    q = spark.createDataFrame([("s", 100, [-1.0, 0.1, 0.0]), ("s", 101, [0.0, 0.1, 1.0])], "session string, seg_idx long, embedding array<double>")
    got = {r["seg_idx"]: (r["speaker"], r["cluster_id"], r["score"] > 0.9) for r in bank.bank_scores(q, c, 1e9).where("rank = 1").collect()}
    assert got == {100: ("A", "A_c1", True), 101: ("A", "A_solo_20", True)}
    p = clusters.prototypes_of(m, c, 2)
    assert {(r["cluster_id"], r["place"]) for r in p.collect()} == {("A_c0", 0), ("A_c0", 1), ("A_c1", 0), ("A_c1", 1), ("A_solo_20", 0), ("B_solo_30", 0)}


def plain_kmeans_prototypes(ids, x, k):
    n = len(ids)
    m = min(k, n)
    c = np.array([x[j * n // m] for j in range(m)])
    for _ in range(20):
        at = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        new = np.array([x[at == j].mean(0) if (at == j).any() else c[j] for j in range(m)])
        if np.abs(new - c).max() <= 1e-12:
            break
        c = new
    got = []
    for v in c:
        got.append(next(i for i in np.argsort(((x - v) ** 2).sum(1), kind="stable") if i not in got))
    return [ids[i] for i in got]


def test_kmeans_prototypes_equal_plain_ones(spark):
    x = blobs(90, 3)
    who = ["A" if i < 60 else "B" if i < 88 else "C" for i in range(90)]
    df = spark.createDataFrame([(i, who[i], x[i].tolist()) for i in range(90)], ENTRY)
    m = clusters.members(df)
    got = {}
    for r in clusters.prototypes_of(m, clusters.clusters_of(m), 4, "kmeans").orderBy("place").collect():
        got.setdefault(r["speaker"], []).append(r["entry_idx"])
    for s, ids in got.items():
        mine = [i for i in range(90) if who[i] == s]
        assert ids == plain_kmeans_prototypes(mine, x[mine], 4), s
    assert {s: len(v) for s, v in got.items()} == {"A": 4, "B": 4, "C": 2}


def test_bank_is_saved_over_itself(spark, tmp_path):
    path = f"file://{tmp_path}/bank"
    one = lambda i, s: spark.createDataFrame([(i, s, [1.0 + i, 1.0, 0.1 * i])], ENTRY)
    bank_tables.save_bank(one(0, "A"), path)
    for i, s in ((1, "B"), (2, "A"), (3, "C")):
        bank_tables.save_bank(bank.add_entries(bank_tables.load_bank(spark, path), one(i, s)), path, examples=2)
        assert bank_tables.load_bank(spark, path).count() == i + 1
    saved = {r["cluster_id"]: r["members"] for r in bank_tables.load_clusters(spark, path).collect()}
    assert saved == {"A_c0": 2, "B_c0": 1, "C_c0": 1} and bank_tables.load_prototypes(spark, path).count() == 4
    # a save that fails leaves the bank as it was
    with pytest.raises(Exception, match="boom"):
        bank_tables.save_bank(bank_tables.load_bank(spark, path).withColumn("speaker", F.raise_error(F.lit("boom")).cast("string")), path)
    assert bank_tables.load_bank(spark, path).count() == 4 and not [p for p in tmp_path.iterdir() if p.name != "bank"]
    # with several clusters a speaker, read back and used
    b = spark.createDataFrame([(i, "A", [1.0, 0.02 * i]) for i in range(4)] + [(9 + i, "A", [-1.0, 0.02 * i]) for i in range(4)], ENTRY)
    bank_tables.save_bank(b, path, clusters.density_clusters(b, 0.05, 3), 1)
    q = spark.createDataFrame([("s", 100, [-1.0, 0.1])], "session string, seg_idx long, embedding array<double>")
    assert bank.bank_scores(q, bank_tables.load_clusters(spark, path), 1e9, bank_tables.load_prototypes(spark, path)).first()["cluster_id"] == "A_c1"


@pytest.mark.parametrize("few", [0, 5, 10**6])
def test_components(spark, few):
    r = np.random.default_rng(few + 1)
    pairs = [(int(a), int(b)) for a, b in r.integers(0, 400, (260, 2))] + [(1000, 1000 + i) for i in range(1, 40)] + [(2000 + i, 2001 + i) for i in range(50)] + [(5, 5)]
    root = {n: n for p in pairs for n in p}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in tables.connected_components(spark.createDataFrame(pairs, "a long, b long"), few).collect()}
    alone = {n for n in root if all(set(p) != {n} and n not in p or p[0] == p[1] for p in pairs)}
    assert got == {n: find(n) for n in root if n not in alone}
    assert tables.connected_components(spark.createDataFrame([], "a long, b long"), few).count() == 0


def test_large_blocks_are_searched_by_products():
    """Rows as a plain search gives them, among copies, near copies and vectors that aren't finite; a block of 2,048 by 16,384 took 12 s when it was summed by components."""
    import time

    r = np.random.default_rng(3)
    y = r.normal(size=(16_384, 64))
    y[100:300] = y[100]
    y[400:600] = y[400] + 1e-8 * r.normal(size=(200, 64))
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    y[7] = np.nan
    ids, x = np.arange(len(y)) * 2, y[:2048]
    kinds = np.where(np.arange(len(y)) % 50 == 0, "b", "a").astype(object)
    start = time.monotonic()
    row, col, w = bank._block_nearest(x, y, ids[:2048], ids, None, 5, 0.1)
    assert time.monotonic() - start < 6
    some = bank._block_nearest(x[:640], y, np.full(640, -1), ids, kinds, 5, -2.0)
    for i in (0, 7, 100, 299, 450, 2047):
        s = np.zeros(len(y))
        for d in range(64):
            s += x[i, d] * y[:, d]
        s[i] = np.nan
        near = [j for j in np.argsort(-s, kind="stable")[:5] if s[j] >= 0.1]
        assert col[row == i].tolist() == near and w[row == i].tolist() == s[near].tolist()
        if i < 640:  # whatever kind is left out, its best others are there
            s[i] = (x[i] * y[i]).sum()
            for left in "ab":
                mine = [j for j in some[1][some[0] == i] if kinds[j] != left][:5]
                assert mine[1:] == [j for j in np.argsort(-s, kind="stable") if kinds[j] != left and s[j] == s[j]][1:5] or 100 <= i < 600


def test_unit_vectors_of_unit_vectors(spark):
    """The norm is worked out once a vector, not once a component (and again for each component of an inner one)."""
    import time

    from parlance.functions.vectors import unit

    rows = spark.range(2000).select(F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: (i + F.col("id")).cast("double")).alias("x")).union(spark.createDataFrame([([0.0, 0.0],), (None,)], "x array<double>"))
    start = time.monotonic()
    got = [r[0] for r in rows.select(unit(unit(F.col("x")))).collect()]
    assert time.monotonic() - start < 10 and got.count(None) == 2
    assert abs(sum(v * v for v in got[5]) - 1) < 1e-12 and abs(got[5][63] / got[5][0] - 69 / 6) < 1e-9
