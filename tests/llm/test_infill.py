"""Fill-in-the-middle forms: against a plain version, exact round trips, chunks of every size, defined cases."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from parlance.llm import infill

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_form(doc_id, text):
    """The contract, read off directly."""
    t = text or ""
    units = TOKEN.findall(t)
    x = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]
    if t == "" or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, t
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd_texts(n=300, seed=1):
    r = random.Random(seed)
    made = ["".join(r.choice("ab é漢 \n\t\x0b\x0c\r😀   \u0085<") for _ in range(r.choice([0, 1, 2, 3, 10, 100, 1000]))) for _ in range(n)]
    return [None, "", " ", "a", " a", "a ", "x<P>y", "<S>", "no <M> here", "<", "<P", "a<", "S>b", "w " * 50_000, "漢" * 70_000, " " * 70_000, *made]


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 64, 4096])
def test_cuts_of_any_chunk(chunk):
    texts = [t or "" for t in odd_texts()]
    texts = [t[:3000] for t in texts]
    data = [t.encode() for t in texts]
    r = random.Random(2)
    draws = np.array([[r.getrandbits(32), r.getrandbits(32)] for _ in texts])
    n, cuts = infill.cut_texts(np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], np.cumsum([len(d) for d in data]))).astype(np.int64), draws, np.ones(len(texts), bool), chunk)
    for t, k, d, c in zip(texts, n, draws, cuts, strict=True):
        units = TOKEN.findall(t)
        a, b = sorted(int(x) % (len(units) + 1) for x in d)
        assert k == len(units) and (len("".join(units[:a])), len("".join(units[:b]))) == tuple(c)


def test_more_text_than_a_slice(monkeypatch):
    monkeypatch.setattr(infill, "SLICE", 100)
    test_cuts_of_any_chunk(16)


def test_forms_equal_the_plain_version(spark):
    rows = [(i, t) for i, t in enumerate(odd_texts())] + [(None, "an id is missing here"), (None, None), (7, "same id, another text"), (5, "a "), (5, "a ")]
    docs = spark.createDataFrame([(i, t, "clash", 3) for i, t in rows], "doc_id long, text string, cut string, a long").repartition(5)
    out = infill.fill_in_middle(docs)
    assert out.columns == ["doc_id", "text", "cut", "a", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = collections.Counter((r["doc_id"], r["text"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in out.collect())
    assert got == collections.Counter((i, t, *plain_form(i, t)) for i, t in rows)
    assert {f for _, _, _, f, _, _, _ in got} == {"plain", "spm", "psm"}
    assert out.where(~(infill.restored(out["output"], out["form"]) == infill.F.coalesce("text", infill.F.lit("")))).count() == 0
    assert infill.infill_digests(docs.limit(0)).count() == 0


def test_query_equals_the_plain_version(spark):
    from parlance.llm.queries import op11_infill

    sf = "/root/testdata/sf0.001"
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        n, form, p, m, out = plain_form(r["doc_id"], r["text"])
        want[r["doc_id"]] = (n, form, p, m, sha(out), sha(r["text"] or ""))
    assert {r["doc_id"]: tuple(r)[1:] for r in op11_infill(spark, sf).collect()} == want


def test_texts_in_pieces(spark):
    """Cuts of texts given in pieces, found by counts, equal those of the whole texts."""
    r = random.Random(4)
    whole = {i: "".join(r.choice("ab é漢 \n") for _ in range(r.randint(1, 400))) for i in range(60)}
    whole |= {60: "x" * 500, 61: " " * 500, 62: "a", 63: "w " * 300}
    rows = []
    for i, t in whole.items():
        at = 0
        while at < len(t):
            k = r.randint(1, 40)
            rows.append((i, len([x for x in rows if x[0] == i]), t[at : at + k]))
            at += k
    got = infill.cut_pieces(spark.createDataFrame(rows, "doc_id long, piece int, text string").repartition(7)).collect()
    text = {(i, k): t for i, k, t in rows}
    found = {(r["doc_id"], r["cut"]): (r["n"], sum(len(text[r["doc_id"], k]) for k in range(r["piece"])) + r["chars"]) for r in got}
    assert len(found) == len(got) == 2 * len(whole)
    for i, t in whole.items():
        units = TOKEN.findall(t)
        x = hashlib.sha256(f"42:{i}".encode()).hexdigest()
        for c, k in enumerate(sorted(int(x[8 * j : 8 * j + 8], 16) % (len(units) + 1) for j in range(2)), 1):
            assert found[i, c] == (len(units), len("".join(units[:k])))
