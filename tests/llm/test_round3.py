"""Rendezvous sharding, spelling variants and hard negatives: brute force, laws and edge cases."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import negatives, sharding, spelling

DOCS = "doc_id long, text string, size string, shard string, slot string, law string, t string, word string, n string, form string, row string"


def documents(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 9) for r in rows], DOCS)


# ---- sharding ------------------------------------------------------------------------------------------------


def test_sharding_edges(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, None), (3, ""), (None, "n"), (None, None), (4, "é" * 50_000), (5, "a")] + [(7, "same")] * 300
    got = sharding.sharded(documents(spark, rows)).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"key"}
    by_shard = collections.defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 40)
    assert all(sorted(x) == list(range(len(x))) for x in by_shard.values())
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == collections.Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert all(len({r.shard for r in got if r.doc_id == i}) == 1 for i in (1, 7, None))
    assert sharding.sharded(documents(spark, [])).collect() == []


def test_sharding_law(spark):
    """Shares follow the weights; shards that are added, or lose their weight, move no other record."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    at = lambda w, **k: {r.doc_id: (r.shard, r.grown_shard) for r in sorted(sharding.sharded(docs, w, **k).collect())}
    two, three, without = at([1.0, 3.0]), at([1.0, 3.0, 2.0]), at([1.0, 0.0, 2.0])
    n = collections.Counter(s for s, _ in three.values())
    assert all(abs(n[i] / 20_000 - w / 6) < 0.02 for i, w in enumerate((1, 3, 2)))
    assert all(b in (a, 2) for (a, _), (b, _) in zip(two.values(), three.values(), strict=True))
    assert all(c == b for (b, _), (c, _) in zip(three.values(), without.values(), strict=True) if b != 1)
    assert {i: g for i, (_, g) in at([1.0, 3.0], added=2.0).items()} == {i: s for i, (s, _) in three.items()}
    with pytest.raises(ValueError):
        sharding.sharded(docs, [0.0], added=0.0)


# ---- spelling ------------------------------------------------------------------------------------------------


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(counts, dominant=5):
    out = {}
    for w, n in counts.items():
        all_near = [x for x in counts if x != w and near(w, x)]
        best = min(all_near, key=lambda x: (-counts[x], x), default=None)
        form = best if best is not None and counts[best] >= dominant * n else None
        out[w] = [form, w, n, len(all_near), counts.get(form)]
    for w in out:
        while out[out[w][1]][0] is not None:
            out[w][1] = out[out[w][1]][0]
    return {(w, *x) for w, x in out.items()}


@pytest.mark.parametrize("alphabet", ["ab", "aàÿé", "abcdefghij"])
def test_trie(alphabet):
    r = random.Random(3)
    words = sorted({"".join(r.choice(alphabet) for _ in range(r.randint(1, 7))) for _ in range(300)})
    trie = spelling.Trie.unpack(spelling.Trie(words, np.arange(len(words))).pack())
    asked = [*words, "zzz", "a" * 20]
    length = np.array([len(w) for w in asked])
    text = np.zeros((len(asked), length.max() + 1), np.int64)
    for i, w in enumerate(asked):
        text[i, : len(w)] = [ord(c) for c in w]
    q, w = trie.near(text, length)
    assert len(q) == len({*zip(q, w, strict=True)})
    assert {(asked[a], words[b]) for a, b in zip(q, w, strict=True)} == {(a, b) for a, b in itertools.product(asked, words) if a != b and near(a, b)}


@pytest.mark.parametrize(("shard", "most"), [(1 << 16, 1 << 20), (37, 1 << 20), (20, 1)])
def test_variants(spark, shard, most):
    """Whatever the shards and the groups that are broadcast; chains of forms, ties of forms."""
    r = random.Random(5)
    counts = {"".join(r.choice("abc") for _ in range(r.randint(6, 8))): r.choice([5, 7, 30, 40, 200, 1500, 9000]) for _ in range(250)}
    counts |= {"chained": 5, "chainedx": 25, "chainexx": 125, "chaixexx": 625, "lonely": 9}
    rows = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {tuple(x) for x in spelling.variants(rows, shard=shard, most=most).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == expected(counts) and ("chained", "chainedx", "chaixexx", 5, 1, 25) in got


def test_spelling_of_texts(spark):
    r = random.Random(1)
    words = ["Straße", "straße", "naïvetés", "letters", "LETTERS", "lettters", "Æther×es", "short", "documents", "pointed"]
    rows = [(i, " ".join(r.choice(words) + r.choice([" ", ", ", "1", "-"]) for _ in range(120))) for i in range(60)]
    rows += [(None, "letters " * 50), (None, None), (61, None), (62, ""), (63, "documents;" * 30_000), (7, rows[7][1]), (7, rows[7][1])]
    want = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    want = {w: n for w, n in want.items() if len(w) >= 6 and n >= 5}
    got = spelling.grouped(documents(spark, rows)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert {tuple(x) for x in got} == expected(want) and len(got) == len(want) > 6
    assert spelling.grouped(documents(spark, [])).collect() == []


# ---- hard negatives ------------------------------------------------------------------------------------------


def brute(rows, anchors, positives=5, negatives_=10, low=30, high=90):
    """rows: (vec_id, label, q)."""
    out = []
    key = lambda x: (-x[0], x[1] is None, x[1] or 0, x[2])
    for i, (a, label, q) in enumerate(rows):
        if a not in anchors:
            continue
        dot = lambda x, q=q: sum(int(u) * int(v) for u, v in zip(q, x, strict=False))
        all_ = [(dot(x), b, j, lab) for j, (b, lab, x) in enumerate(rows) if j != i]
        for s, p, _, _ in sorted((x for x in all_ if x[3] == label), key=key)[:positives]:
            fits = sorted((x for x in all_ if x[3] != label and low * s <= 100 * x[0] <= high * s), key=key)
            out += [(a, p, n + 1, x[1], s, x[0]) for n, x in enumerate(fits[:negatives_])]
    return sorted(out, key=repr)


def embeddings(rng, n, d, ties=False):
    x = rng.normal(0, 0.125, (n, d))
    if ties:
        x = np.round(x * 8) / 8
    return x.astype(np.float32)


@pytest.mark.parametrize("ties", [False, True])
def test_negatives(spark, monkeypatch, ties):
    """Small cells, slabs and blocks; nulls, values that are no numbers, repeated rows, uneven and empty vectors."""
    rng = np.random.default_rng(4)
    x = embeddings(rng, 260, 12, ties)
    rows = [(i, int(rng.integers(3)), [float(v) for v in x[i]]) for i in range(260)]
    rows += [(20, 1, rows[3][2]), (20, 1, rows[3][2]), (None, 2, rows[5][2]), (None, 1, rows[6][2]), (300, 0, []), (301, 0, rows[7][2][:5]), (302, 1, rows[7][2] + [0.5]), (303, 9, rows[8][2])]
    none = [(310, None, rows[0][2]), (311, 1, None), (312, 1, [0.1, None]), (313, 1, [float("nan")] * 12), (320, 1, [float("inf")] * 12), (330, 0, [1e30] * 12)]
    df = spark.createDataFrame([(a, b, c, "q", "row", "scores") for a, b, c in rows + none], "vec_id long, label int, embedding array<float>, q string, row string, scores string")
    monkeypatch.setattr(negatives, "CELL", 500)
    monkeypatch.setattr(negatives, "ANCHORS", 5)
    monkeypatch.setattr(negatives, "ROWS", 16)
    monkeypatch.setattr(negatives, "TOGETHER", 4)
    got = negatives.mined(negatives.quantised(df, F.col("vec_id"), F.col("label"), F.col("embedding")), F.col("vec_id") % 10 == 0)
    q = [(a, b, [int(np.floor(256 * float(np.float32(v)))) for v in c]) for a, b, c in rows]
    assert sorted((tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=repr) == brute(q, {*range(0, 310, 10)})
    assert negatives.mined(negatives.digest_rows(df.limit(0)), F.col("vec_id") % 100 == 0).collect() == []


def test_search_drops():
    """Scores are exact, also of large components, and most pairs go before their last plane."""
    rng = np.random.default_rng(0)
    for scale, d in ((256, 64), (1 << 22, 8)):
        c = np.floor(rng.normal(0, 0.125, (2000, d)) * scale).astype(np.int64)
        a = np.floor(rng.normal(0, 0.125, (7, d)) * scale).astype(np.int64)
        label = rng.integers(0, 4, 2000)
        rows = negatives.Rows(np.arange(2000), np.arange(2000), np.zeros(2000, bool), label, c)
        scores = c @ a.T
        high = np.sort(scores, axis=0)[[-20, -60]].T.copy()
        best = negatives.Best(np.zeros((7, 2), np.int64), high, 3)
        blocks = [rows.row[i : i + 250] for i in range(0, 2000, 250)]
        left = [negatives.search(negatives.Rows(*[v[b] for v in (rows.row, rows.vec_id, rows.none, label, c)]), a, np.zeros(7, np.int64), np.full(7, -1), best, False) for b in blocks]
        assert all(x[-1] < 250 * 7 / 4 for x in left[1:]) and all(x == sorted(x, reverse=True) for x in left)
        for j, b in itertools.product(range(7), range(2)):
            fits = [(-int(scores[i, j]), i) for i in range(2000) if label[i] and 0 <= scores[i, j] <= high[j, b]]
            mine = [(-int(s), int(i)) for x, s, i in zip(*best.held[b][:2], best.held[b][3], strict=True) if x == j]
            assert mine == sorted(fits)[:3]
