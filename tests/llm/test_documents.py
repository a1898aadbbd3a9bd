"""Operators on documents: edge cases for all, and each against brute force."""

import collections
import hashlib
import itertools
import math
import random
import re
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from tokenizers import Tokenizer

from plumbline.llm import bpe_codec, mcd_rules, ngram_trie, packing, simhash_gray, sketch, suffix_dedup, token_automaton
from plumbline.llm.queries import MULTI_BPE, WORD_BPE

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `key` string, fp string, h string, n_words string, bin string"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau".split()) + r.choice(["", "", ".", ",", "\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    passage = prose(99, 70)
    out = [(i, prose(i, 60 + i), "en", f"s{i % 3}") for i in range(40)]
    out += [(50, prose(50, 40) + " " + passage + " " + prose(51, 40), "en", "s0"), (51, prose(52, 30) + " " + passage + prose(53, 30), "de", "s1"), (52, passage, "de", None)]
    out += [(60, out[3][1], "en", "s0"), (61, out[3][1].replace("alpha", "alphb", 1), "en", "s0"), (61, out[3][1].replace("alpha", "alphb", 1), "en", "s0")]  # copies, a near copy twice
    out += [(70, None, "en", "s0"), (71, "", None, "s0"), (72, " \n\t ", "en", None), (73, "one two", None, None), (None, "a null id with a few words", "en", "s0"), (None, None, None, None)]
    out += [(80, "x" * 70_000, "en", "s0"), (81, prose(5, 9000), "en", "s0"), (82, "#$%& " * 300, "en", "s0"), (83, "ÄÖ Straße ΣΑΣ 　 日本 don't <|endoftext|> we'll", "fr", "s2"), (84, "same line\n" * 90, "en", "s1")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "k", "f", "h", "n", "b") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


OPERATORS = {
    "ngram_trie": ngram_trie.scored, "sketch": sketch.edited_likeness, "mcd_rules": mcd_rules.judged, "simhash_gray": simhash_gray.components, "packing": packing.packed, "suffix_dedup": suffix_dedup.removed,
    "bpe_codec": lambda d: bpe_codec.encoded(d, public_tokenizers.path(MULTI_BPE), public_tokenizers.PATTERN), "token_automaton": lambda d: token_automaton.counted(d, public_tokenizers.path(WORD_BPE)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(empty, name):
    assert OPERATORS[name](empty).collect() == []


def by_text(got, rows):
    """Result rows with the texts they stand for; equal ids stand for equal texts here."""
    text = collections.defaultdict(list)
    for i, t, *_ in rows:
        text[i].append(t or "")
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(r[0] for r in rows)
    return [(r, text[r.doc_id][0]) for r in got if r.doc_id is not None]


def check_scores(got, rows, mu):
    """Against a trigram model of plain dictionaries; `got` are result rows, each with its text."""
    tokens = [(i, [*WORD.findall((t or "").translate(LOWER)), None]) for i, t, *_ in rows]
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in tokens}
    c, b, a = collections.Counter(), collections.Counter(), collections.Counter()
    for i, w in tokens:
        if not held[i]:
            c.update(w)
            b.update(itertools.pairwise(w))
            a.update(zip(w, w[1:], w[2:], strict=False))
    n, v = sum(c.values()), len(c)
    p1 = lambda w: (c[w] + 1) / (n + v + 1)
    p2 = lambda u, w: (b[u, w] + mu[0] * p1(w)) / (c[u] + mu[0])
    p3 = lambda u, x, w: (a[u, x, w] + mu[1] * p2(x, w)) / (b[u, x] + mu[1])
    for r, t in got:
        w = [*WORD.findall(t.translate(LOWER)), None]
        score = math.log10(p1(w[0])) + sum(math.log10(p2(*x)) for x in [w[:2]] if len(x) > 1) + sum(math.log10(p3(*x)) for x in zip(w, w[1:], w[2:], strict=False))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10(p1(x)) for x in w), abs_tol=1e-6) and 0 <= score - r.score + 1e-9 <= len(w) / ngram_trie.STEPS + 1e-6  # the exact ones add up to one, and none is above its own


@pytest.mark.parametrize(("shard", "block"), [(3000, 2000), (10**6, 10**6), (40, 500)])
def test_ngram_trie(docs, rows, shard, block):
    got = ngram_trie.scored(docs, mu=(20.0, 4.0), shard_tokens=shard, block_tokens=block).collect()
    check_scores(by_text(got, rows), rows, (20.0, 4.0))


@pytest.mark.parametrize("rows", [[(1, None)], [(None, "")], [(1, "only one"), (2, ""), (3, None)], [(4, "a b"), (10, "c d e")], [(i, "held out text") for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2]])
def test_ngram_trie_without_pairs(spark, rows):
    """Blocks with no pair of trained words, or without training tokens at all."""
    got = ngram_trie.scored(spark.createDataFrame(rows, "doc_id long, text string").repartition(len(rows))).collect()
    text = {i: t or "" for i, t in rows}
    assert len(got) == len(rows)
    check_scores([(r, text[r.doc_id]) for r in got], rows, ngram_trie.MU)
    if all(r.held_out for r in got):
        assert all(r.base_score == r.score == 0 == r.train_tokens for r in got)


def test_no_probability_above_one(spark):
    """One word again and again: each of its contexts has nearly all of the probability, and not more."""
    rows = [(i, "word " * 3000 if i == 1 else "a few other words") for i in (1, 3, 4, 5, 6)]
    got = {r.doc_id: r for r in ngram_trie.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    check_scores([(r, dict(rows)[i]) for i, r in got.items()], rows, ngram_trie.MU)
    assert all(r.score < 0 for r in got.values())


@pytest.mark.parametrize("order", [2, 3])
def test_elias_fano_trie(order):
    r = np.random.default_rng(3)
    rows = np.unique(r.integers(0, 40, (5000, order)) * r.choice([1, 1000], (5000, order)), axis=0)
    mine = rows[r.random(len(rows)) < 0.5]
    code = r.integers(0, 60000, len(mine))
    trie = ngram_trie.Trie(list(mine.T), code)
    known = dict(zip(map(tuple, mine.tolist()), code.tolist(), strict=True))
    assert trie.find(list(rows.T)).tolist() == [known.get(tuple(x), -1) for x in rows.tolist()]
    assert ngram_trie.Trie(list(mine[:0].T), code[:0]).find(list(rows[:2].T)).tolist() == [-1, -1]


@pytest.mark.parametrize("step", [1, 2, 50, 10**6])
def test_elias_fano(step):
    values = np.cumsum(np.random.default_rng(step).integers(0, 2 * step, 3000))
    e = ngram_trie.EliasFano(*ngram_trie.EliasFano.encode(values))
    assert (e.get(np.arange(3000)) == values).all()
    x = np.concatenate([values, values + 1, [0, int(values[-1]) * 3]])
    at, there = e.successor(x, np.zeros(len(x), np.int64), np.full(len(x), 3000))
    assert (at == np.searchsorted(values, x)).all() and (there == np.isin(x, values)).all()


def test_sketch(docs, rows):
    got = sketch.edited_likeness(docs).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    texts = [r[1] or "" for r in order]
    edited = collections.Counter()
    for k, t in enumerate(texts):
        nxt, m = texts[(k + 1) % len(texts)], len(t) // 3
        edited[order[k][0], hashlib.sha256((t[: len(t) - m] + nxt[:m]).encode()).hexdigest()] += 1
    assert edited == collections.Counter((r.doc_id, r.edited_sha256) for r in got)
    one = {r.doc_id: r for r in got}
    assert one[3].fingerprint == one[60].fingerprint != one[4].fingerprint and one[70].fingerprint == "" and one[73].fingerprint != ""
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next, r.jaccard_edited))
    long = [r for r in got if r.n_chars > 2000]
    assert np.mean([r.near_edited for r in long]) > 0.4 > np.mean([r.near_next for r in long])


def test_sketch_against_brute_force(docs, rows):
    """Fingerprints and likenesses from sets of every shingle's own hash."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    texts = [r[1] or "" for r in order]
    limit = int(sketch.FRACTION * 2**64)

    def shingles(t):
        w = WORD.findall(t)
        return {int(sketch.sketches(*buffers([" ".join(w[k : k + 5])]), fraction=1.0)[0][0]) for k in range(max(1, len(w) - 4))} if w else set()

    def near(a, b):
        a, b = ({h for h in x if h < limit} or x for x in (a, b))  # what their fingerprints hold
        return float(not a and not b) if not (a and b) else len(a & b) / min(len(a), len(b))

    known = {}
    all_ = lambda t: known.setdefault(t, shingles(t))
    want = collections.Counter()
    for k, t in enumerate(texts):
        nxt, m = texts[(k + 1) % len(texts)], len(t) // 3
        edited = t[: len(t) - m] + nxt[:m]
        prints = ["".join(f"{h:016x}" for h in sorted({h for h in all_(x) if h < limit} or all_(x))) for x in (t, edited)]
        want[order[k][0], *prints, round(near(all_(t), all_(edited)), 9), round(near(all_(t), all_(nxt)), 9)] += 1
    got = sketch.edited_likeness(docs).collect()
    assert want == collections.Counter((r.doc_id, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got)


def test_short_texts():
    """Likeness comes from the fingerprints alone: one without a hash below the threshold holds all of its text's."""
    words, limit, lone = prose(4, 400).split(), int(sketch.FRACTION * 2**64), 0
    whole = sketch.sketches(*buffers([" ".join(words)]))[0]
    for first in range(12):
        short, more = (sketch.sketches(*buffers([" ".join(words[20 + first : n + first])]))[0] for n in (29, 30))
        if int(short[0]) < limit:
            assert sketch.containment(short, whole) == 1.0
        elif int(more[0]) >= limit:
            lone += 1
            assert (len(short), len(more), sketch.containment(short, more), sketch.jaccard(short, more)) == (5, 6, 1.0, 5 / 6) and sketch.containment(short, whole) == 0.0
    assert lone > 2


def test_likeness_from_fingerprints(spark, sf):
    """Every row's likeness follows from its own columns and the next row's fingerprint."""
    got = sorted(sketch.edited_likeness(spark.read.parquet(f"{sf}/documents.parquet")).collect(), key=lambda r: -r.doc_id)
    held = lambda x: {x[i : i + 16] for i in range(0, len(x), 16)}
    near = lambda a, b: len(a & b) / min(len(a), len(b)) if a and b else float(not a and not b)
    for r, n in zip(got, [*got[1:], got[0]], strict=True):
        assert r.near_edited == near(held(r.fingerprint), held(r.edited_fingerprint)) and r.near_next == near(held(r.fingerprint), held(n.fingerprint))


def test_sketch_merges():
    a, b = prose(1, 400), prose(2, 300)
    make = lambda t: sketch.sketches(*buffers([t]))[0]
    both = sketch.merge(make(a), make(b))
    assert sketch.containment(make(a), both) == 1.0 and sketch.containment(make(b), both) == 1.0 and make("").size == 0
    exact = {tuple(w[i : i + 5]) for w in [WORD.findall(a)] for i in range(len(w) - 4)}
    assert abs(len(make(a)) / sketch.FRACTION - len(exact)) < 0.5 * len(exact)


def buffers(texts):
    import pyarrow as pa

    from plumbline.llm.common import text_buffers

    return text_buffers(pa.array(texts))


def base_columns(t):
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    n = collections.Counter(windows)
    again = {k + j for k, x in enumerate(windows) if n[x] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again)


def test_mcd_rules(docs, rows):
    got = mcd_rules.judged(docs).collect()
    for r, t in by_text(got, rows):
        n = base_columns(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and not (r.base_failed and r.kept)
    one = {r.doc_id: r for r in got}
    assert all(one[i].kept for i in range(40)) and not one[82].kept and not one[84].kept
    left = mcd_rules.kept(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == sorted(r.doc_id for r in got if r.kept)


def test_mcd_against_numpy(spark):
    r = np.random.default_rng(5)
    x = r.normal([1.6, 0.05, 0.0, 0.1], [0.1, 0.05, 0.01, 0.1], (400, 4))
    x[:40] += 1.5
    x = np.round(x * mcd_rules.GRID) / mcd_rules.GRID
    df = spark.createDataFrame([(i, "g", "s", *map(float, v)) for i, v in enumerate(x)], "doc_id long, g_lang string, g_source string, x0 double, x1 double, x2 double, x3 double")
    e = mcd_rules.estimates(df).first()
    mean = np.array([e[f"m{i}"] for i in range(4)])
    half = np.zeros((4, 4))
    for i, j in mcd_rules.PAIRS:
        half[i, j] = e[f"k{i}{j}"]
    m, cov = x.mean(0), np.cov(x.T, bias=True) + np.diag(np.square(mcd_rules.NOISE))
    h = int(0.75 * len(x))
    for _ in range(30):
        d = np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(cov), x - m)
        some = x[np.argsort(d)[:h]]
        m, cov = some.mean(0), mcd_rules.CONSISTENT * np.cov(some.T, bias=True) + np.diag(np.square(mcd_rules.NOISE))
    assert np.abs(mean - m).max() < 0.03 and np.abs(half.T @ half @ cov - np.eye(4)).max() < 0.35


def brute_mcd(x):
    """Squared distances by the estimate that the operator describes, over plain arrays with exact halves."""
    noise, p = np.diag(np.square(mcd_rules.NOISE)), 4
    h, best = (len(x) + p + 1) // 2, None
    for start in (0, 1):
        m, cov = (x.mean(0), np.cov(x.T, bias=True) + noise) if start == 0 else (np.median(x, axis=0), noise)
        for _ in range(30):
            d = np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(cov), x - m)
            some = x[np.argsort(d, kind="stable")[:h]]
            m, cov = some.mean(0), mcd_rules.HALF_CONSISTENT * np.cov(some.T, bias=True) + noise
        det = np.linalg.slogdet(cov)[1]
        if best is None or det < best[0] - 1e-9:
            best = det, m, cov
    d = np.einsum("ni,ij,nj->n", x - best[1], np.linalg.inv(best[2]), x - best[1])
    some = x[d <= mcd_rules.NEAR]
    m, cov = some.mean(0), mcd_rules.CONSISTENT * np.cov(some.T, bias=True) + noise
    return np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(cov), x - m)


def test_mcd_verdicts_against_brute_force(spark):
    """Verdicts of groups with junk of several kinds; the operator's halves end at a bin of the distance, so rows near the
    cut-off may differ, others not; and the result does not depend on how rows are dealt out."""
    r = np.random.default_rng(9)
    groups = {}
    for k, share in enumerate((0.0, 0.1, 0.3)):
        x = r.normal([1.6, 0.05, 0.02, 0.1], [0.15, 0.04, 0.02, 0.08], (240, 4))
        n = int(share * 240)
        x[:n] += r.normal([0.8, 0.4, 0.5, 0.5], 0.15, (n, 4))
        groups[f"g{k}"] = np.round(x * mcd_rules.GRID) / mcd_rules.GRID
    data = [(i, g, "s", *map(float, v)) for g, x in groups.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(data, "doc_id long, g_lang string, g_source string, x0 double, x1 double, x2 double, x3 double").repartition(7)
    found = mcd_rules._with_estimates(df, mcd_rules.estimates(df)).select("g_lang", "doc_id", mcd_rules._distance().alias("d")).collect()
    got = {(q.g_lang, q.doc_id): q.d for q in found}
    for g, x in groups.items():
        want = brute_mcd(x)
        mine = np.array([got[g, i] for i in range(len(x))])
        far = np.abs(np.log(want / mcd_rules.CUTOFF)) > 0.25
        assert far.mean() > 0.9 and ((mine > mcd_rules.CUTOFF) == (want > mcd_rules.CUTOFF))[far].all()
    other = df.repartition(3, "x0")
    again = mcd_rules._with_estimates(other, mcd_rules.estimates(other)).select("g_lang", "doc_id", mcd_rules._distance().alias("d")).collect()
    assert got == {(q.g_lang, q.doc_id): q.d for q in again}


def distinct_words(tag, n):
    return " ".join(f"{tag}{chr(97 + k // 676 % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k % 26)}" for k in range(n))


def lined(tag, fresh, repeated):
    """Lines of which `repeated` are copies of the first; no run of three words stands twice, but within those copies."""
    lines = [distinct_words(f"{tag}{k}x", 7) for k in range(fresh)]
    return "\n".join([*lines, *["ab cd"] * (repeated + 1)])


def test_mcd_rejects_by_one_statistic(spark):
    texts = [distinct_words(f"p{chr(97 + i % 26)}{chr(97 + i // 26)}", 120) for i in range(60)]
    lines = [lined(f"l{chr(97 + k)}", 29 - k, k) for k in (9, 11, 14)]  # 30 lines with 30 to 47% repeated
    symbols = [f"{(t := distinct_words('s', 120))} {'#' * (len(t.replace(' ', '')) // 9 + 1)}"]
    planted = [*lines, *symbols]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate([*texts, *planted])], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in mcd_rules.judged(df).collect()}
    for i, t in enumerate(lines):
        assert 0.3 <= got[60 + i].n_dup_lines / len(t.split("\n")) < 0.5
    assert got[63].n_symbols < 0.11 * got[63].word_chars
    assert all(got[i].kept for i in range(60)) and not any(got[60 + i].base_failed or got[60 + i].kept for i in range(len(planted)))


def test_mcd_withstands_much_junk(spark):
    r = np.random.default_rng(7)
    x = r.normal([1.6, 0.05, 0.0, 0.1], [0.1, 0.05, 0.01, 0.1], (200, 4))
    x[:80] += [0.9, 0.5, 0.0, 0.4]  # 40% of the group, all in one place
    df = spark.createDataFrame([(i, "g", "s", *map(float, v)) for i, v in enumerate(x)], "doc_id long, g_lang string, g_source string, x0 double, x1 double, x2 double, x3 double")
    got = [v[0] for v in mcd_rules._with_estimates(df, mcd_rules.estimates(df)).orderBy("doc_id").select(mcd_rules._distance()).collect()]
    assert min(got[:80]) > mcd_rules.CUTOFF and np.mean(np.array(got[80:]) <= mcd_rules.CUTOFF) > 0.98


def test_mcd_judges_small_groups(spark):
    make = lambda i, tail="": distinct_words(f"p{chr(97 + i % 26)}{chr(97 + i // 26)}", 120) + tail
    bad = " " + "#" * 200
    # sources of three rows of a language with enough of them, and a language of two rows
    rows = [(i, make(i), "en", f"s{i // 3}") for i in range(30)] + [(40, make(40, bad), "en", "s0"), (41, make(41, bad), "de", "s0"), (42, make(42), "de", "s1")]
    got = {r.doc_id: r for r in mcd_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert len(got) == len(rows) and all(r.distance is not None for r in got.values())
    assert {i for i, r in got.items() if not r.kept} == {40, 41} and not any(r.base_failed for r in got.values())


def naive_fingerprint(t):
    w = [x.translate(LOWER) for x in WORD.findall(t or "")]
    if not w:
        return 0
    k = min(4, len(w))
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), seed=42) for i in range(len(w) - k + 1)]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("group", [4096, 3])
def test_simhash_gray(docs, rows, group):
    got = simhash_gray.components(docs, group=group).collect()
    prints = [naive_fingerprint(t) for _, t, *_ in rows]
    assert collections.Counter((i, f"{f:016x}") for (i, *_), f in zip(rows, prints, strict=True)) == collections.Counter((r.doc_id, r.fingerprint) for r in got)
    label = components(prints)
    least = {}
    for (i, *_), x in zip(rows, label, strict=True):
        if i is not None:
            least[x] = min(least.get(x, i), i)
    assert collections.Counter((i, least.get(x)) for (i, *_), x in zip(rows, label, strict=True)) == collections.Counter((r.doc_id, r.component_id) for r in got)


def components(prints):
    label = list(range(len(prints)))
    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 4:
            a, b = label[i], label[j]
            label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_gray_forest():
    r = np.random.default_rng(1)
    centre = r.integers(0, 2**63, 30, dtype=np.uint64)
    codes = {int(c) for c in centre}
    for c in centre:
        for _ in range(20):
            codes.add(int(c) ^ sum(1 << int(b) for b in r.choice(64, r.integers(1, 5), replace=False)))
    codes = np.array(sorted(codes), np.uint64)
    group = np.sort(r.integers(0, 3, len(codes)))
    a, b = simhash_gray.forest(group, codes)
    for g in range(3):
        mine = [int(x) for x in codes[group == g]]
        got = list(range(len(mine)))
        place = {x: i for i, x in enumerate(mine)}
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            if x in place and y in place:
                p, q = got[place[x]], got[place[y]]
                got = [min(p, q) if z in (p, q) else z for z in got]
        assert got == components(mine)


def test_one_of_each(docs, rows):
    left = simhash_gray.one_of_each(docs)
    label = components([naive_fingerprint(t) for _, t, *_ in rows])
    assert left.columns == docs.columns
    got = [r.doc_id for r in left.collect()]
    first = {}
    for (i, *_), x in zip(rows, label, strict=True):
        first[x] = min((y for y in (first.get(x), i) if y is not None), default=None)
    assert sorted(got, key=str) == sorted(first.values(), key=str)


def naive_removed(texts, length):
    seen = collections.Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("bucket", [2048, 2])
def test_suffix_dedup(docs, rows, bucket, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUCKET", bucket)
    got = suffix_dedup.removed(docs).collect()
    want = naive_removed([(t or "").encode() for _, t, *_ in rows], suffix_dedup.LENGTH)
    assert collections.Counter((i, *x) for (i, *_), x in zip(rows, want, strict=True)) == collections.Counter(tuple(r) for r in got)


def test_suffix_sort():
    r = np.random.default_rng(2)
    text = r.integers(97, 99, (40, 30)).astype(np.uint8)
    p = np.zeros((40, 31), np.uint64)
    np.cumsum(suffix_dedup.BYTE[text] * suffix_dedup._power(30)[None, :], axis=1, out=p[:, 1:])
    row, cls = np.arange(40), np.arange(40) % 3
    order = suffix_dedup.suffix_sort(p, text, cls, row, np.full(40, 5), np.full(40, 20))
    for c in range(3):
        mine = [bytes(text[i, 5:25]) for i in order if cls[i] == c]
        assert mine == sorted(mine) and len(mine) == (cls == c).sum()


def test_without_repeats_of_strict_columns(spark):
    """A column that can't be null becomes one that can, where a text is null."""
    strict = StructType([StructField("doc_id", LongType(), False), StructField("text", StringType()), StructField("n_chars", LongType(), False), StructField("lang", StringType(), False)])
    got = suffix_dedup.without_repeats(spark.createDataFrame([(1, None, 0, "en"), (2, "plain", 5, "en"), (3, "y" * 900, 900, "de")], strict)).collect()
    assert sorted(map(tuple, got)) == [(1, None, None, "en"), (2, "plain", 5, "en"), (3, "", 0, "de")]


def test_without_repeats(docs):
    left = suffix_dedup.without_repeats(docs)
    one = {r.doc_id: r for r in left.collect()}
    assert left.columns == docs.columns and one[3].text == "" == one[60].text and one[70].text is None and one[80].text == "" and one[10].n_chars == len(one[10].text) > 0


def test_bpe_codec(docs, rows):
    coder = bpe_codec.Codec(public_tokenizers.path(MULTI_BPE), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    for r, t in by_text(OPERATORS["bpe_codec"](docs).collect(), rows):
        ids = library.encode_ordinary(t)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    rnd = random.Random(4)
    for _ in range(300):
        t = "".join(rnd.choice("ab é\n \t'’.s1ñ日") for _ in range(rnd.randint(0, 80)))
        assert coder.encode(t) == library.encode_ordinary(t) and coder.decode(coder.encode(t)) == t.encode()


def test_token_automaton(docs, rows):
    library = Tokenizer.from_file(public_tokenizers.path(WORD_BPE))
    for r, t in by_text(OPERATORS["token_automaton"](docs).collect(), rows):
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 2048)


def test_token_automaton_over_unicode():
    """Every code point's normal form and kind as the library has them; counts for those whose kind Python doesn't know."""
    mine, library = token_automaton.Counter(public_tokenizers.path(WORD_BPE)), Tokenizer.from_file(public_tokenizers.path(WORD_BPE))
    new = []
    for c in (chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000):
        kind = token_automaton.kind(c)
        if kind != token_automaton.SPACE:
            assert mine.normalised(c) == library.normalizer.normalize_str(c), hex(ord(c))
        n = [len(library.pre_tokenizer.pre_tokenize_str(t)) for t in ("a" + c + c, c + c)] if not c.isascii() else None
        assert n in (None, {token_automaton.LETTER: [1, 1], token_automaton.NUMBER: [3, 2], token_automaton.SPACE: [1, 0], token_automaton.OTHER: [2, 1]}[kind]), hex(ord(c))
        if unicodedata.category(c) == "Cn" and kind != token_automaton.OTHER and ord(c) % 7 == 0 or mine.normalised(c) != unicodedata.normalize("NFC", c).lower():
            new.append(c)
    texts = [form.format(c) for c in new for form in ("a{0}b", "1{0}{0}!{0} ")]
    assert len(new) > 600 and mine.counts(texts).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_token_automaton_chunks(monkeypatch):
    monkeypatch.setattr(token_automaton, "CHUNK", 7)
    monkeypatch.setattr(token_automaton, "STATES", 300)
    mine, library = token_automaton.Counter(public_tokenizers.path(WORD_BPE)), Tokenizer.from_file(public_tokenizers.path(WORD_BPE))
    rnd = random.Random(8)
    texts = ["".join(rnd.choice("abcdéthing'’.,! 1<|>ßñ\n-_Σ") for _ in range(rnd.randint(0, 120))) for _ in range(400)]
    assert mine.counts(texts).tolist() == [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]


def naive_best_fit(lengths, capacity):
    """Rooms of bins of one capacity, by best-fit decreasing."""
    rooms = []
    for x in sorted(lengths, reverse=True):
        fit = min((r for r in rooms if r >= x), default=None)
        if fit is None:
            rooms.append(capacity - x)
        else:
            rooms[rooms.index(fit)] -= x
    return sorted(rooms)


def test_packing_plan():
    r = random.Random(6)
    lengths = [r.randint(1, 64) for _ in range(500)]
    _, shut = packing.plan(dict(collections.Counter(lengths)), (64,), float)
    assert sorted(g.capacity - g.used for g in shut for _ in range(g.bins)) == naive_best_fit(lengths, 64)


def test_packing_counts_tokens(docs, rows):
    path, largest = public_tokenizers.path(WORD_BPE), max(packing.CAPACITIES)
    tokenizer = Tokenizer.from_file(path)
    want = collections.Counter()
    for i, t, *_ in rows:
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
        want.update((i, k, s, min(largest, n - s)) for k, s in enumerate(range(0, n, largest)))
    got = packing.packed(docs, tokenizer=path).collect()
    assert want == collections.Counter((r.doc_id, r.piece, r.start, r.length) for r in got)
    assert sum(r.doc_id == 80 for r in got) > 1  # a text without spaces is cut
    used = collections.Counter()
    for r in got:
        used[r.bin_id, r.capacity] += r.length
    assert all(n <= capacity for (_, capacity), n in used.items())


def test_packing(docs, rows):
    got = packing.packed(docs).collect()
    want = collections.Counter()
    for i, t, *_ in rows:
        n = len(WORD.findall(t or "")) + 1
        for k, s in enumerate(range(0, n, max(packing.CAPACITIES))):
            want[i, k, s, min(max(packing.CAPACITIES), n - s)] += 1
    assert want == collections.Counter((r.doc_id, r.piece, r.start, r.length) for r in got)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.bin_id].append(r)
    for some in bins.values():
        some.sort(key=lambda r: r.position)
        used = sum(r.length for r in some)
        assert [r.position for r in some] == [sum(x.length for x in some[:k]) for k in range(len(some))] and {r.capacity for r in some} == {min(c for c in packing.CAPACITIES if c >= used)}


def least_cost(lengths, capacities):
    """The cheapest division of lengths into bins, by trying all."""
    best = math.inf

    def go(i, bins):
        nonlocal best
        if i == len(lengths):
            best = min(best, sum(packing.cost(min(c for c in capacities if c >= b)) for b in bins))
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= max(capacities):
                go(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1 :]])
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best


def test_packing_several_capacities():
    """Never above a quarter more than the least cost of all divisions, and near it on average."""
    r, ratios = random.Random(11), []
    for _ in range(60):
        lengths = sorted(r.choice([r.randint(1, 16), r.randint(1, 64)]) for _ in range(7))
        capacities = (8, 16, 32, 64)
        runs, shut = packing.plan(dict(collections.Counter(lengths)), capacities)
        used = collections.Counter()
        for x in runs:
            for b in range(x.bins):
                used[x.bin0 + b] += x.each * x.length
        assert collections.Counter(x.length for x in runs for _ in range(x.bins * x.each)) == collections.Counter(lengths)
        assert all(g.used == used[g.bin0 + b] <= g.capacity == min(c for c in capacities if c >= g.used) for g in shut for b in range(g.bins))
        ratios.append(sum(packing.cost(g.capacity) * g.bins for g in shut) / least_cost(lengths, capacities))
    assert max(ratios) < 1.4 and np.mean(ratios) < 1.12


def test_sequences(docs, rows):
    ranks = public_tokenizers.path(MULTI_BPE)
    coder = bpe_codec.Codec(ranks, public_tokenizers.PATTERN)
    got = packing.sequences(docs.where("doc_id <> 61"), ranks, public_tokenizers.PATTERN, end=-1).collect()
    texts = collections.defaultdict(dict)
    for r in got:
        assert len(r.ids) == len(r.segment) <= r.capacity and r.starts[0] == 0 and r.segment == sorted(r.segment)
        for k, (doc_id, piece) in enumerate(zip(r.doc_ids, r.pieces, strict=True)):
            ids = [x for x, g in zip(r.ids, r.segment, strict=True) if g == k]
            assert r.ids[r.starts[k] : r.starts[k] + len(ids)] == ids
            texts[doc_id][piece] = ids
    want = {i: t or "" for i, t, *_ in rows if i not in (None, 61)}
    assert texts.keys() == want.keys()
    for i, parts in texts.items():
        assert sum((parts[k] for k in sorted(parts)), []) == [*coder.encode(want[i]), -1]


def test_state_maps_of_unbroken_texts(monkeypatch):
    """Chunks of texts without spaces: prefix compositions against running the chunks one after the other."""
    monkeypatch.setattr(token_automaton, "CHUNK", 7)
    counter, library = token_automaton.Counter(public_tokenizers.path(WORD_BPE)), Tokenizer.from_file(public_tokenizers.path(WORD_BPE))
    runs = []
    lockstep = token_automaton.Transducer.lockstep
    monkeypatch.setattr(token_automaton.Transducer, "lockstep", lambda self, *a: runs.append(1) or lockstep(self, *a))
    for text in ("x" * 4000, "ab" * 2000, "".join(random.Random(2).choice("abcde") for _ in range(4000)), "é日" * 900, "a b" + "-" * 3000 + " c"):
        runs.clear()
        assert counter.counts([text, "", text[:50]]).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in (text, "", text[:50])]
        assert len(runs) < 100  # over 500 chunks
    r = random.Random(3)
    maps = [{s: (r.randrange(4), r.randrange(9)) for s in range(4)} for _ in range(23)]
    fresh = np.array([j in (0, 1, 9) for j in range(23)])
    got = token_automaton.scan(list(maps), fresh)
    for j in range(23):
        begin = max(k for k in (0, 1, 9) if k <= j)
        for s in range(4):
            state, n = s, 0
            for k in range(begin, j + 1):
                state, n = maps[k][state][0], n + maps[k][state][1]
            assert got[j][s] == (state, n)


def test_one_of_many_equal_rows(spark):
    text, other = prose(1, 60), prose(2, 80)
    rows = [(5, text, None)] * 300 + [(9, text, "x")] * 20 + [(None, other, "y")] * 30 + [(7, None, "z"), (8, "", "z")]
    left = simhash_gray.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, label string").repartition(7)).collect()
    assert sorted(((r.doc_id, r.text) for r in left), key=str) == sorted([(5, text), (None, other), (7, None)], key=str)


def test_stages_in_sequence(spark, empty, tmp_path):
    """The pipeline's operators one after the other on an empty table and on rows of nulls and repeats, with clashing names."""
    odd = [(1, prose(3, 90), "en", "s", 5, "k", "f", "h", "n", "b")] * 3 + [(None, None, None, None, None, None, None, None, None, None), (2, "", "en", None, 0, "k", "f", "h", "n", "b")]
    for k, docs in enumerate((empty, spark.createDataFrame(odd, SCHEMA))):
        for i, stage in enumerate((mcd_rules.kept, simhash_gray.one_of_each, suffix_dedup.without_repeats, packing.packed)):
            out = stage(docs)
            assert i == 3 or out.columns == docs.columns
            out.write.parquet(str(tmp_path / f"{k}{i}"))
            docs = spark.read.parquet(str(tmp_path / f"{k}{i}"))
        assert docs.count() == k
