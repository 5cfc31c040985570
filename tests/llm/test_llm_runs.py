"""Periodic runs and importance resampling."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from odolake.llm import importance_resampling as resampling
from odolake.llm import periodic_runs as pr

SCHEMA = "doc_id long, text string, runs int, start int, length int, score int, bucket int, chunk long, rank int, words string"


def docs(spark, given):
    return spark.createDataFrame([(i, t, 1, 2, 3, 4, 5, 6, 7, "x") for i, t in given], SCHEMA)


# --- periodic runs ------------------------------------------------------------


def plain_runs(w, least=pr.LEAST, times=pr.TIMES):
    best = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                best.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((a, b - a, q) for (a, b), q in best.items()), key=lambda r: (r[0], r[2]))


def plain_digest(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    exponent = 1000 * top[1] // top[2] if runs else None
    kept = " ".join(x for i, x in enumerate(w) if i not in drop)
    return (doc_id, len(runs), *top, exponent, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept))


def digests(df):
    return sorted((tuple(r) for r in pr.digest(pr.detect(df, rewrite=pr.planted)).collect()), key=repr)


@pytest.mark.parametrize("seed", range(6))
def test_runs_are_those_of_the_definition(seed):
    rng = random.Random(seed)
    for _ in range(200):
        texts = []
        for _ in range(rng.randint(1, 4)):
            w = [rng.randrange(rng.choice([1, 2, 3, 12])) for _ in range(rng.randint(0, 50))]
            if w and rng.random() < 0.7:
                a, p = rng.randrange(len(w)), rng.randint(1, 6)
                w = w[:a] + (w[a : a + p] * 50)[: len(w) - a]
                if rng.random() < 0.5:
                    w += [rng.randrange(12) for _ in range(5)] + w[a:]
            texts.append(w)
        found = pr.find_runs(texts)
        assert found == [plain_runs(w) for w in texts]
        for w, runs in zip(texts, found):
            drop = {i for s, n, q in runs for i in range(s + q, s + n)}
            assert pr.collapse(w, runs) == [x for i, x in enumerate(w) if i not in drop]


def test_other_limits():
    rng = random.Random(3)
    for least, times in ((8, 3), (5, 6), (9, 2)):
        texts = [[rng.randrange(2) for _ in range(60)] for _ in range(30)]
        assert pr.find_runs(texts, least, times) == [plain_runs(w, least, times) for w in texts]
    with pytest.raises(ValueError):
        pr.find_runs([[1, 1]], 4, 2)


def test_runs_of_a_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted((plain_digest(r.doc_id, r.text) for r in table.collect()), key=repr)
    assert digests(table) == want
    assert sum(r[1] > 0 for r in want) > 5


def test_runs_of_odd_rows(spark):
    line = "the same line of words again and again\n"
    given = [(1, None), (2, ""), (3, " \n\t "), (4, "a " * 6), (5, "a " * 5), (None, "b " * 9), (6, line * 40 + "end"), (6, line * 40 + "end"), (7, "x y " * 7 + "é"), (17, "A a " * 12)]
    given += [(20 + k, "one two three " * 9 + "tail") for k in range(30)]
    assert digests(docs(spark, given)) == sorted((plain_digest(*g) for g in given), key=repr)
    assert pr.digest(pr.detect(docs(spark, []))).count() == 0


def test_a_very_long_text(spark):
    words = [str(k) for k in range(30_000)] + ["x", "y", "z"] * 20_000 + [str(k) for k in range(30_000)]
    (row,) = pr.detect(docs(spark, [(1, " ".join(words))])).collect()
    assert [tuple(r) for r in row.runs] == [(30_000, 60_000, 3)]
    assert row.collapsed.split() == words[:30_003] + words[90_000:]


def test_many_copies_of_a_line_cost_no_pairs():
    line = list("abcdefghij")
    order = pr.SuffixOrder([[w for k in range(400) for w in (*line, f"n{k}")]])
    assert pr.maximal_pairs(order, 5, lambda d: d // 3) == []


# --- importance resampling ----------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def features(text, order=1):
    w = WORD.findall((text or "").translate(LOW))
    return [" ".join(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)]


def plain_draw(given, target, percent=10, least=20, order=1):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s = Counter(bucket(f) for _, t in given for f in features(t, order))
    t = Counter(bucket(f) for x in target for f in features(x, order))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    rows = []
    for i, text in given:
        f = features(text, order)
        weight = sum(gain(bucket(x)) for x in f)
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((i, len(f), weight, score, len(features(text)) >= least and i is not None))
    may = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0], r[1], r[2]))
    drawn = [(*r[:4], k + 1) for k, r in enumerate(may)]
    wanted = len(may) * percent // 100
    return sorted([(*r[:4], r[4] if r[4] <= wanted else None) for r in drawn] + [(*r[:4], None) for r in rows if not r[4]], key=repr)


def drawn(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_checksums_are_those_of_the_spans():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 50_000, dtype=np.uint8)
    length = np.r_[np.arange(1, 300), rng.integers(1, 5_000, 40), 50_000]
    start = np.array([rng.integers(0, 50_001 - n) for n in length])
    want = [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(start, length)]
    assert resampling.span_crcs(data, start, length).tolist() == want
    assert resampling.span_crcs(data, start[:50], length[:50]).tolist() == want[:50]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_features_are_runs_of_words(order):
    texts = ["", "One two ONE", "é日本 x_y a1-b2", "w" * 200 + " v", "a\x00b\x7fc", "Ünï " * 90]
    bucket, own, words = resampling.feature_buckets(texts, 10000, order)
    for k, t in enumerate(texts):
        assert sorted(bucket[own == k]) == sorted(zlib.crc32(f.encode()) % 10000 for f in features(t, order))
        assert words[k] == len(features(t))


def test_draw_of_odd_rows_is_the_definition(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["alpha", "Beta", "gamma", "δ", "e" * 70]) for _ in range(n))
    given = [(k, text(rng.randint(15, 40))) for k in range(60)] + [(1, None), (2, ""), (None, text(30)), (3, text(25)), (3, "x " * 400_000)]
    given += [(99, "same words " * 15)] * 9
    target = ["alpha beta alpha", None, "e" * 70]
    source, goal = docs(spark, given), spark.createDataFrame([(t,) for t in target], "text string")
    assert drawn(resampling.resample(source, goal)) == plain_draw(given, target)
    pairs = resampling.resample(source, goal, order=2, percent=50)
    assert drawn(pairs) == plain_draw(given, target, percent=50, order=2)


def test_ranks_go_on_over_chunks(spark):
    given = [(k % 150, f"word{k % 7} " * 25) for k in range(300)]
    source = docs(spark, given)
    weighed = resampling.weigh(source, resampling.gains(np.arange(10_000), np.ones(10_000)))
    one, many = resampling.draw(weighed, 50), resampling.draw(weighed, 50, rows=17)
    assert drawn(one) == drawn(many)
    assert sorted(r.rank for r in many.collect() if r.rank) == list(range(1, 151))


def test_draw_from_nothing(spark):
    none = docs(spark, [])
    assert resampling.resample(none, none).count() == 0
    (row,) = resampling.resample(docs(spark, [(1, "a " * 30)]), none).collect()
    assert row.rank is None and row.n_features == 30
