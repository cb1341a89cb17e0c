"""Periodic runs against plain comparisons of all places."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np

from risetide.llm import runs

SMALL = "/root/testdata/sf0.001"


def brute(words, least=24, exponent=3):
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, exponent * q) and j > i:
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def some_words(draw):
    letters, words = draw.choice([1, 2, 3, 5, 50]), []
    for _ in range(draw.randint(0, 6)):
        part = [draw.randrange(letters) for _ in range(draw.randint(1, 30))]
        words += (part * draw.randint(1, 12))[:draw.randint(0, 200)] + [draw.randrange(letters) for _ in range(draw.randint(0, 20))]
    return words


def as_lists(found):
    return [[tuple(r) for r in x.tolist()] for x in found]


def test_find_runs(monkeypatch):
    draw = random.Random(1)
    for k in range(40):
        monkeypatch.setattr(runs, "_QUERIES", draw.choice([7, 1 << 18]))
        docs = [some_words(draw) for _ in range(draw.randint(1, 20))]
        docs += docs[:3]
        assert as_lists(runs.find_runs([np.array(d, np.int64) for d in docs])) == [brute(d) for d in docs]


def test_words_with_many_runs():
    a, b = "a", "ab"
    while len(b) < 2500:
        a, b = b, b + a
    for text in (b, "x" * 2000, "ab" * 900 + "b" + "ab" * 300, "aab" * 8 + "abb" * 8):
        w = np.array([ord(c) for c in text])
        assert as_lists(runs.find_runs([w])) == [brute(list(w))]
    assert as_lists(runs.find_runs([np.zeros(0, np.int64), np.zeros(23, np.int64), np.zeros(24, np.int64)])) == [[], [], [(0, 24, 1)]]
    near = np.array([*range(20), *range(20), 50, *range(10)])     # open candidates, but no run
    assert as_lists(runs.find_runs([near])) == [brute(near.tolist())] == [[]]


def test_extensions():
    draw = np.random.default_rng(2)
    for size, letters in ((30, 1), (400, 2), (3000, 3), (500, 40)):
        w = np.append(draw.integers(0, letters, size), letters + 1)
        w[size // 2:size // 2 + size // 4] = w[:size // 4]
        own = runs.Extensions(w)
        i, j = draw.integers(0, size, (2, 400))
        i, j = i[i != j], j[i != j]
        want = []
        for a, b in zip(i, j):
            k = 0
            while max(a, b) + k < len(w) and w[a + k] == w[b + k]:
                k += 1
            want.append(k)
        assert own.lce(i, j).tolist() == want


def plain(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {k for s, m, q in found for k in range(s + q, s + m)}
    told = "".join(f"{s},{m},{q}\n" for s, m, q in found).encode()
    kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256(told).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_summary(spark, odd_docs):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows = [(d, t) for d, t in rows if len(t or "") < 20_000]
    draw = random.Random(3)
    rows += [(20_000 + k, " ".join(f"w{x}" for x in some_words(draw))) for k in range(150)] + [(None, "a " * 30), (-7, "b\x0bc\x1cd " * 20), (5 * 10**12, "e ")]
    found = runs.summary(spark.createDataFrame(rows, "doc_id long, text string"), runs.planted).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(str(plain(d, t)) for d, t in rows)
    assert sum(r.n_runs > 0 for r in found) > 50
    odd = runs.summary(odd_docs, runs.planted).collect()
    assert sorted(map(str, map(tuple, odd))) == sorted(str(plain(r.doc_id, r.text)) for r in odd_docs.collect())
    assert runs.summary(odd_docs.where("false")).count() == 0


def test_small_batches(spark, monkeypatch):
    draw = random.Random(4)
    docs = [(k, " ".join(map(str, some_words(draw)))) for k in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    whole = sorted(map(tuple, runs.runs(frame).collect()))
    monkeypatch.setattr(runs, "BATCH_WORDS", 50)
    assert sorted(map(tuple, runs.runs(frame).collect())) == whole == sorted((d, *r) for d, t in docs for r in brute(t.split()))


def test_collapse(spark, odd_docs):
    shown = odd_docs.withColumnRenamed("line", "n_runs")
    done = runs.collapse(shown)
    assert done.columns == [c for c in shown.columns if c != "n_runs"] + ["n_runs", "n_words_dropped"]
    assert {(r.doc_id, r.text) for r in done.collect()} == {(r.doc_id, r.text) for r in shown.collect()}
    rows = [(1, "so " + "a b " * 15 + "c"), (2, " keeps  its   spaces\n")]
    found = {r.doc_id: (r.text, r.n_runs, r.n_words_dropped) for r in runs.collapse(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: ("so a b c", 1, 28), 2: (" keeps  its   spaces\n", 0, 0)}
