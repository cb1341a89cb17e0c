"""Source divergence against plain sums over all terms."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from risetide.llm import divergence

SMALL = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least=10):
    """rows: (text, lang, source)."""
    counts, documents = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        counts[lang, source].update(terms)
        documents[lang].update(set(terms))
    found = []
    for lang in {k[0] for k in counts}:
        kept = [t for t, n in documents[lang].items() if n >= least]
        own = {s: c for (k, s), c in counts.items() if k == lang}
        whole = sum(own.values(), Counter())

        def price(c):
            total = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10 ** 9 * (c[t] + 2) // total for t in kept}

        p, q = {s: price(c) for s, c in own.items()}, price(whole)
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pairs = [(-sum(gap(p[s][t], p[o][t]) for t in kept), o) for o in own if o != s]
            terms = [(-gap(p[s][t], q[t]), t) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, ranked in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))),
                                 ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:10])):
                found += [(lang, s, part, item, -v, k) for k, (v, item) in enumerate(ranked, 1)]
    return sorted(found)


def made(seed=1, sources=9, rows=260):
    draw = random.Random(seed)
    words = [f"w{c}{d}" for c in "abcdefghij" for d in "klmnopqrst"] + ["Élan", "日本", "ÀB", "x y"]
    found = [(" ".join(draw.choices(words, [1 / (k + 1) for k in range(len(words))], k=draw.randint(0, 60))),
              draw.choice(["en", "de", None]), f"s{draw.randrange(sources)}") for _ in range(rows)]
    return found + [(None, "en", "silent"), ("", "xx", "a"), ("only words here", "xx", "b"), ("123 --", "yy", None), ("the " * 5000, "en", "s1")]


@pytest.mark.parametrize("sources, terms", [(64, 1024), (3, 7), (2, 1024)])
def test_audit(spark, monkeypatch, sources, terms):
    monkeypatch.setattr(divergence, "SOURCES", sources)
    monkeypatch.setattr(divergence, "TERMS", terms)
    monkeypatch.setattr(divergence, "FREQUENT_TERMS", max(2, terms // 4))
    monkeypatch.setattr(divergence, "FEW", 6)
    monkeypatch.setattr(divergence, "_HELD", 300)
    rows = made()
    frame = spark.createDataFrame([(*r, 1, "z") for r in rows], "text string, lang string, source string, n int, term string")
    found = sorted(map(tuple, divergence.audit(frame.repartition(3)).collect()))
    assert found == brute(rows)


def test_small_table(spark, odd_docs):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    assert sorted(map(tuple, divergence.audit(docs).collect())) == brute(rows)
    odd = odd_docs.selectExpr("text", "cast(null as string) as lang", "source", "n_lines as kept", "h as total")
    assert sorted(map(tuple, divergence.audit(odd).collect())) == brute([(r.text, r.lang, r.source) for r in odd.collect()])
    assert divergence.audit(odd.where("false")).count() == 0


def test_joint_tables():
    draw = np.random.default_rng(3)
    counts = draw.poisson(0.7, (200, 6)) * draw.integers(1, 3, (200, 6))
    for a, b, here, there, n in divergence.joint_tables(counts, np.array([0, 1, 2]), np.array([2, 3, 4, 5])):
        want = Counter(zip(counts[:, a].tolist(), counts[:, b].tolist()))
        assert dict(zip(zip(here.tolist(), there.tolist()), n.tolist())) == want


def test_exact_prices(spark):
    draw = random.Random(4)
    rows = [(draw.randrange(10 ** e), 10 ** e + draw.randrange(10 ** e), draw.randrange(1, 10 ** 6)) for e in (2, 6, 9, 12, 15, 16) for _ in range(30)]
    want = [1 + 10 ** 9 * (n + 2) // (total + 2 * kept) for n, total, kept in rows]
    found = spark.createDataFrame(rows, "n long, total long, kept long").select(divergence._price("n", "total", "kept").alias("p")).collect()
    assert [r.p for r in found] == want
    assert [int(divergence.prices(np.array([n]), total, kept)[0]) for n, total, kept in rows] == want
