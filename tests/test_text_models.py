"""Noun chunks, a user's model, and shifted valence against hand-made cases and plain versions."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from risetide.operators import tagging
from risetide.operators.lexicon import add_entities
from risetide.operators.model import classify_with_model, labelled
from risetide.operators.tagging import IMPOSSIBLE, TAGS, add_chunk_keywords, add_noun_chunks, best_path
from risetide.operators.valence import add_shifted_sentiment
from risetide.schema import VALID_CATEGORIES

LEXICON = [("the", "D", -1), ("a", "D", -1), ("big", "A", -1), ("red", "A", -1), ("dog", "N", -1), ("house", "N", -1), ("garden", "N", -1),
           ("runs", "V", -1), ("runs", "N", -3), ("to", "P", -1), ("", "N", -9), ("", "X", -8)]
MOVES = [(p, t, -2) for p in ("", *TAGS) for t in TAGS] + [("D", "N", -1), ("A", "N", -1), ("N", "V", -1)]


@pytest.fixture
def tables(spark):
    return (spark.createDataFrame(LEXICON, "term string, tag string, score long"),
            spark.createDataFrame(MOVES, "previous string, tag string, score long"))


def posts(spark, *texts):
    return spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "id int, title string, body string")


def test_best_path(spark):
    draw = random.Random(1)
    moves = {(p, t): draw.choice([-1, -2, -3, -5]) for p in ("", *TAGS) for t in TAGS if draw.random() < 0.8}
    rows = [(i, [[draw.choice([-1, -2, -4, IMPOSSIBLE]) for _ in TAGS] for _ in range(draw.randint(1, 5))]) for i in range(60)]
    found = {r.id: r.path for r in spark.createDataFrame(rows, "id int, scores array<array<bigint>>").select(
        "id", best_path(F.col("scores"), moves).alias("path")).collect()}
    for i, scores in rows:
        def total(path):
            return sum(scores[k][t] + moves.get((TAGS[path[k - 1]] if k else "", TAGS[t]), IMPOSSIBLE) for k, t in enumerate(path))

        # of equal paths, the one whose last tags come first
        best = max(itertools.product(range(len(TAGS)), repeat=len(scores)), key=lambda p: (total(p), [-t for t in reversed(p)]))
        assert found[i] == "".join(TAGS[t] for t in best)


def test_noun_chunks(spark, tables):
    batch = posts(spark, "The big red dog runs to a house, garden dog", "Runs", "", None, "the dog. the dog", "big big big red garden dog")
    found = {r.id: (r.noun_chunks, r.nouns) for r in add_noun_chunks(batch, *tables).collect()}
    assert found[0] == (["The big red dog", "a house", "garden dog"], ["dog", "house", "garden"])
    assert found[1] == ([], []) or found[1] == ([], ["Runs"])
    assert found[2] == found[3] == ([], [])
    assert found[4] == (["the dog"], ["dog"])
    assert found[5] == ([], ["garden", "dog"])       # a chunk of six words is too long


def test_chunk_keywords(spark, tables):
    batch = posts(spark, "The big red dog runs to a house", "runs to", "dog runs to garden", None).withColumn(
        "entities", F.when(F.col("id") == 0, F.array(F.lit("acme"))).otherwise(F.array().cast("array<string>")))
    done = add_chunk_keywords(batch, *tables)
    found = {r.id: r.keywords for r in done.collect()}
    assert found == {0: "acme The big red dog a house", 1: "runs", 2: "dog garden", 3: ""}
    assert done.columns == batch.columns + ["keywords"]
    assert add_chunk_keywords(batch.where("false"), *tables).count() == 0


def test_chunks_of_long_stretches(spark, tables):
    batch = posts(spark, "the dog runs " * 400 + "to the garden")
    row = add_noun_chunks(batch, *tables).first()
    assert row.noun_chunks[0] == "the dog" and "the garden" in row.noun_chunks


def test_labelled_halves_failing_batches():
    asked = []

    def model(texts, categories):
        asked.append(len(texts))
        if "bad" in texts:
            raise RuntimeError
        return ["tech"] * (len(texts) - ("short" in texts))

    texts = ["x"] * 5 + ["bad"] + ["y"] * 4 + ["short"]
    assert labelled(model, texts, ["tech"]) == ["tech"] * 5 + ["general"] + ["tech"] * 4 + ["general"]
    assert labelled(lambda t, c: ["other"], ["x"], ["tech"]) == ["general"]


def test_classify_with_model(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        import os
        import tempfile

        os.close(tempfile.mkstemp(dir=folder)[0])

        def model(texts, categories):
            if len(texts) > 4 or [len(t) for t in texts] != sorted(len(t) for t in texts):
                raise ValueError("a batch of the wrong kind")
            return [categories[len(t) % len(categories)] if t != "no title" else "health" for t in texts]

        return model

    draw = random.Random(2)
    texts = ["", "   ", None] + ["x" * draw.randint(1, 50) for _ in range(300)]
    batch = posts(spark, *texts).withColumn("category", F.lit("old")).repartition(3)
    done = classify_with_model(batch, load, batch_rows=4)
    assert done.columns == batch.columns
    found = {r.id: r.category for r in done.collect()}
    assert found == {i: VALID_CATEGORIES[len(t) % len(VALID_CATEGORIES)] if t and t.strip() else "health" for i, t in enumerate(texts)}
    assert len(list(tmp_path.iterdir())) == 3       # once a task, not once a batch

    def broken():
        raise OSError("no such model")

    assert {r.category for r in classify_with_model(batch, broken).collect()} == {"general"}
    assert classify_with_model(batch.where("false"), load).count() == 0


def squashed(total):
    return round(total / (total * total + 15) ** 0.5, 4)


def test_shifted_sentiment(spark):
    valence = spark.createDataFrame([("good", 2.0), ("bad", -2.0), ("fine", 1.0), ("no", -1.0)], "term string, valence double")
    shifters = spark.createDataFrame(
        [("very", "booster", 0.3), ("slightly", "booster", -0.3), ("not", "negation", None), ("no", "negation", None), ("but", "turn", None)],
        "term string, kind string, weight double")
    cases = {
        "": 0, "nothing known": 0, "good": 2, "very good": 2.3, "very bad": -2.3, "slightly good": 1.7, "very x good": 2 + 0.3 * 0.95,
        "very x x good": 2 + 0.3 * 0.9, "very x x x good": 2, "very very good": 2 + 0.3 + 0.3 * 0.95, "not good": -1.48, "not x x good": -1.48,
        "not x x x good": 2, "not not good": 2 * 0.74 * 0.74, "not very good": -0.74 * 2.3, "no good": -1 + 2 * -0.74,
        "good but bad": 0.5 * 2 - 1.5 * 2, "good but fine but bad": 0.5 * 2 + 1.5 * 1 - 1.5 * 2, "GOOD day": 2.733, "GOOD": 2, "VERY good": 2 + 0.3 + 0.733,
        "bad BAD": -2 - 2.733, "good!": 2.292, "good!!!!!!": 2 + 4 * 0.292, "bad!!": -2 - 2 * 0.292, "good?": 2, "good??": 2.36, "good????": 2.96, "fine not": 1,
        "!!": 0,
    }
    batch = posts(spark, *cases)
    done = add_shifted_sentiment(batch, valence, shifters)
    found = {r.title: (r.sentiment_score, r.sentiment_label) for r in done.collect()}
    assert found == {t: (squashed(x), "positive" if x > 0 else "negative" if x < 0 else "neutral") for t, x in cases.items()}
    assert done.columns == batch.columns + ["sentiment_score", "sentiment_label"]


def test_entities_with_one_first_word(spark):
    names = spark.range(100_000).selectExpr("concat('acme ', id, if(id % 3 = 0, ' works', '')) as entity", "'ORG' as type")
    batch = posts(spark, "Acme 7 met acme 9 works, not Acme 9; acme 7.", "acme", "the acme 100001", " ".join(f"acme {i}" for i in range(3000)))
    found = {r.id: r.entities for r in add_entities(batch, names).collect()}
    assert found[0] == ["acme 7", "acme 9 works"] and found[1] == [] and found[2] == []
    assert found[3] == [f"acme {i}" for i in range(3000) if i % 3]


def test_chunks_are_the_same_however_lexicon_and_grammar_reach_them(spark, tables, monkeypatch):
    draw = random.Random(4)
    signs = ["the", "The", "big", "RED", "dog", "house", "runs", "to", "garden", "Ünde", "İst", "ΟΣ", "x9", "_a", "it's", "a,b", "dog.", "?!", "\n", "\t", " ", "(red", "nan"]
    texts = [" ".join(draw.choice(signs) for _ in range(draw.choice([0, 3, 30, 200]))) for _ in range(60)] + [None, "the dog", "the dog"]
    batch = posts(spark, *texts)
    found = {}
    for held in (tagging.HELD_CHARS, 0):
        monkeypatch.setattr(tagging, "HELD_CHARS", held)
        for grammar in ("D?A*N+", "(?:D?A*N+)"):    # Spark's expressions match the second one
            for n in (200_000, 50):
                monkeypatch.setattr(tagging.paths, "WORDS", n)
                done = add_noun_chunks(batch, *tables, low=1, grammar=grammar)
                found[held, grammar, n] = sorted((r.id, r.noun_chunks, r.nouns) for r in done.collect())
    first, *others = found.values()
    assert all(x == first for x in others) and sum(len(r[1]) for r in first) > 100


def test_paths_need_no_expression_a_word_nor_shuffle(spark, tables):
    batch = spark.createDataFrame([("k", "the dog", "")], "post_key string, title string, body string")
    plan = add_noun_chunks(batch, *tables)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "aggregate(" not in plan and "Exchange" not in plan
