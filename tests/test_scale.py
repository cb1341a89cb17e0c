"""What must not grow faster than the texts: shuffles of phrases and words, and texts that no result needs."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from risetide.functions import text
from risetide.operators import phrases, tagging, topics
from risetide.plans import daily
from risetide.registry.queries import Tables

needs_tables = pytest.mark.skipif(not os.path.isdir(driver.SMOKE_DIR), reason="needs the driver's tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_key_phrases_need_no_shuffle(spark):
    posts = spark.createDataFrame([("k", "a b")], "post_key string, t string")
    assert "Exchange" not in plan(phrases.rake_phrases(posts, F.col("t")))


@pytest.mark.parametrize("stretches, best", [
    ("", []), ("the \n of", []), ("x", [("x", 1.0)]),
    ("qq pp\npp qq\n gg the hh", [("qq pp", 4.0), ("pp qq", 4.0), ("hh", 1.0), ("gg", 1.0)]),
    ("pp\n pp \npp", [("pp", 1.0)] * 3),
])
def test_best_runs(stretches, best):
    assert phrases.best_runs(stretches, 5) == best


def test_space_joins_and_other_signs_part_stretches(spark):
    texts = spark.createDataFrame([(" Wind\t\nPark, sun\u00a0Sea \u2013_x9 ",), (None,)], "t string")
    rows = texts.select(phrases.key_phrases(F.col("t")).alias("p")).collect()
    assert {p.phrase for p in rows[0].p} == {"wind park", "sun", "sea", "_x9"} and rows[1].p == []


def phrased(spark):
    rows = [(("tech", "health", None)[i % 3], ("news", "reddit")[i % 2], float(40 + 7 * i % 60),
             [f"term {i * k % 23}" for k in range(1, 9)] + ["common words"], [f"term {i % 5}"]) for i in range(120)]
    return spark.createDataFrame(rows, "category string, source string, trend_score double, phrases array<string>, entities array<string>")


def test_topics_are_those_of_counting_every_term(spark):
    posts = phrased(spark)
    options = topics.TopicOptions(top_n=2, top_n_category=1, top_n_source=2)
    some = sorted(map(tuple, topics.ranked_topics(posts, options, looked_at=1).collect()))
    assert some and some == sorted(map(tuple, topics.ranked_topics(posts, options).collect()))


def test_topics_count_other_posts_for_candidates_alone(spark):
    # grouping sets expand the counts of terms, no more the phrases of all posts
    assert not re.search(r"Expand[^\n]*_rise", plan(topics.ranked_topics(phrased(spark))))


def test_words_are_not_shuffled_for_their_tags(spark):
    posts = spark.createDataFrame([("k", "the sun sun, the sea", "")], "post_key string, title string, body string")
    lexicon = spark.createDataFrame([("the", "D", -1), ("", "N", -2)], "term string, tag string, score long")
    moves = spark.createDataFrame([("", "D", -1), ("D", "N", -1)], "previous string, tag string, score long")
    _, tagged, _ = tagging.tag_words(posts, lexicon, moves, F.col("title"))
    assert {(r.stretch, r.tags) for r in tagged.collect()} == {(0, "DNN"), (1, "DN")}
    assert "stretch" not in "".join(re.findall(r"Exchange hashpartitioning\((.*?)\)", plan(tagged)))


@needs_tables
def test_rising_posts_have_the_phrases_that_all_have(spark):
    every = Tables(spark, driver.SMOKE_DIR).phrased().where("trend_score >= 70").collect()
    rising = Tables(spark, driver.SMOKE_DIR).rising_phrased().collect()
    key = lambda r: (r.url, r.category, tuple(r.phrases), tuple(r.entities))     # noqa: E731
    assert every and sorted(map(key, every)) == sorted(map(key, rising))


def test_phrases_are_made_in_tasks_of_bounded_text(spark, monkeypatch):
    posts = spark.range(100).selectExpr(
        "concat('u', id) url", "concat('solar wind park ', id) title", "if(id % 2 = 0, null, 'sea level rise') body",
        "'' keywords", "'tech' category", "'news' source", "90D trend_score")
    monkeypatch.setattr(phrases, "TASK_CHARS", 50)
    found = daily.phrase_posts(posts)
    assert found.rdd.getNumPartitions() == -(-(90 * 18 + 10 * 17 + 50 * 14) // 50)
    assert found.count() == 100 and {"solar wind park", "solar wind"} <= set(found.first().phrases)
    assert daily.phrase_posts(posts.limit(0)).count() == 0


def test_single_spaces_are_not_replaced(spark):
    plain = spark.createDataFrame([("the sun and the sea",)], "t string")
    counts = plain.select(*(F.regexp_count("t", F.lit(p)) for p in (text._SPACE, text._NON_WORD))).first()
    assert tuple(counts) == (0, 0)


def test_space_and_other_signs_part_as_before(spark):
    signs = ["a", "\u00e9", "7", "_", " ", " ", "\t", "\n", "\x1c", "\x85", "\u00a0", "\u2003", "\u3000", "-", "\u2013", "\u200b", "\U0001f600"]
    rows = [("".join(signs[(i * k + k * k) % len(signs)] for k in range(i % 13)),) for i in range(700)]
    found = spark.createDataFrame(rows, "t string").select(
        F.regexp_replace("t", text._SPACE, " "), F.regexp_replace("t", r"(?U)[\s\x1c-\x1f]+", " "),
        F.regexp_replace("t", text._NON_WORD, " "), F.regexp_replace("t", r"[^\p{L}\p{N}_]+", " ")).collect()
    assert all(r[0] == r[1] and r[2] == r[3] for r in found) and any(r[0] != r[2] for r in found)


def test_phrases_among_terms_are_those_of_all_phrases(spark, monkeypatch, tmp_path):
    draw = random.Random(5)
    signs = ["Solar", "wind", "PARK", "the", "of", "nan", "sea,", "level.", "rise", "it", "Über", "İstanbul", "ΟΔΟΣ", "ΟΔΟΣ's", "ẋ", "a\nb", "Ɤa", "\U0001f600"]
    rows = [(i, draw.choice(["", "Sea level", "it is", None, "wind wind wind wind"]), " ".join(draw.choice(signs) for _ in range(draw.choice([0, 1, 2, 3, 4, 40]))),
             draw.choice(["", "nan", "wind park sea", None]), draw.choice([[], ["Solar Wind", "solar wind"], ["acme"]]),
             "tech", "news", float(60 + i % 30)) for i in range(200)]
    posts = spark.createDataFrame(
        rows, "id int, title string, body string, keywords string, entities array<string>, category string, source string, trend_score double")
    posts.write.parquet(f"{tmp_path}/posts")
    posts = spark.read.parquet(f"{tmp_path}/posts")
    full = phrases.add_phrases(posts)
    low = lambda p: F.trim(F.lower(p))      # noqa: E731
    every = [r.t for r in full.select(F.explode(F.transform("phrases", low)).alias("t")).distinct().collect()]
    for terms in (sorted(every)[::3], every, []):
        kept = lambda df: sorted((r.id, sorted(p for p, t in zip(r.phrases, r.t) if t in terms)) for r in df.select(
            "id", "phrases", F.transform("phrases", low).alias("t")).collect())
        some = phrases.add_phrases_among(posts, terms)
        assert kept(some) == kept(full) and some.columns == full.columns
    # not all phrases are made for what is counted in all posts
    asked = []
    def among(terms):
        asked.append(set(terms))
        return phrases.add_phrases_among(posts, terms)
    found = sorted(map(tuple, topics.ranked_topics(full, among=among).collect()))
    assert asked and found == sorted(map(tuple, topics.ranked_topics(full).collect()))
    monkeypatch.setattr(topics, "HELD_CHARS", 0)
    asked.clear()
    assert found == sorted(map(tuple, topics.ranked_topics(full, among=among).collect())) and not asked
