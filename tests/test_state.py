"""Days that change as a whole, days by file time, and run summaries that merge."""

import datetime as dt
import random
from functools import reduce

import pytest
from pyspark.sql import functions as F

from risetide.operators import runs
from risetide.operators.history import score_runs
from risetide.plans import daily
from risetide.sources import tables
from risetide.sources.commit import DayLake
from risetide.sources.tables import POSTS, SCORES, TRACKED, Lake

from test_daily import inputs, snapshot, submissions  # noqa: F401  (inputs is a fixture)

NOW = dt.datetime(2024, 1, 31, 12)


def land(spark, lake, title):
    daily.collect_day(lake, NOW, submissions=submissions(spark, [(1, title, "solar great", 9), (2, "vote " + title, None, 4)]))


@pytest.mark.parametrize("fatal", [SCORES, TRACKED])
def test_a_run_that_dies_changes_nothing(spark, tmp_path, inputs, fatal):  # noqa: F811
    class Dies(DayLake):
        def write(self, df, table, *partition_by):
            if table == fatal:
                raise ConnectionError
            super().write(df, table, *partition_by)

    whole = DayLake(spark, str(tmp_path))
    land(spark, whole, "solar")
    assert daily.process_day(whole, NOW, inputs) == daily.OK
    before = snapshot(whole)
    assert before["posts"] and before["scores"]
    dies = Dies(spark, str(tmp_path))
    land(spark, dies, "other")
    with pytest.raises(ConnectionError):
        daily.process_day(dies, NOW, inputs)
    assert snapshot(DayLake(spark, str(tmp_path))) == before
    again = DayLake(spark, str(tmp_path))
    assert daily.process_day(again, NOW, inputs) == daily.OK
    after = snapshot(again)
    assert after != before and {p[1] for p in after["posts"]} == {"general", "politics"}
    day = tmp_path / "days" / "2024-01-31"
    assert len([p for p in day.iterdir() if p.is_dir()]) == 1     # neither the dead run nor the replaced one


def test_whole_days_tell_what_partitions_tell(spark, tmp_path, inputs):  # noqa: F811
    lakes = Lake(spark, str(tmp_path / "a")), DayLake(spark, str(tmp_path / "b"))
    for lake in lakes:
        for days in (40, 0):
            now = NOW - dt.timedelta(days=days)
            daily.collect_day(lake, now, submissions=submissions(spark, [(days + 1, "solar", None, 9), (99, "vote", None, 50 - days)]))
            assert daily.process_day(lake, now, inputs) == daily.OK
    told = [{k: sorted(sorted(map(str, row)) for row in rows) for k, rows in snapshot(lake).items()} for lake in lakes]
    assert told[0] == told[1]
    assert [lake.partitions(SCORES, "date") for lake in lakes] == [[dt.date(2024, 1, 31)]] * 2


def test_empty_lake_of_days(spark, tmp_path):
    lake = DayLake(spark, str(tmp_path / "none"))
    assert lake.posts().count() == 0 and lake.partitions(POSTS, "date") == [] and lake.tracked().count() == 0


def test_days_by_file_time(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    rows = spark.createDataFrame([("a", dt.date(2024, 1, d)) for d in (1, 2, 3)], "url string, date date")
    for day in (3, 1, 2):
        lake.write(rows.where(F.dayofmonth("date") == day), POSTS, "date")
    stored = spark.read.parquet(lake.path(POSTS))
    assert [r.date.day for r in tables.listed_days(stored).collect()] == [2, 1, 3]


def test_summaries_merge_in_any_grouping(spark):
    draw = random.Random(1)
    rows = []
    for url in range(120):
        score = draw.choice([0, 5, 1000])
        for day in sorted(draw.sample(range(1, 29), draw.randint(1, 14))):
            score = max(0, score + draw.choice([-3, -1, 0, 0, 0, 4, 5, 40]))
            rows.append((f"u{url}", dt.date(2024, 1, day), score))
    history = spark.createDataFrame(rows, "url string, date date, score bigint").cache()
    want = sorted(map(tuple, score_runs(history).collect()))
    days = runs.one_day(history)
    assert sorted(map(tuple, runs.days_of(runs.merged(days)).collect())) == want
    for _ in range(3):
        cuts = sorted(draw.sample(range(1, 28), 4))
        stretch = reduce(lambda a, b: a + b, [(F.col("date") > dt.date(2024, 1, c)).cast("int") for c in cuts])
        parts = [runs.merged(runs.one_day(history.where(stretch == k))) for k in range(5)]
        draw.shuffle(parts)
        assert sorted(map(tuple, runs.days_of(runs.merged(*parts)).collect())) == want
    assert runs.merged(runs.one_day(history.where("false"))).count() == 0


def test_a_day_adds_one_row_a_url(spark):
    scores = [10, 9, 9, 9, 20, 20, 19, 18]
    rows = [("u", dt.date(2024, 1, d + 1), s) for d, s in enumerate(scores)]
    held = None
    for k, row in enumerate(rows):
        today = runs.one_day(spark.createDataFrame([row], "url string, date date, score bigint"))
        held = today if held is None else runs.merged(held, today)
        if k in (3, 7):
            want = score_runs(spark.createDataFrame(rows[:k + 1], "url string, date date, score bigint"))
            assert runs.days_of(held).collect() == want.collect()
