"""Categories from a user's own model."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.text import text_or_empty
from ..schema import DEFAULT_CATEGORY, VALID_CATEGORIES
from ..sources.workers import importable

# --- fixed values ---
BATCH_ROWS = 16
NO_TEXT = "no title"
# --------------------

#: Categories for texts, given the texts and the categories to choose from.
Model = Callable[[list[str], list[str]], list[str]]
_log = logging.getLogger(__name__)


def labelled(model: Model, texts: list[str], categories: list[str]) -> list[str]:
    """The model's category of each text. A batch that fails is halved, so that only the texts that fail
    alone, and answers that are no category, become the default."""
    try:
        found = list(model(texts, categories))
        if len(found) != len(texts):
            raise ValueError(f"{len(found)} categories for {len(texts)} texts")
    except Exception as error:      # a user's model may raise anything
        if len(texts) == 1:
            _log.warning("no category: %s", error)
            return [DEFAULT_CATEGORY]
        half = len(texts) // 2
        return labelled(model, texts[:half], categories) + labelled(model, texts[half:], categories)
    return [c if c in categories else DEFAULT_CATEGORY for c in found]


def classify_with_model(
    posts: DataFrame, load: Callable[[], Model], text_col: str = "title", categories: list[str] | None = None,
    batch_rows: int = BATCH_ROWS,
) -> DataFrame:
    """Add `category` from a model that `load` returns; a category the posts have is replaced.

    Each task loads the model once. The texts of an Arrow batch go to it in batches of `batch_rows` texts of
    similar length; a null or blank text is "no title". Where the model can't be loaded, all rows of the
    task are "general"."""
    categories = list(categories or VALID_CATEGORIES)
    importable(posts.sparkSession)

    @F.pandas_udf("string")
    def category(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            model = load()
        except Exception as error:
            _log.error("no model: %s", error)
            model = None
        for texts in batches:
            found = pd.Series([DEFAULT_CATEGORY] * len(texts), dtype=object)
            if model is not None:
                texts = texts.reset_index(drop=True)
                order = texts.str.len().sort_values(kind="stable").index.to_numpy()
                for at in range(0, len(order), batch_rows):
                    rows = order[at:at + batch_rows]
                    found.iloc[rows] = labelled(model, texts.iloc[rows].tolist(), categories)
            yield found

    text = text_or_empty(F.col(text_col))
    return posts.withColumn("category", category(F.when(F.trim(text) == "", NO_TEXT).otherwise(text)))
