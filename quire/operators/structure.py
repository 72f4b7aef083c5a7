"""Structure of printed books: paragraphs from lines, chapters from paragraphs, regions from words."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

from quire.operators.chapters import candidates, chapters, section_openings
from quire.operators.paragraphs import paragraphs
from quire.operators.regions import line_regions, located, sentences, word_parts

__all__ = ["candidates", "chapters", "fold", "line_regions", "located", "paragraphs", "section_openings", "sentences", "word_parts"]


def fold(rows: DataFrame, keys: list[str], order: list[str], step: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``step`` on each group in order: for scans of small groups that carry state from row to row."""
    return rows.groupBy(*keys).applyInPandas(lambda pdf: step(pdf.sort_values(order, ignore_index=True)), schema)
