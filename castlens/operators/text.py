"""Word count over whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castlens.functions.columns import WORD_SEPARATORS, word_tokens


def word_count(df: DataFrame, text_col: str = "value", pattern: str = WORD_SEPARATORS,
               word_col: str = "word", count_col: str = "count") -> DataFrame:
    """Occurrences of each whitespace-separated token, case kept.

    Tokens are exploded per row and counted with a map-side partial count, so
    a very frequent word ships one partial row per task, not one per occurrence.
    """
    words = df.select(F.explode(word_tokens(text_col, pattern)).alias(word_col)).where(F.col(word_col) != F.lit(""))
    return words.groupBy(word_col).agg(F.count(F.lit(1)).alias(count_col))
