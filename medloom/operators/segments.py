"""Overlapping windows of words."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medloom.functions import text as T

WINDOW, OVERLAP, LEAST_CHARS = 220, 60, 50
_WORD = re.compile(r"\w+")


def word_windows(df: DataFrame, key: str, text: str, window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """(key, seq, start_token, n_tokens, words) of each window of words, JVM only.

    A window starts every ``window - overlap`` words, until one reaches the end. Texts without a word, and null texts,
    have none. One pass, no shuffle.
    """
    if not 0 <= overlap < window:
        raise ValueError("overlap must be smaller than the window")
    step = window - overlap
    # white space is no part of a word, so the text needn't be collapsed first
    rows = df.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), T.words(F.col(text)).alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size("w") - window) / step).cast("int")) * step, F.lit(step))
    rows = rows.select("key", "w", F.posexplode(starts).alias("seq", "start_token"))
    return rows.select(F.col("key").alias(key), "seq", "start_token", F.slice("w", F.col("start_token") + 1, window).alias("words")).withColumn("n_tokens", F.size("words")).filter("n_tokens > 0")


def segment_texts(df: DataFrame, key: str, text: str, window: int = WINDOW, overlap: int = OVERLAP, least: int = LEAST_CHARS, prefix: str = "seg") -> DataFrame:
    """(key, segment_id, start_char, end_char, segment) with exact character offsets into the collapsed text.

    Segments shorter than ``least`` characters are dropped and the numbers of the rest stay without gaps. Offsets need one
    scan of the text with memory of all word positions, which no built-in has, so this is an Arrow UDF.
    """
    step = window - overlap

    @F.pandas_udf("array<struct<segment_id:string,start_char:int,end_char:int,segment:string>>")
    def cut(texts: pd.Series) -> pd.Series:
        out = []
        for value in texts:
            spans = [m.span() for m in _WORD.finditer(value or "")]
            found: list[dict] = []
            for first in range(0, len(spans), step):
                last = min(first + window, len(spans))
                start, end = spans[first][0], spans[last - 1][1]
                if end - start >= least:
                    found.append({"segment_id": f"{prefix}_{len(found):04d}", "start_char": start, "end_char": end, "segment": value[start:end]})
                if last == len(spans):
                    break
            out.append(found)
        return pd.Series(out)

    return df.select(F.col(key), F.explode(cut(T.collapse_spaces(F.col(text)))).alias("s")).select(key, "s.*")
