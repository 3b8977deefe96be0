"""Corpus summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summary(docs: DataFrame, text: str, n_segments: Column) -> DataFrame:
    """One row: n_files, total_chars, avg_chars, total_segments, avg_segments; null texts count as empty."""
    length = F.coalesce(F.length(text), F.lit(0))
    return docs.agg(
        F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum(length), F.lit(0)).alias("total_chars"), F.coalesce(F.avg(length), F.lit(0.0)).alias("avg_chars"),
        F.coalesce(F.sum(n_segments), F.lit(0)).alias("total_segments"), F.coalesce(F.avg(n_segments), F.lit(0.0)).alias("avg_segments"),
    )


def window_count(n_words: Column, window: int, overlap: int) -> Column:
    """How many windows segments.word_windows makes of so many words."""
    step = window - overlap
    return F.when(n_words <= 0, 0).otherwise(F.greatest(F.lit(0), F.ceil((n_words - window) / step)) + 1).cast("bigint")


def keyword_hits(docs: DataFrame, text: str, hints: dict[str, tuple[str, ...]]) -> DataFrame:
    """(label, n_docs): texts that contain at least one hint of the label, as substrings in any case. One pass."""
    small = F.lower(F.coalesce(F.col(text), F.lit("")))
    hit = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(small, w))
    counts = docs.agg(*[F.count(F.when(hit(words), 1)).alias(label) for label, words in hints.items()])
    return counts.select(F.explode(F.create_map(*[x for label in hints for x in (F.lit(label), F.col(label))])).alias("label", "n_docs"))


def labels_per_document(docs: DataFrame, labels: str) -> DataFrame:
    """(n_labels, n_docs); null lists count as empty."""
    return docs.groupBy(F.coalesce(F.size(labels), F.lit(0)).alias("n_labels")).agg(F.count(F.lit(1)).alias("n_docs"))


def label_counts(docs: DataFrame, labels: str) -> DataFrame:
    return docs.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n_docs"))
