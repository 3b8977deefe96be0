"""Document classes, label definitions, and parts added to a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medloom import schemas


def document_class(label: Column) -> Column:
    """(doc_class, prescription_type) of a label; an unknown or null label is of class 'base'."""
    kind = F.lit("base")
    for name, class_ in schemas.DOCUMENT_CLASSES.items():
        kind = F.when(label == name, class_).otherwise(kind)
    detail = F.lit(None).cast("string")
    for name, value in schemas.PRESCRIPTION_TYPES.items():
        detail = F.when(label == name, value).otherwise(detail)
    return F.struct(kind.alias("doc_class"), detail.alias("prescription_type"))


def with_part(parts: Column, part: Column) -> Column:
    """An array column with one more segment or entity at its end; a null array counts as empty, a null part adds nothing."""
    return F.when(part.isNull(), parts).otherwise(F.concat(F.coalesce(parts, F.slice(F.array(part), 1, 0)), F.array(part)))


def label_definitions(spark: SparkSession, thresholds: dict[str, float] | None = None) -> DataFrame:
    """(label, description, threshold, keyword_hints) of every label, in the labels' order (pos)."""
    given = thresholds or {}
    rows = [(i, x, schemas.LABEL_DESCRIPTIONS.get(x, x), float(given.get(x, schemas.LABEL_THRESHOLD)), list(schemas.KEYWORD_HINTS.get(x, ()))) for i, x in enumerate(schemas.DOCUMENT_LABELS)]
    return spark.createDataFrame(rows, "pos int, label string, description string, threshold double, keyword_hints array<string>")
