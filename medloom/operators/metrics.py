"""Classification metrics from (y_true, y_pred), all as grouped aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from medloom.functions import values as V
from medloom.runtime import cut


def _share(a, b):
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion(df: DataFrame) -> DataFrame:
    """(y_true, y_pred, n): pre-aggregated, so everything after it is as small as the number of classes squared."""
    return df.groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, classes: list) -> DataFrame:
    """A row for each true class and a column for each predicted one, 0 where nothing met."""
    wide = confusion(df).groupBy("y_true").pivot("y_pred", classes).agg(F.sum("n"))
    return wide.na.fill(0).select("y_true", *[F.col(str(c)).alias(f"pred_{c}") for c in classes])


def per_class(df: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) of every class of either side."""
    return _per_class(cut(confusion(df)))


def _per_class(cells: DataFrame) -> DataFrame:
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)
    true = cells.groupBy(F.col("y_true").alias("label")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    pred = cells.groupBy(F.col("y_pred").alias("label")).agg(F.sum("n").alias("n_pred"))
    both = true.join(pred, "label", "full").na.fill(0, ["support", "tp", "n_pred"])
    out = both.withColumn("precision", _share(F.col("tp"), F.col("n_pred"))).withColumn("recall", _share(F.col("tp"), F.col("support")))
    return out.withColumn("f1", _share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select("label", "precision", "recall", "f1", "support")


def accuracy_f1(df: DataFrame) -> DataFrame:
    """One row: accuracy, f1_micro (the same for one label a row), f1_macro."""
    cells = cut(confusion(df))
    accuracy = cells.agg(_share(F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)), F.sum("n")).alias("accuracy"))
    macro = _per_class(cells).agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("f1_macro"))
    return accuracy.withColumn("k", F.lit(1)).join(macro.withColumn("k", F.lit(1)), "k").select("accuracy", F.col("accuracy").alias("f1_micro"), "f1_macro")


def report(df: DataFrame) -> DataFrame:
    """per_class with the rows 'macro avg' and 'weighted avg'."""
    # what was predicted is computed once: three branches read the classes
    rows = cut(per_class(df).withColumn("label", F.col("label").cast("string")))
    macro = rows.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support")).select(F.lit("macro avg").alias("label"), "precision", "recall", "f1", "support")
    weighted = rows.agg(*[_share(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support"))
    return reduce(DataFrame.unionByName, [rows, macro, weighted.select(F.lit("weighted avg").alias("label"), "precision", "recall", "f1", "support")])


def top_k_accuracy(scores: DataFrame, k: int) -> DataFrame:
    """Share of rows whose true class is among their k best: scores (row_id, label, score, y_true); higher label first among equals."""
    order = Window.partitionBy("row_id").orderBy(F.desc("score"), F.desc("label"))
    hit = scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).groupBy("row_id").agg(F.max((F.col("label") == F.col("y_true")).cast("int")).alias("hit"))
    return hit.agg(F.avg("hit").alias("top_k_accuracy"))


def with_parents(predictions: DataFrame, parents: DataFrame, factor: float = 0.9) -> DataFrame:
    """Predictions (row_id, code, score) with missing parents added at ``factor`` times their lowest-scoring child.

    In: parents (code, parent). Rows are unique by (row_id, code); of equal ones the highest score holds.
    """
    kept = predictions.groupBy("row_id", "code").agg(F.max("score").alias("score"))
    added = kept.join(parents.filter("parent is not null"), "code").groupBy("row_id", F.col("parent").alias("code")).agg((F.min("score") * factor).alias("score"))
    return kept.unionByName(added.join(kept.select("row_id", "code"), ["row_id", "code"], "left_anti"))


def postprocess(df: DataFrame, key: str, scores: str, labels: list[str], k: int = 5, thresholds: dict[str, float] | None = None, parents: DataFrame | None = None, logits: bool = False) -> DataFrame:
    """(key, code, score): the labels kept of each row's array of scores.

    In that order: softmax where the scores are logits; the labels that reach their threshold if there are any thresholds,
    else the k best; missing parents of rows (code, parent). Null and empty arrays keep nothing.
    """
    p = V.softmax(F.col(scores)) if logits else F.col(scores)
    kept = V.above_thresholds(p, labels, thresholds) if thresholds else V.top_labels(p, labels, k)
    rows = df.filter(F.size(scores) > 0).select(F.col(key).alias("row_id"), F.explode(kept).alias("x")).select("row_id", F.col("x.label").alias("code"), F.col("x.prob").alias("score"))
    return (rows if parents is None else with_parents(rows, parents)).withColumnRenamed("row_id", key)
