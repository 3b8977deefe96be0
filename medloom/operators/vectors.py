"""Vectors: scaling, exact nearest neighbours, and labels by the nearest labelled segments."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from medloom.functions.values import let

#: Rows of an index block; queries meet one block at a time.
BLOCK = 4096
#: Numbers in all queries together up to which they are broadcast (32 MB).
FEW = 4_000_000


def unit(c: Column) -> Column:
    """A vector of length 1 in double precision; a zero vector stays zero."""
    length = F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return let(length, lambda n: F.transform(c, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(unit(a), unit(b))


def best_of_rows(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the k highest scores of each row, highest first, the lower column first among equals."""
    if score.shape[1] > k:
        keep = score >= np.partition(score, -k, axis=1)[:, -k, None]
    else:
        keep = np.ones(score.shape, bool)
    rows, columns = np.nonzero(keep)
    order = np.lexsort((columns, -score[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[nth < k], columns[nth < k]


def nearest(queries: DataFrame, index: DataFrame, k: int = 5, digits: int = 6, width: int | None = None, few: int = FEW) -> DataFrame:
    """(query_id, entry_id, score, rank) of the k entries with the highest cosine for each query.

    In: queries (query_id, vector), index (entry_id, vector). Scores are rounded to ``digits`` and the higher entry_id
    comes first among equals. Queries and entries meet in blocks of bounded size; a meeting is a matrix product and sends
    k rows a query on, so the pairs are never rows. Queries of at most ``few`` numbers in all stand beside each task's
    entries, and nothing but the best is shuffled. Vectors that are null, not finite, or of another length than
    ``width`` (default: the most frequent length of the entries, the greater of equals) are left out; no entries, no rows.
    """
    queries, index = _clean(queries, "query_id"), _clean(index, "entry_id")
    if width is None:
        most = index.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
        width = most["width"] if most else 0
    queries, index = (df.filter(F.size("vector") == width) for df in (queries, index))
    asked = queries.count()
    if asked * max(width, 1) <= few:
        return _ranked(_beside(queries, index, k, digits), k)
    n_q, n_i = (max(1, -(-n // BLOCK)) for n in (asked, index.count()))
    place = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(place("query_id", n_q).alias("i"), every(n_i).alias("j"), "query_id", "vector")
    right = index.select(every(n_q).alias("i"), place("entry_id", n_i).alias("j"), "entry_id", "vector")
    kinds = dict(queries.dtypes)["query_id"], dict(index.dtypes)["entry_id"]

    def meet(q: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if q.empty or e.empty:
            return pd.DataFrame({"query_id": q["query_id"][:0], "entry_id": e["entry_id"][:0], "score": np.empty(0)})
        e = e.sort_values("entry_id", ascending=False, ignore_index=True)
        score = np.round(np.stack(q["vector"].to_numpy()) @ np.stack(e["vector"].to_numpy()).T, digits)
        rows, columns = best_of_rows(score, k)
        return pd.DataFrame({"query_id": q["query_id"].to_numpy()[rows], "entry_id": e["entry_id"].to_numpy()[columns], "score": score[rows, columns]})

    met = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(meet, f"query_id {kinds[0]}, entry_id {kinds[1]}, score double")
    return _ranked(met, k)


def _clean(df: DataFrame, key: str) -> DataFrame:
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x)) & (F.size("vector") > 0)
    return df.select(key, unit(F.col("vector")).alias("vector")).filter(F.col(key).isNotNull() & sound)


def _ranked(met: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("entry_id"))
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _beside(queries: DataFrame, index: DataFrame, k: int, digits: int) -> DataFrame:
    """Each task's k best entries of every query, the queries (at most FEW numbers) beside each batch of the index."""
    rows = queries.collect()
    kinds = dict(queries.dtypes)["query_id"], dict(index.dtypes)["entry_id"]
    shared = index.sparkSession.sparkContext.broadcast(([r["query_id"] for r in rows], np.array([r["vector"] for r in rows], np.float64)))

    def search(batches):
        names, matrix = shared.value
        best: list[pd.DataFrame] = [pd.DataFrame() for _ in range(0, len(names), BLOCK)]
        for e in batches:
            if e.empty:
                continue
            e = e.sort_values("entry_id", ascending=False, ignore_index=True)
            vectors, entries = np.stack(e["vector"].to_numpy()).T, e["entry_id"].to_numpy()
            for i, at in enumerate(range(0, len(names), BLOCK)):
                score = np.round(matrix[at : at + BLOCK] @ vectors, digits)
                rows, columns = best_of_rows(score, k)
                new = pd.DataFrame({"q": rows + at, "entry_id": entries[columns], "score": score[rows, columns]})
                both = pd.concat([best[i], new]).sort_values(["q", "score", "entry_id"], ascending=[True, False, False])
                best[i] = both.groupby("q").head(k)
        for part in best:
            if len(part):
                yield pd.DataFrame({"query_id": [names[q] for q in part["q"]], "entry_id": part["entry_id"], "score": part["score"]})

    return index.mapInPandas(search, f"query_id {kinds[0]}, entry_id {kinds[1]}, score double")


def label_by_neighbours(near: DataFrame, labels: list, document: str, threshold: float) -> DataFrame:
    """(document, label, score, predicted, evidence) for every document and label.

    In: near (document, query_id, entry_id, score, rank, label) and the list of labels; others are ignored. The score of a label is the best score of
    its entries near any of the document's segments, 0.0 without one; the earliest segment and rank win ties.
    """
    best = F.max_by(F.struct("entry_id", "query_id"), F.struct("score", (-F.col("query_id")).alias("q"), (-F.col("rank")).alias("r")))
    scored = near.filter("score > 0").groupBy(document, "label").agg(F.max("score").alias("score"), best.alias("evidence"))
    grid = near.select(document).distinct().withColumn("label", F.explode(F.array(*[F.lit(x) for x in labels])))
    out = grid.join(scored, [document, "label"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return out.withColumn("predicted", F.col("score") >= threshold)


def wide_predictions(predictions: DataFrame, document: str, labels: list, evidence: Column | None = None) -> DataFrame:
    """One row for each document with flag and score of each label and, with ``evidence``, a text column of it."""
    shown = [F.first(evidence.cast("string")).alias("evidence")] if evidence is not None else []
    return predictions.groupBy(document).pivot("label", labels).agg(F.first("predicted").alias("flag"), F.first("score").alias("score"), *shown)


def hybrid_labels(near: DataFrame, definitions: DataFrame, document: str, similarity: bool = True, classified: DataFrame | None = None) -> DataFrame:
    """label_by_neighbours with each label's own threshold and, where a classifier's (document, label, score) are given, the
    higher of both scores.

    In: definitions (pos, label, threshold). Raises where no strategy is left or a label has two definitions or none.
    """
    if not similarity and classified is None:
        raise ValueError("neither similarity nor a classifier")
    rows = definitions.orderBy("pos").collect()  # a row for each label
    labels = [r["label"] for r in rows]
    if not labels or len(set(labels)) < len(labels) or any(r["threshold"] is None for r in rows):
        raise ValueError("every label needs one definition with a threshold")
    limits = F.create_map(*[x for r in rows for x in (F.lit(r["label"]), F.lit(float(r["threshold"])))])
    out = label_by_neighbours(near if similarity else near.filter(F.lit(False)), labels, document, 0.0)
    if classified is not None:
        other = classified.groupBy(document, "label").agg(F.max("score").alias("_classified"))
        out = out.join(other, [document, "label"], "full" if not similarity else "left")
        out = out.withColumn("score", F.coalesce(F.greatest("score", "_classified"), F.lit(0.0))).drop("_classified")
    return out.withColumn("predicted", F.col("score") >= limits[F.col("label")])


def write_index(entries: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A stored index of rows (entry_id, vector): vectors of length 1, those that are null or not finite left out."""
    _clean(entries, "entry_id").write.mode(mode).parquet(path)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a stored index, for ``nearest``."""
    return spark.read.parquet(path)
