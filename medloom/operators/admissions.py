"""Admissions: fixed-width lines, documents joined to admissions, and texts by admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medloom.functions import text as T
from medloom.functions.values import associated_codes
from medloom.operators.candidates import first_wins
from medloom.runtime import cut, partitions
from medloom.schemas import ADMISSION_FIELDS, ASSOCIATED_FROM

#: Characters of a chunk of a key's texts, and the most that one joined text may have (a value ends at 2 GB).
CHUNK, MOST_JOINED = 1_000_000, 500_000_000
OPTIONAL = ("birth_date", "sex", "admission_date", "discharge_date", "related_diagnosis_code")


def parse_lines(df: DataFrame, line: str = "value") -> DataFrame:
    """The fields of each non-blank fixed-width line; a short line's missing fields are empty, optional ones null."""
    value = F.col(line)
    fields = {name: T.fixed_field(value, a, b) for name, (a, b) in ADMISSION_FIELDS.items()}
    fields = {name: F.nullif(c, F.lit("")) if name in OPTIONAL else c for name, c in fields.items()}
    rest = F.substring(value, ASSOCIATED_FROM + 1, 1 << 30)
    return df.filter(T.strip(value) != "").withColumns({**fields, "associated_diagnosis_codes": associated_codes(rest), "procedure_codes": F.array().cast("array<string>")})


def missing_columns(df: DataFrame, *wanted: str) -> list[str]:
    return sorted(set(wanted) - set(df.columns))


def join_documents(documents: DataFrame, admissions: DataFrame, *order: str) -> DataFrame:
    """Every document with the first admission row of its admission_id; null columns where there is none.

    Documents without an admission_id are not joined (they keep null columns), so they don't meet in one task.
    """
    first = first_wins(admissions.filter("admission_id is not null"), "admission_id", *order)
    joined = documents.filter("admission_id is not null").join(first, "admission_id", "left")
    return joined.unionByName(documents.filter("admission_id is null"), allowMissingColumns=True)


def text_chunks(df: DataFrame, key: str, text: str, order: str, size: int = CHUNK) -> DataFrame:
    """(key, chunk, text): the non-null texts of each key in order, joined by blanks, in chunks of about ``size`` characters.

    A chunk is whole texts: a text belongs to the chunk in which it begins, so a chunk exceeds ``size`` by less than its
    last text. Positions come from running sums over ranges of (key, order), never from one key's rows in one task, so a
    key with a third of all rows is spread. Ties of ``order`` go by the text. Null keys are a key of their own.
    """
    keys = ["key", "o", "t"]
    rows = df.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(order).alias("o"), F.col(text).alias("t"))
    n = partitions(df.sparkSession)
    ranged = cut(rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id()))
    # characters of each key before a range: one row for each range and key that meet
    met = ranged.groupBy("part", "key").agg((F.sum(F.length("t")) + F.count(F.lit(1))).alias("n"))
    same = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = met.withColumn("before", F.coalesce(F.sum("n").over(same), F.lit(0))).select("part", F.col("key").alias("k"), "before")
    within = Window.partitionBy("part", "key").orderBy("o", "t").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("at", F.coalesce(F.sum(F.length("t") + 1).over(within), F.lit(0)))
    placed = placed.join(before.withColumnRenamed("part", "p"), (F.col("part") == F.col("p")) & F.col("key").eqNullSafe(F.col("k")))
    placed = placed.withColumn("chunk", F.floor((F.col("at") + F.col("before")) / size))
    parts = F.array_sort(F.collect_list(F.struct("o", "t")))
    return placed.groupBy("key", "chunk").agg(F.array_join(F.transform(parts, lambda x: x["t"]), " ").alias("t")).select(F.col("key").alias(key), "chunk", F.col("t").alias(text))


def joined_text(df: DataFrame, key: str, text: str, order: str, separator: str = " ", most: int = MOST_JOINED) -> DataFrame:
    """(key, text) with the non-null texts of each key in order.

    The key's own texts are the result, so one with more than ``most`` characters stops the job with an error instead of
    an overflow; text_chunks has no such limit.
    """
    sizes = df.filter(F.col(text).isNotNull()).groupBy(key).agg(F.sum(F.length(text)).alias("n")).filter(F.col("n") > most)
    if (row := sizes.first()) is not None:
        raise ValueError(f"the texts of {key} {row[0]!r} have {row['n']} characters, more than {most}; use text_chunks")
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return df.filter(F.col(text).isNotNull()).groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["t"]), separator).alias(text))


def value_counts(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(value, count) of the first value of each key, most frequent first."""
    first = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(value, order).alias(value)).filter(T.strip(F.col(value)) != "")
    return first.groupBy(value).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), value)


def length_stats(lengths: Column) -> list[Column]:
    """Mean, median and longest, 0.0 without rows."""
    return [F.coalesce(F.avg(lengths), F.lit(0.0)).alias("mean"), F.coalesce(F.median(lengths), F.lit(0.0)).alias("median"), F.coalesce(F.max(lengths).cast("double"), F.lit(0.0)).alias("max")]
