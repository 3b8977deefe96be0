"""Lookups in a code tree of rows (code, description, parent)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medloom.operators import hierarchy
from medloom.runtime import cut


def _nodes(tree: DataFrame) -> DataFrame:
    return tree.select(F.lit("tree").alias("hierarchy"), F.col("code").alias("node"), "parent")


def parents(tree: DataFrame) -> DataFrame:
    """(code, parent): null for a root and for a parent that is no node."""
    known = tree.select(F.col("code").alias("parent")).distinct().withColumn("known", F.lit(True))
    return tree.join(known, "parent", "left").select("code", F.when(F.col("known"), F.col("parent")).alias("parent"))


def children(tree: DataFrame) -> DataFrame:
    """(code, n_children, first_child) of nodes that have any."""
    links = parents(tree).filter("parent is not null")
    return links.groupBy(F.col("parent").alias("code")).agg(F.count(F.lit(1)).alias("n_children"), F.min("code").alias("first_child"))


def ancestors(tree: DataFrame) -> DataFrame:
    """(code, ancestor, distance) for every node and each node above it. Nodes on or below a cycle have none."""
    return hierarchy.descendants(_nodes(tree)).select(F.col("node").alias("code"), "ancestor", "distance")


def descendants(tree: DataFrame) -> DataFrame:
    """(code, descendant, distance) for every node and each node below it."""
    return hierarchy.descendants(_nodes(tree)).select(F.col("ancestor").alias("code"), F.col("node").alias("descendant"), "distance")


def roll_up(tree: DataFrame, levels: int) -> DataFrame:
    """(code, rolled) where rolled is so many parents up, null if there are fewer: one join a level.

    Nodes on or below a cycle have none.
    """
    known = parents(tree)
    if levels:
        known = cut(known.join(hierarchy.rooted(_nodes(tree)).select(F.col("node").alias("code")), "code", "left_semi"))
    out = tree.select("code", F.col("code").alias("rolled"))
    for _ in range(levels):
        out = out.join(known.select(F.col("code").alias("rolled"), "parent"), "rolled", "left").select("code", F.col("parent").alias("rolled"))
    return out


def get(tree: DataFrame, codes: DataFrame) -> DataFrame:
    """The nodes (code, parent, has_children) of the codes that there are, of rows (code); others have no row."""
    links = parents(tree)
    above = links.filter("parent is not null").select(F.col("parent").alias("code")).distinct().withColumn("has_children", F.lit(True))
    found = links.join(codes.select("code").distinct(), "code", "left_semi").join(above, "code", "left")
    return found.withColumn("has_children", F.coalesce("has_children", F.lit(False)))


def size(tree: DataFrame) -> DataFrame:
    """One row with the number of nodes."""
    return tree.agg(F.count_distinct("code").alias("n_codes"))
