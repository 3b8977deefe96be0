"""Train, validation and test splits that keep related records together.

Components are found by hash-to-min: every node holds a cluster (at first itself and its neighbours), sends the cluster
to the cluster's minimum and the minimum to every member, until nothing changes. A cluster is a set of rows (node,
member), never a collected list, so a node with a third of all links is spread over tasks. Before that each task joins
the links that it reads, so that what is exchanged are nodes and the smallest they are linked to there, not links. Weighted rendezvous hashing
then gives each component the split with the highest score, independent of all other components.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medloom.runtime import cut, recut

SPLITS = {"train": 0.8, "validation": 0.1, "test": 0.1}
#: Members of a component that one block of its pairs has.
BLOCK = 500
#: Rows from which a key is hot, and hot keys that there may be at most: where rows are many, the first number rises instead.
HOT_ROWS, HOT_KEYS = 1_000_000, 10_000
#: Nodes whose links a task joins at once.
HELD = 500_000


def identifier(raw: Column, prefix: str) -> Column:
    """An identifier in one spelling: prefix, hyphen, digits; null for a placeholder (null, blank, no such identifier)."""
    plain = F.upper(F.regexp_replace(raw, r"[^\p{L}\p{Nd}]", ""))
    digits = F.regexp_extract(plain, rf"^{prefix}(\d+)$", 1)
    return F.when(digits != "", F.concat(F.lit(f"{prefix}-"), F.when(F.length(digits) < 8, F.lpad(digits, 8, "0")).otherwise(digits)))


def beside(rows: DataFrame, side: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined to ``side``, which has one row (key, n, ...) for each key with the number n of its rows.

    The rows of hot keys stay where they are and meet the at most HOT_KEYS rows of ``side`` that are theirs; so a key with a
    third of all rows is in no single task. ``total`` is the number of rows: without so many no key can be hot.
    """
    least = max(HOT_ROWS, total // HOT_KEYS)
    if total <= least:
        return rows.join(side, key)
    side = cut(side)
    hot = F.broadcast(side.filter(F.col("n") > least))
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(side.filter(F.col("n") <= least), key))


def _stars(batches):
    """(node, member) of rows (node, member): each node once with the smallest that the task's links join it to."""
    above: dict[str, str] = {}

    def top(x: str) -> str:
        path = []
        while (up := above.setdefault(x, x)) != x:
            path.append(x)
            x = up
        for one in path:
            above[one] = x
        return x

    def rows():
        nodes = list(above)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.string()), pa.array([top(x) for x in nodes], pa.string())], names=["node", "member"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = top(a), top(b)
            if a != b:
                above[max(a, b)] = min(a, b)
        if len(above) >= HELD:
            yield rows()
            above.clear()
    yield rows()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of the links; the component is its smallest node.

    Links with a null end join nothing; repeated links and links of a node to itself do no harm; no links, no rows.
    """
    links = links.select(F.col(a).alias("node"), F.col(b).alias("member")).filter("node is not null and member is not null")
    kind = links.dtypes[0][1]
    links = links.select(*[F.col(c).cast("string") for c in ("node", "member")]).mapInArrow(_stars, "node string, member string").select(*[F.col(c).cast(kind) for c in ("node", "member")])
    both = links.unionByName(links.select(F.col("member").alias("node"), F.col("node").alias("member")))
    clusters = cut(both.distinct())  # every node is linked to itself or what is smallest in its task, which is to itself
    count = F.count(F.lit(1)).alias("n")
    seen = clusters.agg(count, F.sum(F.xxhash64("node", "member").cast("decimal(38,0)"))).first()
    while True:
        sent = beside(clusters, clusters.groupBy("node").agg(F.min("member").alias("least"), count), "node", seen["n"])
        told = sent.select(F.explode(F.array(F.struct(F.col("least").alias("node"), "member"), F.struct(F.col("member").alias("node"), F.col("least").alias("member")))).alias("m"))
        clusters = recut(clusters, told.select("m.node", "m.member").distinct())
        state = clusters.agg(count, F.sum(F.xxhash64("node", "member").cast("decimal(38,0)"))).first()
        if state == seen:
            return recut(clusters, clusters.groupBy("node").agg(F.min("member").alias("component")))
        seen = state


def rendezvous(component: Column, splits: dict[str, float] = SPLITS, seed: int = 17) -> Column:
    """The split of a component by weighted rendezvous hashing: the highest -weight / ln(uniform hash) wins."""
    uniform = lambda name: (F.shiftrightunsigned(F.xxhash64(component, F.lit(name), F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    scores = [F.struct((F.lit(-float(weight)) / F.ln(uniform(name))).alias("score"), F.lit(name).alias("split")) for name, weight in splits.items() if weight > 0]
    return F.greatest(*scores)["split"] if len(scores) > 1 else F.lit(next(iter(splits)))


def assign(rows: DataFrame, entity: str, fallback: str, groups: DataFrame, splits: dict[str, float] = SPLITS, seed: int = 17) -> DataFrame:
    """``rows`` with component and split.

    ``entity`` is the entity's node (null: the row has none and goes by ``fallback``, e.g. a digest of its text, so that
    repeats of it stay together); an entity without links is a component of its own. Columns component and split that
    ``rows`` already has are replaced.
    """
    rows = rows.drop(*{"component", "split"} - {entity, fallback})
    known = rows.filter(F.col(entity).isNotNull()).join(groups.withColumnRenamed("node", entity), entity, "left")
    known = known.withColumn("component", F.coalesce("component", entity))
    alone = rows.filter(F.col(entity).isNull()).withColumn("component", F.col(fallback))
    return known.unionByName(alone).withColumn("split", rendezvous(F.col("component"), splits, seed)).drop(fallback)


def memberships(groups: DataFrame, prefix: str) -> DataFrame:
    """(node, group, n_nodes) of the nodes that begin with ``prefix``: the group is its smallest such node, n_nodes how many
    it has. One row a node however large its component is: the form for data at scale, where linked_pairs is quadratic."""
    own = groups.filter(F.col("node").startswith(prefix))
    sizes = own.groupBy("component").agg(F.min("node").alias("group"), F.count(F.lit(1)).alias("n"))
    return beside(own, sizes, "component", own.count()).select("node", "group", F.col("n").alias("n_nodes"))


def linked_pairs(groups: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b), a < b: every pair of nodes of one component.

    A component is cut into blocks by hash and its pairs are made block against block, so that the largest component is
    many small joins.
    """
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    placed = beside(groups, sizes, "component", groups.count()).withColumn("n", F.ceil(F.col("n") / block).cast("int"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    left = placed.select("component", F.col("own").alias("i"), other.alias("j"), F.col("node").alias("a"))
    right = placed.select("component", other.alias("i"), F.col("own").alias("j"), F.col("node").alias("b"))
    return left.join(right, ["component", "i", "j"]).filter("a < b").select("a", "b")
