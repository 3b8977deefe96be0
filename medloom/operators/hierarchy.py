"""Parent-child rows to full hierarchies.

1. Leaves are peeled to expose cycles: pointers are followed until they end, and nodes whose pointer never ends are on or
   below a cycle. Among those, the image of the parent function applied often enough is the cycles themselves.
2. The remaining forest is walked as one Euler tour (every node is entered and left once, siblings in order, one tree
   after the other), and the tour's successor list is ranked in parallel.
3. Entry and exit positions give depth and descendants; within blocks of tour positions, the intervals open at the
   block's start give every node's ancestors, root and path.

Both pointers and lists are followed by ``follow``: ranges of ids contract the stretches that lie within them, what
crosses from one range to another is a smaller problem of the same kind, and its solution is joined back. No step groups
rows by parent or root, so a parent or tree with most of the nodes is spread like any other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from medloom.runtime import cut, recut

CYCLE, BELOW_CYCLE = "CYCLE", "BELOW_CYCLE"
#: Tour positions a block covers; a block's nodes and its open ancestors are what one task holds.
BLOCK = 20_000
#: Rows of a range: what one task follows by itself (four numbers a row).
RANGE = 250_000
#: One row in so many is a splitter, where ranges alone don't make a problem small enough.
SPLITTER = 16
_ENDED, _OPEN, _LOST = 0, 1, 2
_STATE = "id bigint, to bigint, steps bigint, climb bigint, kind int"


def _ranges(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def _walk(batches):
    """The rows (id, to, steps, climb) of a range, each with its pointer moved to the first target outside the range.

    Pointer doubling on arrays. kind says whether a pointer ended, leads out of the range, or is caught in a cycle in it.
    """
    batches = list(batches)
    columns = [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in batches]) if batches else np.empty(0, np.int64) for i in (0, 2, 3)]
    to = np.concatenate([b.column(1).fill_null(-1).to_numpy(zero_copy_only=False) for b in batches]) if batches else np.empty(0, np.int64)
    order = np.argsort(columns[0], kind="stable")
    ids, steps, climb = (c[order] for c in columns)
    to = to[order]
    n = len(ids)
    if not n:
        return
    at = np.minimum(np.searchsorted(ids, to), n - 1)
    next_ = np.where((to >= 0) & (ids[at] == to), at, -1)
    for _ in range(n.bit_length() + 1):
        move = np.flatnonzero(next_ >= 0)
        if not len(move):
            break
        j = next_[move]
        more_steps, more_climb, new_to, new_next = steps[j], climb[j], to[j], next_[j]
        steps[move] += more_steps
        climb[move] += more_climb
        to[move] = new_to
        next_[move] = new_next
    kind = np.where(next_ >= 0, _LOST, np.where(to < 0, _ENDED, _OPEN)).astype(np.int32)
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(to, mask=to < 0), pa.array(steps), pa.array(climb), pa.array(kind)], names=["id", "to", "steps", "climb", "kind"])


def follow(pointers: DataFrame, size: int = RANGE) -> DataFrame:
    """(id, steps, climb, ended): what each pointer adds up to until it ends.

    In: (id, to, steps, climb), all bigint, at least 0 where ids; every ``to`` is an id, or null at an end; steps and climb
    are the weights of a row. Pointers that never end, as they lead to a cycle, have ``ended`` false and weights without
    a meaning. Lists and trees of any shape and depth do; ``size`` is the number of rows one task holds.
    """
    rows = cut(pointers.select("id", "to", "steps", "climb"))
    n = _ranges(rows.count(), size)
    placed = rows.coalesce(1) if n == 1 else rows.repartitionByRange(n, "id")
    local = recut(rows, placed.mapInArrow(_walk, _STATE))
    heads = local.filter(F.col("kind") == _OPEN).select(F.col("to").alias("id")).distinct()
    if n == 1:
        return local.select("id", "steps", "climb", (F.col("kind") == _ENDED).alias("ended"))
    met = cut(local.join(heads, "id", "left_semi"))
    count = met.count()
    open_ = met.select("id", F.when(F.col("kind") == _LOST, F.col("id")).otherwise(F.col("to")).alias("to"), "steps", "climb")
    solved = follow(open_, size) if count <= size else _by_splitters(open_, count, size)
    ahead = cut(solved.select(F.col("id").alias("to"), F.col("steps").alias("more"), F.col("climb").alias("up"), "ended"))
    both = local.join(ahead, "to", "left")
    here = F.col("kind") == _ENDED
    return both.select("id", (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), (F.col("climb") + F.coalesce("up", F.lit(0))).alias("climb"), (here | F.coalesce("ended", F.lit(False))).alias("ended"))


def _by_splitters(pointers: DataFrame, count: int, size: int) -> DataFrame:
    """follow for pointers that ranges don't contract: by doubling joins each moves to the next splitter, one row in
    SPLITTER by hash; the splitters alone are followed, and the rest add what is ahead of their splitter."""
    splitter = lambda c: F.pmod(F.xxhash64(c), F.lit(SPLITTER)) == 0
    moved = cut(pointers.withColumn("still", F.col("to").isNotNull() & ~splitter(F.col("to"))))
    for _ in range(count.bit_length() + 1):
        if not moved.filter("still").limit(1).count():
            break
        ahead = moved.select(F.col("id").alias("to"), F.col("to").alias("then"), F.col("steps").alias("more"), F.col("climb").alias("up"), F.col("still").alias("goes"))
        leapt = moved.filter("still").join(ahead, "to").select("id", F.col("then").alias("to"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("climb") + F.col("up")).alias("climb"), F.col("goes").alias("still"))
        moved = recut(moved, leapt.unionByName(moved.filter("not still")))
    # what still moves has gone further than there are rows: it is caught in a cycle without a splitter
    fixed = moved.select("id", F.when(F.col("still"), F.col("id")).otherwise(F.col("to")).alias("to"), "steps", "climb", "still")
    own = fixed.filter(splitter(F.col("id")))
    # a splitter caught below such a cycle points at itself, and so never ends
    ahead = follow(own, size).select(F.col("id").alias("to"), F.col("steps").alias("more"), F.col("climb").alias("up"), "ended")
    both = fixed.join(ahead, "to", "left")
    ended = ~F.col("still") & (F.col("to").isNull() | F.coalesce("ended", F.lit(False)))
    return both.select("id", (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), (F.col("climb") + F.coalesce("up", F.lit(0))).alias("climb"), ended.alias("ended"))


def _kinds(lost: DataFrame, size: int = RANGE) -> DataFrame:
    """(id, kind) of rows (id, parent) that never reach a root: on a cycle, or leading into one.

    Everything follows its pointer as many times as there are rows; what is pointed at then are the cycles.
    """
    count = lost.count()

    def images(batches):
        batches = list(batches)
        if not batches:
            return
        ids, to = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in batches]) for i in range(2))
        order = np.argsort(ids)
        ids, at = ids[order], np.searchsorted(ids[order], to[order])
        for _ in range(len(ids).bit_length()):
            at = at[at]
        on = np.zeros(len(ids), bool)
        on[at] = True
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.where(on, CYCLE, BELOW_CYCLE).tolist(), pa.string())], names=["id", "kind"])

    if count <= size:
        return lost.select("id", "parent").coalesce(1).mapInArrow(images, "id bigint, kind string")
    jumps = cut(lost.select("id", F.col("parent").alias("to")))
    for _ in range(count.bit_length()):
        jumps = recut(jumps, jumps.join(jumps.select(F.col("id").alias("to"), F.col("to").alias("then")), "to").select("id", F.col("then").alias("to")))
    on = jumps.select(F.col("to").alias("id")).distinct().withColumn("on", F.lit(True))
    kind = F.when(F.col("on"), F.lit(CYCLE)).otherwise(F.lit(BELOW_CYCLE)).alias("kind")
    return jumps.select("id").join(on, "id", "left").select("id", kind)


def _neighbours(trees: DataFrame, size: int = RANGE) -> DataFrame:
    """Rows (id, parent) with their next sibling and whether they are a first child, by a global sort instead of a window
    per parent."""
    keys = [F.col("parent").asc_nulls_first(), F.col("id")]
    n = _ranges(trees.count(), size)
    ranged = trees.select("id", "parent").coalesce(1) if n == 1 else trees.select("id", "parent").repartitionByRange(n, *keys)

    def lead(batches):
        batches = list(batches)
        if not batches:
            return
        ids = np.concatenate([b.column(0).to_numpy(zero_copy_only=False) for b in batches])
        up = np.concatenate([b.column(1).fill_null(-1).to_numpy(zero_copy_only=False) for b in batches])
        order = np.lexsort((ids, up))
        ids, up = ids[order], up[order]
        same = np.concatenate([up[1:] == up[:-1], [False]])
        ahead = np.concatenate([ids[1:], [-1]])
        # the ends of a range meet the ranges beside it
        edge = np.zeros(len(ids), bool)
        edge[[0, -1]] = True
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(up, mask=up < 0), pa.array(ahead, mask=~same), pa.array(edge)], names=["id", "parent", "sibling", "edge"])

    rows = cut(ranged.mapInArrow(lead, "id bigint, parent bigint, sibling bigint, edge boolean"))
    if n == 1:
        return rows.drop("edge")
    # two rows a range: the last of one and the first of the next may be siblings
    beside = Window.orderBy(F.col("parent").asc_nulls_first(), "id")
    ends = rows.filter("edge").withColumn("next", F.lead(F.struct("id", "parent")).over(beside))
    ends = ends.filter(F.col("sibling").isNull() & F.col("next.parent").eqNullSafe(F.col("parent")) & F.col("next.id").isNotNull()).select("id", F.col("next.id").alias("across"))
    return rows.join(F.broadcast(ends), "id", "left").select("id", "parent", F.coalesce("sibling", "across").alias("sibling"))


def euler_tour(forest: DataFrame, size: int = RANGE) -> DataFrame:
    """(id, entry, exit, depth) of rows (id bigint, parent bigint or null), which must form trees.

    entry and exit are positions in one tour over all trees; a node's descendants are the nodes whose entry lies between
    its entry and exit.
    """
    rows = cut(_neighbours(cut(forest), size))
    firsts = rows.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.min("id").alias("child"))
    arcs = rows.join(firsts, "id", "left").select(
        F.explode(
            F.array(
                F.struct((F.col("id") * 2).alias("id"), F.coalesce(F.col("child") * 2, F.col("id") * 2 + 1).alias("to"), F.lit(1).cast("bigint").alias("climb")),
                F.struct((F.col("id") * 2 + 1).alias("id"), F.coalesce(F.col("sibling") * 2, F.col("parent") * 2 + 1).alias("to"), F.lit(-1).cast("bigint").alias("climb")),
            )
        ).alias("a")
    )
    rank = follow(arcs.select("a.id", "a.to", F.lit(1).cast("bigint").alias("steps"), "a.climb"), size)
    total = F.lit(2 * rows.count())
    place = rank.select((F.col("id").bitwiseAND(1)).alias("up"), F.shiftright("id", 1).alias("id"), (total - F.col("steps")).alias("place"), "climb")
    return place.groupBy("id").agg(F.min("place").alias("entry"), F.max("place").alias("exit"), F.max(F.when(F.col("up") == 0, -F.col("climb"))).cast("int").alias("depth"))


def _blocks(tour: DataFrame) -> DataFrame:
    """Each node in the block of its entry, and as open ancestor in every later block that starts inside its interval."""
    own = tour.select("*", F.floor(F.col("entry") / BLOCK).alias("block"), F.lit(True).alias("own"))
    spans = tour.filter(F.floor(F.col("exit") / BLOCK) > F.floor(F.col("entry") / BLOCK))
    opened = spans.select("*", F.explode(F.sequence(F.floor(F.col("entry") / BLOCK) + 1, F.floor(F.col("exit") / BLOCK))).alias("block"), F.lit(False).alias("own"))
    return own.unionByName(opened)


def paths(tour: DataFrame) -> DataFrame:
    """(id, root, path) from entry-exit intervals of rows (id, name, entry, exit)."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        stack: list[tuple[int, str, str]] = []
        out = []
        for id_, name, entry, exit_, own in pdf.sort_values("entry")[["id", "name", "entry", "exit", "own"]].itertuples(index=False):
            while stack and stack[-1][0] < entry:
                stack.pop()
            path, root = (f"{stack[-1][1]} > {name}", stack[-1][2]) if stack else (name, name)
            stack.append((exit_, path, root))
            if own:
                out.append((id_, root, path))
        return pd.DataFrame(out, columns=["id", "root", "path"])

    return _blocks(tour.select("id", "name", "entry", "exit")).groupBy("block").applyInPandas(walk, "id bigint, root string, path string")


def closure(tour: DataFrame) -> DataFrame:
    """(ancestor, node, distance) for every node and each of its proper ancestors, from the same intervals."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        stack: list[tuple[int, str]] = []
        up, down, far = [], [], []
        for name, entry, exit_, own in pdf.sort_values("entry")[["name", "entry", "exit", "own"]].itertuples(index=False):
            while stack and stack[-1][0] < entry:
                stack.pop()
            if own:
                up += [x[1] for x in stack]
                down += [name] * len(stack)
                far += range(len(stack), 0, -1)
            stack.append((exit_, name))
        return pd.DataFrame({"ancestor": up, "node": down, "distance": far})

    return _blocks(tour.select("id", "name", "entry", "exit")).groupBy("block").applyInPandas(walk, "ancestor string, node string, distance int")


def numbered(nodes: DataFrame, size: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """(hierarchy, node, id) and (id, parent id or null) of rows (hierarchy, node, parent).

    Ids follow the order of (hierarchy, node), so siblings are toured in the order of their names, and nodes whose names
    share a beginning lie in one range.
    """
    keys = ["hierarchy", "node"]
    rows = cut(nodes)
    n = _ranges(rows.count(), size)
    ranged = rows.coalesce(1) if n == 1 else rows.repartitionByRange(n, *keys)
    ids = recut(rows, ranged.sortWithinPartitions(*keys).withColumn("id", F.monotonically_increasing_id()))
    up = ids.select("hierarchy", F.col("node").alias("parent"), F.col("id").alias("parent_id"))
    links = ids.join(up, ["hierarchy", "parent"], "left").select("id", F.col("parent_id").alias("parent"))
    return ids.select("hierarchy", "node", "id"), cut(links)


def hierarchies(nodes: DataFrame, size: int = RANGE) -> DataFrame:
    """Root, depth, path and tour interval of each node of one or more hierarchies.

    In: hierarchy, node, parent, one row per (hierarchy, node); other columns play no part. A null parent, or one that is
    no node, makes a root. Out: hierarchy, node, root_node, node_depth, node_path, entry, exit, n_descendants. A node on
    a cycle has root_node ``CYCLE``, one that only leads into a cycle ``BELOW_CYCLE``; both have depth -1, an empty path
    and no interval. Rows with a null node are dropped; an empty input gives no rows. ``size`` is the number of rows a task
    follows by itself.
    """
    names, tour, lost = _toured(nodes, size)
    named = cut(tour.join(names, "id").withColumn("name", F.col("node")))
    walked = named.drop("name").join(paths(named), "id").select(
        "hierarchy", "node", F.col("root").alias("root_node"), F.col("depth").alias("node_depth"), F.col("path").alias("node_path"),
        "entry", "exit", ((F.col("exit") - F.col("entry") - 1) / 2).cast("bigint").alias("n_descendants"),
    )
    nothing = F.lit(None).cast("bigint")
    return walked.unionByName(
        lost.join(names, "id").select("hierarchy", "node", F.col("kind").alias("root_node"), F.lit(-1).alias("node_depth"), F.lit("").alias("node_path"), nothing.alias("entry"), nothing.alias("exit"), nothing.alias("n_descendants"))
    )


def _ends(nodes: DataFrame, size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Names and links as of numbered, and (id, ended): whether a node's parents lead to a root."""
    names, links = numbered(nodes.filter("node is not null").select("hierarchy", "node", "parent"), size)
    one = F.lit(1).cast("bigint")
    return names, links, cut(follow(links.select("id", F.col("parent").alias("to"), one.alias("steps"), one.alias("climb")), size).select("id", "ended"))


def rooted(nodes: DataFrame, size: int = RANGE) -> DataFrame:
    """(hierarchy, node) of the nodes that reach a root."""
    names, _, ends = _ends(nodes, size)
    return names.join(ends.filter("ended").select("id"), "id", "left_semi").select("hierarchy", "node")


def _toured(nodes: DataFrame, size: int = RANGE) -> tuple[DataFrame, DataFrame, DataFrame]:
    names, links, ends = _ends(nodes, size)
    trees = links.join(ends.filter("ended").select("id"), "id", "left_semi")
    lost = cut(links.join(ends.filter("not ended").select("id"), "id", "left_semi"))
    return names, euler_tour(trees, size), _kinds(lost, size)


def descendants(nodes: DataFrame, size: int = RANGE) -> DataFrame:
    """(hierarchy, ancestor, node, distance): every node under each of its proper ancestors; nodes in or below a cycle have none."""
    names, tour, _ = _toured(nodes, size)
    named = cut(tour.join(names, "id"))
    one = named.withColumn("name", F.concat_ws("\u0001", "hierarchy", "node"))
    split = F.split("ancestor", "\u0001")
    return closure(one).select(split[0].alias("hierarchy"), split[1].alias("ancestor"), F.split("node", "\u0001")[1].alias("node"), "distance")


def code_nodes(rows: DataFrame, order: str = "row_no", code: str = "code", parent: str = "parent", hierarchy: str = "icd10") -> DataFrame:
    """(hierarchy, node, parent) of a table of codes.

    Codes and parents are compared in upper case with letters and digits only. Of several rows of a code the lowest
    ``order`` holds; rows without a code are dropped; a blank parent is null.
    """
    plain = lambda c: F.upper(F.regexp_replace(F.col(f"`{c}`"), r"[^\p{L}\p{Nd}]", ""))
    rows = rows.select(plain(code).alias("node"), F.nullif(plain(parent), F.lit("")).alias("parent"), F.col(f"`{order}`").alias("o")).filter("node <> ''")
    return rows.groupBy("node").agg(F.min(F.struct("o", "parent")).alias("m")).select(F.lit(hierarchy).alias("hierarchy"), "node", F.col("m.parent").alias("parent"))


def prefix_nodes(values: DataFrame, value: str = "item", hierarchy: str = "mesh") -> DataFrame:
    """(hierarchy, node, parent) of dotted numbers: the parent is the longest shorter dotted prefix that is a node."""
    nodes = cut(values.select(F.upper(F.trim(F.col(f"`{value}`"))).alias("node")).filter("node <> ''").distinct())
    parts = F.split("node", r"\.")
    prefixes = nodes.filter(F.size(parts) > 1).select("node", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "."))).alias("prefix"))
    known = prefixes.join(nodes.select(F.col("node").alias("prefix")), "prefix")
    parents = known.groupBy("node").agg(F.max_by("prefix", F.length("prefix")).alias("parent"))
    return nodes.join(parents, "node", "left").select(F.lit(hierarchy).alias("hierarchy"), "node", "parent")
