import itertools
import os
import random

from pyspark.sql import functions as F

from medloom.llm import splits


def brute(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def test_components_like_union_find(spark):
    rng = random.Random(5)
    links = [(f"n{rng.randrange(80):02d}", f"n{rng.randrange(80):02d}") for _ in range(60)] + [(None, "n01"), ("n02", None), ("n03", "n03")]
    links += [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(40)] + [("hub", f"h{i}") for i in range(50)]
    df = spark.createDataFrame([(a, b, "z") for a, b in links], "a string, b string, node string")
    assert {r.node: r.component for r in splits.components(df).collect()} == brute(links)
    assert splits.components(df.limit(0)).count() == 0


def test_identifiers(spark):
    raw = ["PAT-00000012", " pat_00000012", "Pat 00000012.", "PAT--00000012", "unknown", "Un-Known", "", "  ", None, "ADM-00000012"]
    df = spark.createDataFrame([(x,) for x in raw], "x string")
    assert [r[0] for r in df.select(splits.identifier(F.col("x"), "PAT")).collect()] == ["PAT-00000012"] * 4 + [None] * 6


def test_assignment(spark):
    groups = spark.createDataFrame([("P1", "A"), ("P2", "A")], "node string, component string")
    rows = spark.createDataFrame([(i, f"P{i % 400}" if i % 7 else None, f"t{i % 5}", "old") for i in range(2000)], "k int, entity string, fallback string, split string")
    got = splits.assign(rows.drop("split"), "entity", "fallback", groups).collect()
    assert len(got) == 2000 and len({r.split for r in got if r.entity in ("P1", "P2")}) == 1
    by_unit = {}
    for r in got:
        by_unit.setdefault(r.component, set()).add(r.split)
    assert all(len(v) == 1 for v in by_unit.values())
    share = sum(r.split == "train" for r in got) / len(got)
    assert 0.7 < share < 0.9
    assert {r.split for r in splits.assign(rows, "entity", "fallback", groups).collect()} == set(splits.SPLITS)


def test_pairs_in_blocks(spark):
    groups = spark.createDataFrame([(f"n{i:02d}", "c") for i in range(23)] + [("x", "d")], "node string, component string")
    got = sorted((r.a, r.b) for r in splits.linked_pairs(groups, block=4).collect())
    assert got == list(itertools.combinations([f"n{i:02d}" for i in range(23)], 2))


def test_hot_keys_stay_spread(spark, monkeypatch):
    """A hub with most links and a component with most nodes go the way of hot keys; nothing changes but the plan."""
    monkeypatch.setattr(splits, "HOT_ROWS", 20)
    monkeypatch.setattr(splits, "HOT_KEYS", 1000)
    links = [("hub", f"h{i:02d}") for i in range(60)] + [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(30)] + [("x", "y")]
    df = spark.createDataFrame(links, "a string, b string")
    groups = splits.components(df)
    assert {r.node: r.component for r in groups.collect()} == brute(links)
    pairs = {(r.a, r.b) for r in splits.linked_pairs(groups, block=7).collect()}
    members = {}
    for node, root in brute(links).items():
        members.setdefault(root, []).append(node)
    assert pairs == {p for nodes in members.values() for p in itertools.combinations(sorted(nodes), 2)}
    got = {(r.node, r.group, r.n_nodes) for r in splits.memberships(groups, "h").collect()}
    assert got == {(n, "h00", 61) for n in ["hub", *[f"h{i:02d}" for i in range(60)]]}
    assert splits.memberships(groups.limit(0), "h").count() == 0


def test_superseded_tables_are_deleted(spark):
    folder = spark.sparkContext._jsc.sc().getCheckpointDir()
    links = spark.createDataFrame([(f"c{i:02d}", f"c{i + 1:02d}") for i in range(30)], "a string, b string")
    splits.components(links)
    if folder.isDefined():
        path = folder.get().removeprefix("file:")
        before = set(os.listdir(path))
        splits.components(links)
        assert len(set(os.listdir(path)) - before) == 1
