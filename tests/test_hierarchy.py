import random

import pytest

from medloom.operators import hierarchy, taxonomy


def brute(parents):
    out = {}
    for node in parents:
        path, seen, x, state = [node], {node}, node, None
        while parents[x] in parents:
            x = parents[x]
            if x in seen:
                state = "CYCLE" if x == node else "BELOW_CYCLE"
                break
            seen.add(x)
            path.append(x)
        out[node] = (state, -1, "") if state else (x, len(path) - 1, " > ".join(reversed(path)))
    return out


def frame(spark, parents, name="h"):
    return spark.createDataFrame([(name, k, v, 7) for k, v in parents.items()], "hierarchy string, node string, parent string, id int")


# 8 rows a task: ranges contract, what crosses them is followed by splitters and again by ranges
@pytest.mark.parametrize("size", [hierarchy.RANGE, 8])
@pytest.mark.parametrize("shape", ["mixed", "chain", "star", "cycles"])
def test_like_brute_force(spark, shape, size, monkeypatch):
    monkeypatch.setattr(hierarchy, "BLOCK", 16)
    rng = random.Random(3)
    names = [f"n{i:03d}" for i in range(60)]
    parents = {
        "mixed": {n: rng.choice([None, "gone", *names]) for n in names},
        "chain": {n: names[i - 1] if i else None for i, n in enumerate(names)},
        "star": {n: names[0] if i else None for i, n in enumerate(names)},
        "cycles": {n: names[(i + 1) % 3] if i < 3 else names[i - 1] if i < 20 else n if i == 20 else None for i, n in enumerate(names)},
    }[shape]
    got = hierarchy.hierarchies(frame(spark, parents), size).collect()
    assert {r.node: (r.root_node, r.node_depth, r.node_path) for r in got} == brute(parents)
    inside = [r for r in got if r.node_depth >= 0]
    for r in inside:
        below = [x for x in inside if r["entry"] < x["entry"] < r["exit"]]
        assert len(below) == r.n_descendants
        assert all(x.node_path.startswith(r.node_path + " > ") for x in below)


def test_empty_null_and_two_hierarchies(spark):
    assert hierarchy.hierarchies(frame(spark, {"a": None}).limit(0)).count() == 0
    both = frame(spark, {"a": None, "b": "a"}, "x").unionByName(frame(spark, {"a": "b", "b": None}, "y"))
    got = {(r.hierarchy, r.node): r.root_node for r in hierarchy.hierarchies(both).collect()}
    assert got == {("x", "a"): "a", ("x", "b"): "a", ("y", "a"): "b", ("y", "b"): "b"}


def test_nodes_of_codes_and_prefixes(spark):
    rows = spark.createDataFrame([(2, "a-1", "B"), (1, "A1", " "), (3, None, "x"), (4, "b", None)], "row_no long, code string, parent string")
    got = {r.node: r.parent for r in hierarchy.code_nodes(rows).collect()}
    assert got == {"A1": None, "B": None}
    values = spark.createDataFrame([("a01",), ("A01.1.2",), ("A01.1.2",), (" ",), (None,)], "item string")
    assert {r.node: r.parent for r in hierarchy.prefix_nodes(values).collect()} == {"A01": None, "A01.1.2": "A01"}


def test_taxonomy_lookups(spark):
    tree = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "zz")], "code string, parent string")
    assert {(r.code, r.ancestor, r.distance) for r in taxonomy.ancestors(tree).collect()} == {("b", "a", 1), ("c", "b", 1), ("c", "a", 2)}
    assert {r.code: r.rolled for r in taxonomy.roll_up(tree, 2).collect()} == {"a": None, "b": None, "c": "a", "d": None}
    assert {r.code: r.rolled for r in taxonomy.roll_up(tree, 0).collect()}["d"] == "d"
    assert {r.code: r.n_children for r in taxonomy.children(tree).collect()} == {"a": 1, "b": 1}
