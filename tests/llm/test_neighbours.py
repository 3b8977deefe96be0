import math

import numpy as np
import pyarrow as pa
import pytest

from medloom.llm import neighbours


def brute(keys, x, k, least):
    s = np.round(x @ x.T, 9)
    np.fill_diagonal(s, -2)
    top = [set(np.argsort(-row, kind="stable")[:k]) for row in s]
    return {(keys[i], keys[j]) for i in range(len(keys)) for j in top[i] if i < j and i in top[j] and s[i, j] >= least}


def data(n=400, dims=64, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims))
    for i in range(0, n, 4):
        x[i + 1] = x[i] + rng.standard_normal(dims) * rng.uniform(0.02, 0.45)
    return [f"k{i:04d}" for i in range(n)], x


def frame(spark, keys, x):
    return spark.createDataFrame([(k, [float(v) for v in row], 0) for k, row in zip(keys, x)], "ui string, vector array<float>, id int")


def close(spark, keys, x, **options):
    vectors = neighbours.usable(frame(spark, keys, x), "ui", "vector", x.shape[1])
    return {(r.key_a, r.key_b) for r in neighbours.close_pairs(vectors, **options).collect()}


def test_recall_against_brute_force(spark):
    keys, x = data()
    unit = x.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    true, got = brute(keys, unit, 10, 0.95), close(spark, keys, x)
    assert got <= true and len(got & true) >= 0.97 * len(true) > 20


def test_crowded_buckets_are_exact(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CROWDED", 5)
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rng = np.random.default_rng(3)
    x = np.vstack([rng.standard_normal(64) + rng.standard_normal((60, 64)) * 0.02, rng.standard_normal((60, 64))])
    keys = [f"k{i:04d}" for i in range(len(x))]
    unit = x.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    assert close(spark, keys, x, k=4) == brute(keys, unit, 4, 0.95)


def test_hot_buckets_of_the_sample(spark, monkeypatch):
    """Buckets that a sample shows to be hot never meet in one task; the result is the same."""
    monkeypatch.setattr(neighbours, "SAMPLE", 60)
    monkeypatch.setattr(neighbours, "HOT", 0.1)
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rng = np.random.default_rng(3)
    x = np.vstack([rng.standard_normal(64) + rng.standard_normal((60, 64)) * 0.02, rng.standard_normal((60, 64))])
    keys = [f"k{i:04d}" for i in range(len(x))]
    unit = x.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    assert close(spark, keys, x, k=4) == brute(keys, unit, 4, 0.95)


def test_buckets_over_batches():
    """Runs of buckets that batches cut anywhere give the pairs that they give whole."""
    rng = np.random.default_rng(1)
    value = np.sort(rng.integers(0, 12, 80))
    ids, sketch = rng.permutation(80), rng.integers(0, 4, 80)
    columns = [np.zeros(80, np.int32), value, ids, sketch, 7 - sketch]
    sizes = np.bincount(value)
    for cuts in ([], [1, 2, 3], [10, 40], list(range(1, 80))):
        batches = [pa.RecordBatch.from_arrays([pa.array(c[a:b]) for c in columns], names=["part", "value", "id", "s0", "s1"]) for a, b in zip([0, *cuts], [*cuts, 80])]
        out = pa.Table.from_batches(neighbours._met(2, 8)(iter(batches))).to_pylist()
        wanted = {(min(ids[i], ids[j]), max(ids[i], ids[j])) for i in range(80) for j in range(i) if value[i] == value[j] and sizes[value[i]] <= 8 and bin(sketch[i] ^ sketch[j]).count("1") <= 1}
        assert {(r["a"], r["b"]) for r in out if r["b"] is not None} == wanted and len(wanted) > 20
        assert sorted(r["a"] for r in out if r["b"] is None) == sorted(ids[sizes[value] > 8])


@pytest.mark.parametrize("width", [12, 20, 24, 30])
def test_recall_at_the_threshold_for_any_width(width):
    """Pairs at a cosine of just 0.95 share a bucket however long the substrings are."""
    rng = np.random.default_rng(2)
    base = rng.standard_normal((4000, 64)) * np.linspace(0.3, 2, 64)
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    off = rng.standard_normal(base.shape)
    off -= (off * base).sum(1, keepdims=True) * base
    near = 0.95 * base + math.sqrt(1 - 0.95**2) * off / np.linalg.norm(off, axis=1, keepdims=True)
    count = neighbours.substrings_for(math.acos(0.95) / math.pi, width, neighbours.PAIR_RECALL)
    mean, matrix = neighbours.learn_rotations(base[:2000], count * width)
    a, b = (neighbours._parts(x, mean, matrix, count, width)[:, :count] for x in (base, near))
    assert (a == b).any(axis=1).mean() > 0.99


def test_top_k_recall(spark):
    keys, x = data(1500)
    vectors = neighbours.usable(frame(spark, keys, x), "ui", "vector").cache()
    for members in (64, 512):
        asked = vectors.filter("key like '%0'")
        true = {(r.key, r.other) for r in neighbours.exact_top_k(asked, vectors).collect()}
        got = neighbours.top_k(asked, vectors, members=members).collect()
        assert len({(r.key, r.other) for r in got} & true) >= 0.9 * len(true) and len(got) <= len(true) and all(r.key != r.other for r in got)
    every = neighbours.top_k(vectors, vectors).count()
    assert every == 15_000
    one = vectors.limit(1)
    assert neighbours.top_k(one, one).count() == neighbours.top_k(one, vectors.limit(0)).count() == 0


def test_copies(spark):
    x = np.vstack([np.tile(np.arange(1.0, 65.0), (30, 1)), np.eye(64)[:5]])
    keys = [f"k{i:04d}" for i in range(len(x))]
    got = close(spark, keys, x, k=3)
    assert got == {(keys[i], keys[j]) for i in range(4) for j in range(i + 1, 4)}


def test_unusable(spark):
    rows = [("a", [1.0, 0.0]), ("a", [1.0, 0.0]), ("b", None), ("c", [0.0, 0.0]), ("d", [float("nan"), 1.0]), ("e", [1.0]), (None, [1.0, 1.0]), ("f", [float("inf"), 1.0]), ("g", [None, 1.0])]
    df = spark.createDataFrame(rows, "ui string, vector array<float>")
    got = neighbours.usable(df, "ui", "vector", 2)
    assert [r["key"] for r in got.collect()] == ["a"]
    assert neighbours.close_pairs(got).count() == 0
    assert neighbours.close_pairs(got.limit(0)).count() == 0
    assert neighbours.exact_top_k(got.limit(0), got, 3).count() == 0


def test_exact_top_k(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 50)
    keys, x = data(130)
    vectors = neighbours.usable(frame(spark, keys, x), "ui", "vector")
    got = neighbours.exact_top_k(vectors.filter("key in ('k0000', 'k0007')"), vectors, 5).orderBy("key", "nth").collect()
    unit = x.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, -2)
    assert [r.other for r in got] == [keys[j] for i in (0, 7) for j in np.argsort(-s[i])[:5]]
