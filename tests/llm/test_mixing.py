import random

from hypothesis import given, settings
from hypothesis import strategies as st

from medloom.llm import mixing


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 6), min_size=1, max_size=8), st.floats(0, 1))
def test_budget_is_met_or_nothing_fits(counts, share):
    total = sum(length * n for length, n in counts.items())
    budget = int(total * share)
    take = mixing.fit_budget(budget, counts)
    assert all(0 <= n <= counts[length] for length, n in take.items())
    assert sum(length * n for length, n in take.items()) <= budget


def test_budget_is_exact_with_fine_lengths():
    counts = {1: 50, 7: 40, 113: 20, 1000: 9}
    for budget in (1, 57, 999, 5000, 11_000):
        assert sum(length * n for length, n in mixing.fit_budget(budget, counts).items()) == budget


def test_plans_respect_caps():
    plans = mixing.plan_mixture({"a": {10: 100}, "b": {5: 4}, "c": {3: 3}}, {"a": (0.5, 1), "b": (0.5, 3), "d": (0.3, 2)})
    by = {p.source: p for p in plans}
    assert set(by) == {"a", "b"} and by["b"].planned == 60 and by["a"].planned == 60
    assert mixing.plan_mixture({}, {"a": (1.0, 1)}) == []


def test_mixture(spark):
    rng = random.Random(2)
    rows = [(i, "big", rng.randint(1, 40)) for i in range(600)] + [(1000 + i, "small", rng.randint(1, 40)) for i in range(40)] + [(2000, None, 5), (2001, "other", 9), (2002, "big", 0)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, n_tokens long, slot int")
    weights = spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 3), ("gone", 0.2, 2), ("null", None, None)], "source string, target_share double, max_repeats int")
    mixed, plans = mixing.mix(docs, weights)
    got = mixed.collect()
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.n_tokens * r.copies
    assert {p.source: p.planned for p in plans} == sizes
    total = sum(sizes.values())
    assert abs(sizes["big"] / total - 0.6) < 0.002 and max(r.copies for r in got) <= 3
    assert len({r.doc_id for r in got}) == len(got)
    assert {r.doc_id for r in mixing.mix(docs, weights)[0].collect()} == {r.doc_id for r in got}
    assert mixing.mix(docs.limit(0), weights)[0].count() == 0


def test_source_names(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(" Lab-Reports ",), ("LAB_REPORTS",), ("lab reports",), (" ",), (None,)], "s string")
    assert [r[0] for r in df.select(mixing.source_name(F.col("s"))).collect()] == ["lab_reports"] * 3 + [None, None]
