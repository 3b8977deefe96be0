import random

import numpy as np
import pytest

from medloom.llm import reading


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    plain, hard = "rest eat walk water hand nice day home warm soup".split(), "osteectasia thromboprophylaxis haemostasis refractory perfusion adjunctive concomitant synchronous".split()
    rows, labels = [], []
    for i in range(n):
        level = i % 5 + 1
        words = [rng.choice(hard if rng.random() < (level - 1) / 4 else plain) for _ in range(60)]
        rows.append((i, " ".join(words), "x"))
        if i % 2:
            labels.append((i, level))
    return rows, labels


def test_held_out_grades(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string")
    got = {r.doc_id: r for r in reading.reading_levels(docs, spark.createDataFrame(labels, "doc_id long, reading_level int")).collect()}
    unseen = [i for i, *_ in rows if i % 2 == 0]
    hits = sum((got[i].level >= 4) == (i % 5 + 1 >= 4) for i in unseen)
    assert hits >= 0.85 * len(unseen)
    order = [sum(got[i].difficulty for i in unseen if i % 5 == k) for k in range(5)]
    assert order == sorted(order)
    assert all((r.held_out is None) == (r.grade is None) for r in got.values())


def test_odd_rows(spark):
    rows, labels = corpus(60)
    rows += [(100, None, "x"), (101, "", "x"), (102, " \n ", "x"), (103, "soup " * 30_000, "x"), (104, "漢字 … 12", "x"), (105, rows[0][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, grade string")
    marks = spark.createDataFrame([*labels, (1, None), (999, 3), (1, 2), (None, 4)], "doc_id long, reading_level int")
    got = {r.doc_id: r for r in reading.reading_levels(docs, marks).collect()}
    assert not {100, 101, 102} & set(got) and {103, 104, 105} <= set(got)
    assert got[1].grade == 2.0 and abs(got[105].difficulty - got[0].difficulty) < 1e-9
    assert reading.reading_levels(docs.limit(0), marks).count() == 0
    assert all(r.level is None for r in reading.reading_levels(docs, marks.limit(0)).collect())


def test_same_words_same_buckets():
    ids, ends = reading._buckets(["A b 12", "a  B 7", None, ""], 1 << 16)
    assert list(ids[: ends[1]]) == list(ids[ends[1] : ends[2]]) and ends[2] == ends[3] == ends[4]


def test_pairs_have_buckets_of_their_own():
    some = ["rest eat walk", "eat rest", "water"]
    ids, ends = reading._buckets(some, reading.BUCKETS)
    alone, _ = reading._buckets([x for t in some for x in t.split()], reading.BUCKETS)
    assert set(ids[ids < reading.BUCKETS]) == set(alone) and (ids >= reading.BUCKETS).sum() == 3 and ids.max() < reading.BUCKETS + reading.PAIRS
    # distinct pairs that share a bucket are few
    letters = [f"{a}{b}" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst"]
    text = " ".join(f"{x} {y}" for i, x in enumerate(letters) for y in letters[i : i + 100])
    met = text.split()
    distinct = len(set(zip(met, met[1:])))
    ids, _ = reading._buckets([text], reading.BUCKETS)
    assert distinct > 30_000 and (ids >= reading.BUCKETS).sum() >= 0.95 * distinct


def test_harmonic_solution(spark):
    """Against a linear system: documents are means of their words, words of their documents and their tie."""
    rows, labels = corpus(60)
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string")
    got = {r.doc_id: r.difficulty for r in reading.reading_difficulty(docs, spark.createDataFrame(labels, "doc_id long, reading_level int"), tolerance=1e-7).collect()}
    ids, ends = reading._buckets([t for _, t, _ in rows], reading.BUCKETS)
    words, at = np.unique(ids, return_inverse=True)
    has = np.zeros((len(rows), len(words)))
    has[np.repeat(np.arange(len(rows)), np.diff(ends)), at] = 1
    grade = np.array([dict(labels).get(i, np.nan) for i, *_ in rows], float)
    seen, mean = ~np.isnan(grade), np.nanmean(grade)
    tied = (has[seen].T @ grade[seen] + reading.PRIOR * mean) / (has[seen].sum(0) + reading.PRIOR)
    means = has / has.sum(1, keepdims=True)
    shares = has.T / (has.sum(0) + reading.PRIOR)[:, None]
    fixed = shares[:, seen] @ grade[seen] + reading.PRIOR * mean / (has.sum(0) + reading.PRIOR)
    state = np.linalg.solve(np.eye(len(words)) - (1 - reading.TIE) * shares[:, ~seen] @ means[~seen], (1 - reading.TIE) * fixed + reading.TIE * tied)
    assert np.allclose([got[i] for i, *_ in rows], means @ state, atol=1e-5)
    with pytest.raises(ValueError):
        reading.reading_difficulty(docs, docs, tie=0.0)
