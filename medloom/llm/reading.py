"""Reading level of documents by propagation over the document-word graph.

A document is linked to the words and pairs of neighbouring words it contains. Graded documents are clamped to their
grade; harmonic iterations give every word the mean of its documents and every other document the mean of its words, until
no word changes by TOLERANCE. Every word is also tied, with weight TIE, to a fixed node with what the graded documents
alone say of it: words are linked to so many documents that without such ties the solution comes close to one value for
all, and with them each iteration brings it closer by a fixed factor.
Words and pairs are hashed to a fixed number of buckets each, so the state that travels between iterations (one number for
each bucket) has the same size at any scale and may be broadcast; documents never leave the executors.

Grades are cut from the continuous difficulty at thresholds learned from graded documents that were not clamped: two
further copies of the iteration run alongside, each blind to one half of the graded documents.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medloom.runtime import cut

#: Buckets of words, and those of pairs, which come after them; there are many times more pairs than words.
BUCKETS, PAIRS = 1 << 16, 1 << 20
#: Share of a word's value that its tie has, and the change of any word, in grades, at which the iterations end.
TIE, TOLERANCE = 0.5, 0.01
#: Words of weight that the mean of all grades has in every bucket.
PRIOR = 0.1
#: Resolution at which scores of graded documents are counted to find the thresholds.
GRID = 500
LEVELS = 5
_WORD = regex.compile(r"\p{L}+|\p{N}+|[^\p{L}\p{N}\s]")
_MEMO, _MEMO_CHARS = 150_000, 64
_known: dict[str, tuple[int, ...]] = {}


def _hashes(chunk: str) -> tuple[int, ...]:
    """Hash of every word, number (all alike) and sign of a stretch without white space."""
    found = tuple(zlib.crc32(b"0" if w[0].isnumeric() else w.lower().encode("utf-8", "replace")) for w in _WORD.findall(chunk))
    if len(chunk) <= _MEMO_CHARS:
        if len(_known) >= _MEMO:
            _known.clear()
        _known[chunk] = found
    return found


def _buckets(texts: list[str | None], buckets: int, pair_buckets: int = PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of each text, one after the other, and where each text's end; those of pairs start at ``buckets``."""
    words, lengths = [], []
    for text in texts:
        one = list(chain.from_iterable(_known.get(c) or _hashes(c) for c in text.split())) if text else []
        words += one
        lengths.append(len(one))
    h = np.array(words, np.uint64)
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), lengths)
    within, size = doc[:-1] == doc[1:], buckets + pair_buckets
    pairs = ((h[:-1] * np.uint64(0x9E3779B1) ^ h[1:] * np.uint64(0x85EBCA77)) >> np.uint64(7))[within]
    both = np.concatenate([doc * size + (h % np.uint64(buckets)).astype(np.int64), doc[1:][within] * size + buckets + (pairs % np.uint64(pair_buckets)).astype(np.int64)])
    both.sort()  # several times faster here than np.unique, which hashes before it sorts
    both = both[np.concatenate([np.ones(min(1, len(both)), bool), both[1:] != both[:-1]])]
    return both % size, np.searchsorted(both // size, np.arange(len(texts) + 1))


def _features(docs: DataFrame, key: str, text: str, buckets: int, pair_buckets: int) -> DataFrame:
    columns = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))

    def run(batches):
        for batch in batches:
            ids, ends = _buckets(batch.column(1).to_pylist(), buckets, pair_buckets)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["key", "words"])

    return columns.mapInArrow(run, f"key {columns.dtypes[0][1]}, words array<int>")


def _sides(half: np.ndarray) -> np.ndarray:
    """For each graded document, in which of the three copies it is clamped: all, those of half 0, those of half 1."""
    return np.stack([np.ones(len(half), bool), half == 0, half == 1], axis=1)


def _difficulty(words: np.ndarray, ends: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Mean of its words' state for each document and copy; every document has words."""
    sums = [np.add.reduceat(one[words], ends[:-1], dtype=np.float64) for one in state]
    return np.stack(sums, axis=1) / np.diff(ends)[:, None]


def _arrays(batch):
    lists = batch.column(1)
    ends = lists.offsets.to_numpy().astype(np.int64)
    words = lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]] if len(ends) else np.empty(0, np.int32)
    grade = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
    half = batch.column(3).to_numpy(zero_copy_only=False)
    return words, ends - (ends[0] if len(ends) else 0), grade, half


def _start(size: int):
    """Documents of each bucket and, for each copy, sum and number of the grades clamped there, by task."""

    def run(batches):
        n, x, w = np.zeros(size), np.zeros((size, 3)), np.zeros((size, 3))
        for batch in batches:
            words, ends, grades, halves = _arrays(batch)
            n += np.bincount(words, minlength=size)
            lengths = np.diff(ends)
            for i, clamp in enumerate((_sides(halves) & ~np.isnan(grades)[:, None]).T):
                seen = words[np.repeat(clamp, lengths)]
                x[:, i] += np.bincount(seen, np.repeat(grades[clamp], lengths[clamp]), size)
                w[:, i] += np.bincount(seen, minlength=size)
        has = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(has, pa.int32()), *[pa.array(c[has]) for c in (n, *x.T, *w.T)]], names=["bucket", "n", *[f"{k}{i}" for k in "xw" for i in range(3)]])

    return run


#: Buckets whose sums leave a task as one row.
SUMS = 1 << 13


def _numbers(present: np.ndarray, size: int) -> np.ndarray:
    """The number of each bucket that occurs."""
    index = np.full(size, -1, np.int32)
    index[present] = np.arange(len(present), dtype=np.int32)
    return index


def _gather(present, held, size: int):
    """Sums of their documents' values for the buckets that occur and each copy, by task, in blocks of SUMS buckets."""

    def run(batches):
        index, state = _numbers(present.value, size), held.value
        n = state.shape[1]
        x = np.zeros((n, 3))
        for batch in batches:
            words, ends, grades, halves = _arrays(batch)
            if not len(words):
                continue
            words = index[words]
            clamp = _sides(halves) & ~np.isnan(grades)[:, None]
            value = np.where(clamp, grades[:, None], _difficulty(words, ends, state))
            lengths = np.diff(ends)
            for i in range(3):
                x[:, i] += np.bincount(words, np.repeat(value[:, i], lengths), n)
        x = x.astype(np.float32)
        blocks = range(0, n, SUMS)
        yield pa.RecordBatch.from_arrays([pa.array([at // SUMS for at in blocks], pa.int32()), pa.array([x[at : at + SUMS].tobytes() for at in blocks], pa.binary())], names=["block", "sums"])

    return run


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(b, np.float32).astype(np.float64) for b in pdf["sums"])
    return pd.DataFrame({"block": pdf["block"][:1], "sums": [total.astype(np.float32).tobytes()]})


def reading_difficulty(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", grade: str = "reading_level", tie: float = TIE, tolerance: float = TOLERANCE, buckets: int = BUCKETS, pair_buckets: int = PAIRS) -> DataFrame:
    """(key, difficulty, held_out, grade) of every document with at least one word or sign.

    difficulty is on the scale of the grades, shrunk toward their mean; held_out is the same from the copy that didn't
    see this document's grade (graded documents only). ``tie`` lies above 0 and up to 1, where 1 leaves words with what the
    graded documents say. Null, empty and blank texts have no row. Several grades of a document are averaged; grades of
    unknown documents and null grades are ignored. Without any grade every difficulty is null.
    """
    if not 0 < tie <= 1:
        raise ValueError("tie must lie above 0 and up to 1")
    spark = docs.sparkSession
    graded = labels.groupBy(F.col(f"`{key}`").alias("key")).agg(F.avg(f"`{grade}`").alias("grade")).filter("grade is not null")
    half = F.pmod(F.xxhash64("key"), F.lit(2)).cast("int")
    graph = cut(_features(docs.filter(F.length(F.trim(f"`{text}`")) > 0), key, text, buckets, pair_buckets).filter(F.size("words") > 0).join(graded, "key", "left").withColumn("half", half))
    mean = graph.agg(F.avg("grade")).first()[0]
    kind = graph.dtypes[0][1]
    if mean is None:
        return graph.select(F.col("key").alias(key), *[F.lit(None).cast("double").alias(c) for c in ("difficulty", "held_out", "grade")])
    size = buckets + pair_buckets
    rows = graph.select("key", "words", "grade", "half")
    first = rows.mapInArrow(_start(size), "bucket int, n double, " + ", ".join(f"{k}{i} double" for k in "xw" for i in range(3)))
    columns = ["n", *[f"{k}{i}" for k in "xw" for i in range(3)]]
    totals = first.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in columns]).toPandas().sort_values("bucket")  # one row for each bucket
    # buckets that occur are numbered; all that travels between iterations is three numbers for each
    present = spark.sparkContext.broadcast(totals["bucket"].to_numpy(np.int32))
    n = totals["n"].to_numpy()[:, None]
    x, w = (totals[[f"{k}{i}" for i in range(3)]].to_numpy() for k in "xw")
    state = tied = (x + PRIOR * mean) / (w + PRIOR)
    change = np.inf
    while True:
        held = spark.sparkContext.broadcast(np.ascontiguousarray(state.T, np.float32))
        parts = rows.mapInArrow(_gather(present, held, size), "block int, sums binary").groupBy("block").applyInPandas(_add, "block int, sums binary")
        found = parts.toPandas().sort_values("block")
        x = np.concatenate([np.frombuffer(b, np.float32) for b in found["sums"]]).reshape(-1, 3).astype(np.float64)
        held.destroy()
        # a document's mean over words that are tied is the mean it has with ties of its own
        new = (1 - tie) * (x + PRIOR * mean) / (n + PRIOR) + tie * tied
        last, change = change, np.abs(new - state).max()
        state = new
        # each iteration shrinks the change by 1 - tie at least; where it doesn't, the numbers' own precision is reached
        if change <= tolerance or change >= last:
            break
    final = spark.sparkContext.broadcast(np.ascontiguousarray(state.T))

    def score(batches):
        index, state = _numbers(present.value, size), final.value
        for batch in batches:
            words, ends, grades, halves = _arrays(batch)
            if batch.num_rows:
                found = _difficulty(index[words], ends, state)
                blind = np.where(np.isnan(grades), np.nan, np.where(halves == 0, found[:, 2], found[:, 1]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found[:, 0]), pa.array(blind, mask=np.isnan(grades)), batch.column(2)], names=[key, "difficulty", "held_out", "grade"])

    return rows.mapInArrow(score, f"`{key}` {kind}, difficulty double, held_out double, grade double")


def thresholds(scored: DataFrame, levels: int = LEVELS) -> list[float]:
    """For each grade from 2 on, the difficulty from which a document has it: the cut with the best F1 over the held-out
    scores, never below the cut of the grade before. Only counts on a grid reach the driver."""
    grid = F.round(F.col("held_out") * GRID).cast("int")
    rows = scored.filter("held_out is not null").groupBy(grid.alias("at"), F.floor(F.col("grade") + 0.5).cast("int").alias("grade")).count().collect()
    cuts: list[float] = []
    for level in range(2, levels + 1):
        by_place: dict[int, list[int]] = {}
        for r in rows:
            by_place.setdefault(r["at"], [0, 0])[int(r["grade"] >= level)] += r["count"]
        positives = sum(p for _, p in by_place.values())
        best, cut_at, hits, taken = -1.0, float("inf"), 0, 0
        for at in sorted(by_place, reverse=True):
            taken += sum(by_place[at])
            hits += by_place[at][1]
            f1 = 2 * hits / (taken + positives) if positives else 0.0
            if positives and f1 > best:
                best, cut_at = f1, (at - 0.5) / GRID
        cuts.append(max(cut_at, cuts[-1]) if cuts else cut_at)
    return cuts


def reading_levels(docs: DataFrame, labels: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """(key, difficulty, held_out, grade, level): reading_difficulty with the grade 1..5 that the thresholds give."""
    scored = cut(reading_difficulty(docs, labels, key, **options))
    level = F.lit(1)
    for at in thresholds(scored):
        if at != float("inf"):
            level = level + (F.col("difficulty") >= at).cast("int")
    return scored.withColumn("level", F.when(F.col("difficulty").isNotNull(), level))
