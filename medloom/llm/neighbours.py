"""Most similar vectors by multi-index hashing over learned rotated binary codes.

Rotations are learned from a bounded sample (iterative quantisation: alternate between the signs of the rotated sample
and the rotation that fits them best). A code is divided into m substrings and each of them is indexed; every row of every
table is. By the pigeonhole principle two codes within Hamming distance m - 1 agree in a substring, so whoever shares a
bucket with a code are all codes within that radius, and by chance some beyond it. How many substrings there are, and so
the radius, follows from their length and the recall that is asked for; no size of input changes the way.

``close_pairs`` finds pairs above a high cosine: substrings as long as log2 of the number of vectors, so that a bucket
holds about one vector by chance at any scale. ``top_k`` finds the nearest of each query however far they are: substrings
so short that a bucket holds some hundreds, and as many as a bounded sample of queries says.

Equal vectors are one class: of each class only its k + 1 first members can be among anyone's k nearest (ties go by name),
so a vector that a third of all rows repeat costs nothing. Buckets of distinct vectors that are crowded all the same are
searched block against block, exactly, and only each block's best leave it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medloom.functions.values import let
from medloom.operators.vectors import best_of_rows
from medloom.runtime import cut

#: Vectors the rotations are learned from, and rounds of it.
SAMPLE, ROUNDS = 5_000, 20
#: Share of the pairs at the least cosine that share a bucket, and of the k nearest of a query that do.
PAIR_RECALL, TOP_RECALL = 0.9995, 0.96
#: Queries by which the substrings of top_k are chosen, and members that a bucket of it has.
ASKED, MEMBERS = 200, 512
#: Members from which a bucket is searched in blocks, and members of a block.
CROWDED, BLOCK = 1000, 4096
#: Share of the sample in one bucket from which its rows go to the block search without meeting in one task before.
HOT = 0.02
#: Bits of the sketch by which pairs of a bucket are compared before their vectors are fetched.
SKETCH = 256


def usable(df: DataFrame, key: str, vector: str, dims: int = 64) -> DataFrame:
    """(key, unit array<double>) once for each key: vectors of ``dims`` finite values, not all zero, scaled to length 1.

    Of several usable vectors of a key the smallest in array order holds; null keys and other vectors are dropped.
    """
    v = F.col(f"`{vector}`")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.filter(F.col(f"`{key}`").isNotNull() & (F.size(v) == dims)).filter(finite & F.exists(v, lambda x: x != 0))
    one = rows.groupBy(F.col(f"`{key}`").alias("key")).agg(F.min(v).alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return one.select("key", let(length, lambda n: F.transform("v", lambda x: x.cast("double") / n)).alias("unit"))


def learn_rotations(sample: np.ndarray, bits: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(mean, matrix of ``bits`` columns): as many rotations of the sample's space as are needed, side by side."""
    mean = sample.mean(axis=0)
    x = sample - mean
    dims = x.shape[1]
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(-(-bits // dims)):
        rotation = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
        for _ in range(ROUNDS):
            u, _, vt = np.linalg.svd(np.sign(x @ rotation).T @ x)
            rotation = (u @ vt).T
        out.append(rotation)
    return mean, np.hstack(out)[:, :bits]


def substrings_for(differ, width: int, recall: float) -> int:
    """The fewest substrings of ``width`` bits of which pairs share one with probability ``recall``, on average over pairs
    whose bits differ with the given probabilities."""
    agree = (1.0 - np.atleast_1d(np.asarray(differ, float))) ** width
    reached = lambda m: float(np.mean(1.0 - (1.0 - agree) ** m)) >= recall
    high = 1
    while not reached(high) and high < 1 << 40:
        high *= 2
    low = high // 2
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if reached(middle) else (middle, high)
    return high


def _sampled(vectors: DataFrame, n: int, seed: int) -> np.ndarray:
    """The units of ``n`` vectors, chosen by hash; bounded by ``n``."""
    rows = vectors.select("unit").orderBy(F.xxhash64("key", F.lit(seed))).limit(n).toPandas()
    return np.stack(rows["unit"].to_numpy())


def _parts(units: np.ndarray, mean: np.ndarray, matrix: np.ndarray, count: int, width: int) -> np.ndarray:
    """The substrings of the codes as integers, and as last columns the sketch: the first bits of the code, 64 to a number."""
    bits = (units - mean) @ matrix > 0
    values = bits[:, : count * width].reshape(len(units), count, width).astype(np.int64) @ (1 << np.arange(width, dtype=np.int64))
    sketch = np.packbits(bits[:, :SKETCH], axis=1, bitorder="little").view(np.int64)
    return np.hstack([values, sketch])


def _coded(points: DataFrame, mean: np.ndarray, matrix: np.ndarray, count: int, width: int) -> DataFrame:
    """``points`` with parts: the substrings of each vector's code, and its sketch after them."""
    shared = points.sparkSession.sparkContext.broadcast((mean, matrix))

    @F.pandas_udf("array<bigint>")
    def parts(units: pd.Series) -> pd.Series:
        if not len(units):
            return pd.Series([], dtype=object)
        return pd.Series(list(_parts(np.stack(units.to_numpy()), *shared.value, count, width)))

    return points.withColumn("parts", parts("unit"))


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _met(limit: int, most: int):
    """Pairs (a, b) of the ids that share a bucket and whose sketches differ in at most ``limit`` bits, of rows (part, value,
    id, sketch ...) sorted by bucket. Members of a crowded bucket leave as (a, null, part, value) instead."""

    def run(batches):
        held: list[np.ndarray] | None = None
        crowded = None
        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows)]
            part, value, ids = rows[:3]
            if not len(ids):
                continue
            starts = np.concatenate([[0], np.flatnonzero((part[1:] != part[:-1]) | (value[1:] != value[:-1])) + 1])
            ends = np.append(starts[1:], len(ids))
            many = np.repeat(ends - starts > most, ends - starts)
            if crowded is not None:
                many |= (part == crowded[0]) & (value == crowded[1])
            # the last bucket may go on in the next batch
            last = np.arange(len(ids)) >= starts[-1]
            keep = last & ~many
            crowded = (part[-1], value[-1]) if many[-1] else None
            if many.any():
                yield _batch(ids[many], None, part[many], value[many])
            yield from _pairs_of(np.where(many | keep, -1, np.repeat(starts, ends - starts)), ids, np.stack(rows[3:], axis=1), limit, most)
            held = [c[keep] for c in rows]
        if held is not None and len(held[0]):
            yield from _pairs_of(np.zeros(len(held[0]), np.int64), held[2], np.stack(held[3:], axis=1), limit, most)

    return run


def _batch(a, b, part, value):
    n = len(a)
    columns = [pa.array(a), pa.nulls(n, pa.int64()) if b is None else pa.array(b), pa.nulls(n, pa.int32()) if part is None else pa.array(part, pa.int32()), pa.nulls(n, pa.int64()) if value is None else pa.array(value)]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b", "part", "value"])


def _pairs_of(bucket: np.ndarray, ids: np.ndarray, sketch: np.ndarray, limit: int, most: int):
    """Pairs within runs of equal ``bucket`` (-1: none) of at most ``most`` members, distance by distance along the run."""
    at = np.flatnonzero(bucket >= 0)
    bucket, ids, sketch = bucket[at], ids[at], sketch[at].view(np.uint64)
    live = np.arange(len(ids))
    for step in range(1, most + 1):
        live = live[live + step < len(ids)]
        live = live[bucket[live] == bucket[live + step]]
        if not len(live):
            return
        near = live[np.bitwise_count(sketch[live] ^ sketch[live + step]).sum(axis=1, dtype=np.int32) <= limit]
        if len(near):
            x, y = ids[near], ids[near + step]
            yield _batch(np.minimum(x, y), np.maximum(x, y), None, None)


def _best_of_blocks(crowded: DataFrame, unit: DataFrame, k: int, least: float) -> DataFrame:
    """(a, b, cosine) of the best pairs of crowded buckets, rows (part, value, id): blocks of a bucket's members meet blocks."""
    sizes = crowded.groupBy("part", "value").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n"))
    rows = crowded.join(sizes, ["part", "value"]).join(unit, "id").withColumn("own", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    # block x meets y only once, as (lower, higher)
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda o: F.struct(F.least(F.col("own"), o).alias("i"), F.greatest(F.col("own"), o).alias("j"))))
    spread = rows.select("part", "value", "own", pair.alias("p"), "id", "unit").select("part", "value", "p.i", "p.j", "own", "id", "unit")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        sides = [pdf[pdf["own"] == o] for o in (i, j)]
        if not all(map(len, sides)):
            return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64), "cosine": np.empty(0)})
        (a, x), (b, y) = ((s["id"].to_numpy(), np.stack(s["unit"].to_numpy())) for s in sides)
        cosine = x @ y.T
        cosine[a[:, None] == b[None]] = -2
        # a pair is best for either side: the k best of each row and of each column
        keep = np.zeros(cosine.shape, bool)
        keep[best_of_rows(cosine, k)] = True
        keep.T[best_of_rows(cosine.T, k)] = True
        # ties of the last place stay, whatever their names
        keep |= cosine >= np.partition(cosine, max(0, cosine.shape[1] - k), axis=1)[:, [max(0, cosine.shape[1] - k)]]
        keep |= cosine >= np.partition(cosine, max(0, cosine.shape[0] - k), axis=0)[[max(0, cosine.shape[0] - k)]]
        p, q = np.nonzero(keep & (cosine >= least))
        return pd.DataFrame({"a": np.minimum(a[p], b[q]), "b": np.maximum(a[p], b[q]), "cosine": cosine[p, q]})

    return spread.groupBy("part", "value", "i", "j").applyInPandas(search, "a bigint, b bigint, cosine double")


def close_pairs(vectors: DataFrame, k: int = 10, least: float = 0.95, seed: int = 5, width: int | None = None, recall: float = PAIR_RECALL) -> DataFrame:
    """(key_a, key_b, cosine), key_a < key_b: pairs of keys of at least the cosine ``least`` of which each is among the
    other's k most similar. Ties go by key. In: (key, unit) as of usable; nothing in, nothing out.

    ``width`` is the length of a substring (default: log2 of the number of vectors), ``recall`` the share of pairs at the
    least cosine that share a bucket; pairs above it do more often.
    """
    # a window limit is applied before the shuffle, so a vector with very many copies leaves each task k + 1 times
    copies = Window.partitionBy("unit").orderBy("key")
    points = cut(vectors.withColumn("nth", F.row_number().over(copies)).filter(F.col("nth") <= k + 1).select("key", "unit", F.monotonically_increasing_id().alias("id")))
    n = points.count()
    if n < 2:
        return points.select(F.col("key").alias("key_a"), F.col("key").alias("key_b"), F.lit(0.0).alias("cosine")).filter(F.lit(False))
    width = width or max(8, math.ceil(math.log2(n)))
    differ = math.acos(least) / math.pi
    count = substrings_for(differ, width, recall)
    sample = _sampled(points, SAMPLE, seed)
    mean, matrix = learn_rotations(sample, max(SKETCH, count * width), seed)
    # four standard deviations beyond what the sketches of a pair at the least cosine differ by
    limit = math.ceil(SKETCH * differ + 4 * math.sqrt(SKETCH * differ * (1 - differ)))
    hot = _hot(_parts(sample, mean, matrix, count, width)[:, :count])
    coded = cut(_coded(points, mean, matrix, count, width))
    sketch = [f"s{i}" for i in range(SKETCH // 64)]
    rows = coded.select("id", *[F.col("parts")[count + i].alias(c) for i, c in enumerate(sketch)], F.posexplode(F.slice("parts", 1, count)).alias("part", "value"))
    crowded = None
    if hot:
        known = coded.sparkSession.createDataFrame(hot, "part int, value bigint")  # at most 1 / HOT for each substring
        crowded = rows.join(F.broadcast(known), ["part", "value"]).select("part", "value", "id")
        rows = rows.join(F.broadcast(known), ["part", "value"], "left_anti")
    placed = rows.select("part", "value", "id", *sketch).repartition("part", "value").sortWithinPartitions("part", "value")
    met = cut(placed.mapInArrow(_met(limit, CROWDED), "a bigint, b bigint, part int, value bigint").distinct())
    full = met.filter("b is null").select("part", "value", F.col("a").alias("id"))
    crowded = full if crowded is None else crowded.unionByName(full)
    unit = coded.select("id", "unit")
    pairs = met.filter("b is not null").select("a", "b")
    ranked = pairs.join(unit.withColumnsRenamed({"id": "a", "unit": "unit_a"}), "a").join(unit.withColumnsRenamed({"id": "b", "unit": "unit_b"}), "b")
    scored = ranked.select("a", "b", _dot("unit_a", "unit_b").alias("cosine")).filter(F.col("cosine") >= least)
    if hot or full.limit(1).count():
        scored = scored.unionByName(_best_of_blocks(crowded, unit, k, least)).groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    names = coded.select("id", "key")
    named = cut(scored.join(names.withColumnsRenamed({"id": "a", "key": "key_1"}), "a").join(names.withColumnsRenamed({"id": "b", "key": "key_2"}), "b").select(F.least("key_1", "key_2").alias("key_a"), F.greatest("key_1", "key_2").alias("key_b"), "cosine"))
    both = named.select(F.col("key_a").alias("me"), F.col("key_b").alias("other"), "cosine").unionByName(named.select(F.col("key_b").alias("me"), F.col("key_a").alias("other"), "cosine"))
    order = Window.partitionBy("me").orderBy(F.desc(F.round("cosine", 9)), "other")
    near = both.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k)
    mutual = near.groupBy(F.least("me", "other").alias("key_a"), F.greatest("me", "other").alias("key_b")).agg(F.count(F.lit(1)).alias("sides"), F.first("cosine").alias("cosine"))
    return mutual.filter("sides = 2").drop("sides")


def _hot(parts: np.ndarray) -> list[tuple[int, int]]:
    """(part, value) of the buckets that hold a share of HOT or more, and enough to be crowded, of a sample's codes."""
    out = []
    for j in range(parts.shape[1] if len(parts) >= SAMPLE else 0):
        values, n = np.unique(parts[:, j], return_counts=True)
        out += [(j, int(v)) for v in values[n >= HOT * len(parts)]]
    return out


def _near_queries(k: int, dims: int):
    """(query, other) of each query's k nearest by small integers within its buckets, of rows (part, value, asks, id, small)
    sorted by bucket, queries first."""

    def run(batches):
        bucket, asking, best = None, None, None
        out: list[np.ndarray] = []

        def done():
            if best is not None:
                out.append(best[best[:, 1] >= 0][:, :2])

        for batch in batches:
            part, value, asks, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            if not len(ids):
                continue
            small = np.stack([np.frombuffer(x, np.int8) for x in batch.column(4).to_pylist()]).astype(np.float32)
            starts = np.concatenate([[0], np.flatnonzero((part[1:] != part[:-1]) | (value[1:] != value[:-1])) + 1])
            for a, b in zip(starts, np.append(starts[1:], len(ids))):
                if bucket != (part[a], value[a]):
                    done()
                    bucket, asking, best = (part[a], value[a]), None, None
                queries = a + np.flatnonzero(asks[a:b])
                if len(queries):
                    # queries stand before all other members, which may go on in the next batch
                    more = (ids[queries], small[queries])
                    asking = more if asking is None else tuple(np.concatenate(x) for x in zip(asking, more))
                if asking is None:
                    continue
                if best is not None and len(queries):
                    # more queries than a batch holds: those of the batch before meet these, and these meet those
                    best = np.concatenate([best, _best(asking[0][len(asking[0]) - len(queries) :], asking[1][len(asking[0]) - len(queries) :], asking[0], asking[1], k)])
                found = _best(*asking, ids[a:b], small[a:b], k)
                best = found if best is None else np.concatenate([best, found])
                if len(best) > 4 * k * len(asking[0]):
                    best = _fewer(best, k)
            if sum(map(len, out)) > 50_000:
                yield _two(out)
                out = []
        done()
        if out:
            yield _two(out)

    return run


def _two(found: list[np.ndarray]):
    rows = np.concatenate(found).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], names=["query", "other"])


def _best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, members: np.ndarray, k: int) -> np.ndarray:
    """Rows (query id, other id, score) of the k best members of each query, blocks of queries at a time."""
    out = [np.empty((0, 3))]
    for at in range(0, len(query_ids), BLOCK):
        score = queries[at : at + BLOCK] @ members.T
        score[query_ids[at : at + BLOCK, None] == ids[None]] = -np.inf
        rows, columns = best_of_rows(score, k)
        kept = np.stack([query_ids[at + rows], ids[columns], score[rows, columns]], axis=1)
        out.append(kept[np.isfinite(kept[:, 2])])
    return np.concatenate(out)


def _fewer(best: np.ndarray, k: int) -> np.ndarray:
    best = best[np.lexsort((-best[:, 2], best[:, 0]))]
    nth = np.arange(len(best)) - np.searchsorted(best[:, 0], best[:, 0])
    return best[nth < k]


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 10, seed: int = 5, recall: float = TOP_RECALL, members: int = MEMBERS) -> DataFrame:
    """(key, other, cosine, nth): about the k most similar keys of each query, by multi-index hashing; ties go by key.

    In: (key, unit) as of usable, the queries among the vectors. Every vector is in every table. The number of substrings
    is such that the nearest of ASKED sampled queries, found exactly, share a bucket with them with probability
    ``recall``; within a bucket a query's 2 k best by vectors in small integers go on, and floats rank what all tables found.
    Queries without another vector have no rows.
    """
    points = cut(vectors.select("key", "unit", F.monotonically_increasing_id().alias("id")))
    n = points.count()
    sample = _sampled(points, SAMPLE, seed) if n else np.zeros((1, 1))
    width = max(3, math.ceil(math.log2(max(n, 1) / members)))
    some = cut(queries.select("key", "unit").orderBy(F.xxhash64("key", F.lit(seed + 1))).limit(ASKED))
    known = exact_top_k(some, points.select("key", "unit"), k).join(some.withColumnRenamed("unit", "u"), "key").join(points.select(F.col("key").alias("other"), F.col("unit").alias("v")), "other")
    pairs = known.select("u", "v").toPandas()  # at most ASKED times k
    if pairs.empty:
        return exact_top_k(queries, points.select("key", "unit"), k)
    mean, matrix = learn_rotations(sample, 8 * sample.shape[1], seed)
    u, v = ((np.stack(pairs[c].to_numpy()) - mean) @ matrix > 0 for c in ("u", "v"))
    count = substrings_for((u != v).mean(axis=1), width, recall)
    mean, matrix = learn_rotations(sample, max(SKETCH, count * width), seed)
    dims = sample.shape[1]

    @F.pandas_udf("binary")
    def small(units: pd.Series) -> pd.Series:
        return pd.Series([np.round(np.asarray(x) * 127).astype(np.int8).tobytes() for x in units], dtype=object)

    asked = queries.select("key").distinct().withColumn("asks", F.lit(True))
    coded = cut(_coded(points, mean, matrix, count, width).withColumn("small", small("unit")).join(asked, "key", "left").withColumn("asks", F.coalesce("asks", F.lit(False))))
    rows = coded.select("asks", "id", "small", F.posexplode(F.slice("parts", 1, count)).alias("part", "value")).select("part", "value", "asks", "id", "small")
    placed = rows.repartition("part", "value").sortWithinPartitions("part", "value", F.desc("asks"))
    found = placed.mapInArrow(_near_queries(2 * k, dims), "query bigint, other bigint").distinct()
    unit = coded.select("id", "key", "unit")
    scored = found.join(unit.select(F.col("id").alias("query"), "key", F.col("unit").alias("u")), "query").join(unit.select(F.col("id").alias("other"), F.col("key").alias("other_key"), F.col("unit").alias("v")), "other")
    scored = scored.select("key", F.col("other_key").alias("other"), F.round(_dot("u", "v"), 9).alias("cosine"))
    order = Window.partitionBy("key").orderBy(F.desc("cosine"), "other")
    return scored.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k)


def exact_top_k(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """(key, other, cosine, nth): the k most similar keys of each query by block against block; ties go by key.

    In: (key, unit) as of usable. Blocks of queries meet blocks of vectors; each meeting sends k rows for each query.
    """
    n_q, n_v = (max(1, -(-df.count() // BLOCK)) for df in (queries, vectors))
    left = queries.select(F.pmod(F.xxhash64("key"), F.lit(n_q)).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(n_v - 1))).alias("j"), "key", "unit")
    right = vectors.select(F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("i"), F.pmod(F.xxhash64("key"), F.lit(n_v)).cast("int").alias("j"), "key", "unit")

    def search(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if q.empty or v.empty:
            return pd.DataFrame({"key": pd.Series([], dtype=str), "other": pd.Series([], dtype=str), "cosine": np.empty(0)})
        v = v.sort_values("key", ignore_index=True)
        cosine = np.stack(q["unit"].to_numpy()) @ np.stack(v["unit"].to_numpy()).T
        cosine = np.round(cosine, 9)
        keys, others = q["key"].to_numpy(), v["key"].to_numpy()
        cosine[keys[:, None] == others[None]] = -2
        at, best = best_of_rows(cosine, k)
        out = pd.DataFrame({"key": keys[at], "other": others[best], "cosine": cosine[at, best]})
        return out[out["cosine"] > -2]

    met = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(search, "key string, other string, cosine double")
    order = Window.partitionBy("key").orderBy(F.desc("cosine"), "other")
    return met.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k)
