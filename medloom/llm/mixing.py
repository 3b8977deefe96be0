"""Mixing sources to target shares of the total number of tokens.

Each source's documents are counted by exact token length. A source that must be used more than once is repeated whole;
for the rest of its budget a share of every length is taken, and what that leaves is fitted by a bounded-knapsack
subset-sum over the documents still free. Which documents of a length are taken is decided by a seeded hash. The driver
holds one number for each source and length, never anything for each document.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medloom.runtime import cut

#: Hash slots a length's documents are spread over; whole slots are taken, and only the last one is ranked.
SLOTS = 4096


def source_name(raw: Column) -> Column:
    """A source in one spelling: lower case, words joined by underscores; null for null and blank."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(raw)), r"[\s_-]+", "_"), F.lit(""))


@dataclass
class Plan:
    """What to take of one source: every document ``whole`` times, and of each length so many documents once more."""

    source: str
    target_share: float
    budget: int
    whole: int
    extra: dict[int, int] = field(default_factory=dict)
    planned: int = 0


def fit_budget(budget: int, counts: dict[int, int]) -> dict[int, int]:
    """Numbers of documents by length whose lengths add up to the largest reachable total within the budget.

    First a proportional share of every length is taken, rounded down, then single documents, the most underrepresented
    lengths first, until at most twice the longest length is open; where less is open, short documents are given back. The
    rest is a bounded-knapsack subset-sum over all documents not taken. The total is exact unless no subset
    of those fills the rest.
    """
    total = sum(length * n for length, n in counts.items())
    if budget >= total:
        return dict(counts)
    share = budget / total if total else 0.0
    take = {length: int(n * share) for length, n in counts.items()}
    rest = budget - sum(length * n for length, n in take.items())
    longest = max(counts, default=0)
    for length in sorted(counts, key=lambda x: (-(counts[x] * share - take[x]), x)):
        if rest <= 2 * longest:
            break
        if take[length] < counts[length] and length <= rest:
            take[length] += 1
            rest -= length
    # short documents are given back until there is room to fit the rest exactly
    for length in sorted(counts):
        back = min(take[length], max(0, -(-(2 * longest - rest) // length))) if length else 0
        take[length] -= back
        rest += back * length
    free = {length: min(counts[length] - take[length], rest // length) for length in counts if 0 < length <= rest}
    # binary splitting of the bounds; the driver holds five bytes for each sum up to the rest, whatever the number of items
    items = []
    for length, n in sorted(free.items()):
        part = 1
        while n > 0:
            part = min(part, n)
            items.append((length, part))
            n -= part
            part *= 2
    # for each sum the item that first reached it; what that item leaves was reached by items before it
    reach, first = np.zeros(rest + 1, bool), np.full(rest + 1, -1, np.int32)
    reach[0] = True
    for i, (length, part) in enumerate(items):
        size = length * part
        if size <= rest:
            new = reach[: rest + 1 - size] & ~reach[size:]
            first[size:][new] = i
            reach[size:] |= new
        if reach[rest]:
            break
    at = int(np.flatnonzero(reach)[-1])
    while at:
        length, part = items[first[at]]
        take[length] += part
        at -= length * part
    return {length: n for length, n in take.items() if n}


def plan_mixture(lengths: dict[str, dict[int, int]], weights: dict[str, tuple[float, int]], total: int | None = None) -> list[Plan]:
    """Plans of the sources that occur on both sides.

    Shares are taken relative to each other over those sources. ``total`` is the mixture's size in tokens; by default it
    is the largest at which no source must be repeated more than its cap, and it is lowered to that if larger.
    """
    sizes = {s: sum(length * n for length, n in lengths[s].items()) for s in weights if s in lengths}
    used = {s: w for s, w in weights.items() if sizes.get(s) and w[0] > 0 and w[1] > 0}
    whole_share = sum(share for share, _ in used.values())
    if not used:
        return []
    most = min(cap * sizes[s] * whole_share / share for s, (share, cap) in used.items())
    total = math.floor(most) if total is None else min(total, math.floor(most))
    plans = []
    for s, (share, _) in sorted(used.items()):
        budget = min(round(total * share / whole_share), used[s][1] * sizes[s])
        whole, rest = divmod(budget, sizes[s])
        extra = fit_budget(rest, lengths[s])
        plans.append(Plan(s, share / whole_share, budget, whole, extra, whole * sizes[s] + sum(length * n for length, n in extra.items())))
    return plans


def mix(docs: DataFrame, weights: DataFrame, key: str = "doc_id", total: int | None = None, seed: int = 17) -> tuple[DataFrame, list[Plan]]:
    """(key, source, n_tokens, copies) of the documents of the mixture, and the plans.

    In: documents with ``key``, source in one spelling (see source_name), n_tokens; weights with source, target_share, max_repeats.
    Documents without a source, of a source without a weight, or without a token are not in the mixture. A weight that is
    null counts as 0. Every document comes out at most once, with the number of its copies (1 to max_repeats).
    """
    spark = docs.sparkSession
    rows = weights.groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap")).filter("source is not null").collect()  # a row for each source
    wanted = {r["source"]: (r["share"] or 0.0, r["cap"] or 0) for r in rows}
    docs = docs.select(key, "source", "n_tokens").filter(F.col("n_tokens") > 0)
    docs = docs.join(weights.filter("source is not null").select("source").distinct(), "source", "left_semi")
    slotted = cut(docs.withColumn("slot", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(SLOTS)).cast("int")))
    lengths: dict[str, dict[int, int]] = {}
    for r in slotted.groupBy("source", "n_tokens").count().collect():  # bounded by sources times distinct lengths
        lengths.setdefault(r["source"], {})[r["n_tokens"]] = r["count"]
    plans = plan_mixture(lengths, wanted, total)
    need = [(p.source, int(length), p.whole, int(p.extra.get(length, 0))) for p in plans for length in lengths[p.source]]
    takes = spark.createDataFrame(pd.DataFrame(need, columns=["source", "n_tokens", "whole", "extra"]), "source string, n_tokens bigint, whole int, extra bigint")
    by_slot = Window.partitionBy("source", "n_tokens").orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # at most SLOTS rows for each source and length
    slots = slotted.groupBy("source", "n_tokens", "slot").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(by_slot))
    slots = slots.join(takes, ["source", "n_tokens"]).select("source", "n_tokens", "slot", "whole", F.least("n", F.greatest(F.lit(0), F.col("extra") - F.col("upto") + F.col("n"))).alias("more"), "n")
    taken = slotted.join(slots, ["source", "n_tokens", "slot"])
    edge = Window.partitionBy("source", "n_tokens", "slot").orderBy(F.xxhash64(key, F.lit(seed + 1)), key)
    whole_slot = taken.filter("more = 0 or more = n").withColumn("once", (F.col("more") > 0).cast("int"))
    last_slot = taken.filter("more > 0 and more < n").withColumn("once", (F.row_number().over(edge) <= F.col("more")).cast("int"))
    copies = whole_slot.unionByName(last_slot).select(key, "source", "n_tokens", (F.col("whole") + F.col("once")).cast("int").alias("copies"))
    return copies.filter("copies > 0"), plans
