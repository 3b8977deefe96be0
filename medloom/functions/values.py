"""Dates, arrays, maps and probabilities as Column -> Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from medloom.functions import text as T

#: Date spellings that are understood, tried in this order.
DATE_FORMATS = ("yyyy-M-d", "d/M/yyyy", "d-M-yyyy", "yyyy/M/d", "yyyy.M.d")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, where naming it twice inside a lambda would compute it each time."""
    return F.transform(F.array(value), body)[0]


def iso_date(c: Column) -> Column:
    """A date in any of DATE_FORMATS as yyyy-MM-dd; other text as it is, without white space at the ends; blank as null."""
    plain = T.stripped_or_null(c)
    return F.coalesce(*[F.date_format(F.try_to_date(plain, f), "yyyy-MM-dd") for f in DATE_FORMATS], plain)


def distinct_in_order(c: Column) -> Column:
    return F.array_distinct(c)


def long_tokens(c: Column, least: int = 2) -> Column:
    return F.filter(c, lambda x: F.length(x) >= least)


def associated_codes(c: Column) -> Column:
    """Codes of a blank-separated field: three characters or more, starting with a letter, once each in order."""
    return F.array_distinct(F.filter(T.tokens(c), lambda x: (F.length(x) >= 3) & x.rlike(r"^\p{L}")))


def clean_map(c: Column) -> Column:
    """Keys and values without white space at the ends, entries with a blank key dropped; of equal keys the last holds."""
    found = F.transform(F.map_entries(c), lambda e: F.struct(T.strip(e["key"]).alias("key"), T.text_or_empty(T.strip(e["value"])).alias("value")))
    last = lambda entries: F.transform(
        F.array_distinct(F.transform(entries, lambda e: e["key"])), lambda k: F.struct(k.alias("key"), F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"].alias("value"))
    )
    return F.map_from_entries(let(F.filter(found, lambda e: e["key"] != ""), last))


def softmax(c: Column) -> Column:
    """Exponentials of an array shifted by its maximum, scaled to add up to one; an empty array stays empty."""
    shifted = let(F.array_max(c).cast("double"), lambda top: F.transform(c, lambda x: F.exp(x.cast("double") - top)))
    scaled = lambda e: let(F.aggregate(e, F.lit(0.0), lambda s, y: s + y), lambda sum_: F.transform(e, lambda x: x / sum_))
    return let(shifted, scaled)


def _scored(probabilities: Column, labels: list[str]) -> Column:
    names = F.array(*[F.lit(x) for x in labels])
    return F.transform(probabilities, lambda p, i: F.struct((-p.cast("double")).alias("down"), (-i).alias("at"), F.get(names, i).alias("label"), p.cast("double").alias("prob")))


def top_labels(probabilities: Column, labels: list[str], k: int = 5) -> Column:
    """The k most probable (label, prob), the higher index first among equals."""
    best = F.slice(F.array_sort(_scored(probabilities, labels)), 1, k)
    return F.transform(best, lambda x: F.struct(x["label"].alias("label"), x["prob"].alias("prob")))


def above_thresholds(probabilities: Column, labels: list[str], thresholds: dict[str, float], default: float = 0.5) -> Column:
    """(label, prob) of every label that reaches its threshold, most probable first, the lower index first among equals."""
    limits = F.array(*[F.lit(float(thresholds.get(x, default))) for x in labels])
    names = F.array(*[F.lit(x) for x in labels])
    rows = F.transform(probabilities, lambda p, i: F.struct((-p.cast("double")).alias("down"), i.alias("at"), F.get(names, i).alias("label"), p.cast("double").alias("prob"), F.get(limits, i).alias("limit")))
    kept = F.array_sort(F.filter(rows, lambda x: x["prob"] >= x["limit"]))
    return F.transform(kept, lambda x: F.struct(x["label"].alias("label"), x["prob"].alias("prob")))
