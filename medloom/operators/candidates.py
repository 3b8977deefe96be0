"""Candidate terms, abbreviations, and rows for human validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medloom.functions import text as T
from medloom.functions.values import let

# What a term and an abbreviation in brackets look like.
TERM = r"([A-Za-zÀ-ÖØ-öø-ÿ\-]{4,})"
ABBREVIATION = r"([A-Za-zÀ-ÖØ-öø-ÿ\-\s]+?)\s*\(([A-Z]{2,8})\)"
#: The same but for white space at the end of the first group; starts at a run of such signs only, so it reads a text once.
_ONCE = r"(?<![A-Za-zÀ-ÖØ-öø-ÿ\-\s])([A-Za-zÀ-ÖØ-öø-ÿ\-\s]++)\(([A-Z]{2,8})\)"


def candidate_terms(docs: DataFrame, key: str, text: str, most: int | None = 80) -> DataFrame:
    """(key, candidate_term, pos): the distinct terms of each text as first written, in order, at most ``most``.

    ``most`` is the feature's own limit; None lifts it. Terms of one text never leave its row, so nothing is shuffled.
    """
    found = F.regexp_extract_all(F.col(text), F.lit(TERM), F.lit(1))
    by_term = F.array_sort(F.transform(found, lambda t, i: F.struct(F.lower(t).alias("small"), i.alias("pos"), t.alias("t"))))
    first = lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["small"] != x["small"]))
    in_order = F.array_sort(F.transform(let(by_term, first), lambda x: F.struct(x["pos"].alias("pos"), x["t"].alias("t"))))
    kept = F.slice(in_order, 1, most) if most else in_order
    return docs.select(F.col(key), F.explode(kept).alias("c")).select(key, F.col("c.t").alias("candidate_term"), F.col("c.pos").alias("pos"))


def abbreviations(docs: DataFrame, key: str, text: str, anchor: str | None = None) -> DataFrame:
    """(key, pos, long_form, abbreviation, context) of every 'long form (ABC)', small letters, in order.

    context is what stands around it, white space collapsed. With ``anchor`` only long forms that contain it, cut to start
    there.
    """
    whole = F.regexp_extract_all(F.col(text), F.lit(_ONCE), F.lit(0))
    between = F.split(F.col(text), _ONCE)
    chars = lambda parts, n: F.aggregate(F.slice(parts, 1, n), F.lit(0), lambda s, x: s + F.length(x))
    rows = docs.select(F.col(key), F.col(text).alias("_t"), between.alias("_b"), whole.alias("_w"), F.posexplode(whole).alias("pos", "hit"))
    rows = rows.withColumn("_at", chars(F.col("_b"), F.col("pos") + 1) + chars(F.col("_w"), F.col("pos")))
    context = T.context(F.col("_t"), F.col("_at"), F.col("_at") + F.length("hit")).alias("context")
    rows = rows.select(key, "pos", context, F.lower(T.strip(F.regexp_extract("hit", _ONCE, 1))).alias("long_form"), F.regexp_extract("hit", _ONCE, 2).alias("abbreviation"))
    if anchor is None:
        return rows.filter("long_form <> ''")
    at = F.locate(anchor.lower(), F.col("long_form"))
    return rows.filter(at > 0).withColumn("long_form", F.substring(F.col("long_form"), at, F.length("long_form")))


def candidate_rows(terms: DataFrame, kind: str, suggestions: DataFrame | None = None, snippet: Column | None = None) -> DataFrame:
    """Rows for validation, eleven columns, of (doc_id, candidate_term); suggestions (candidate_term, ui, label, score)."""
    if suggestions is not None:
        terms = terms.join(suggestions, "candidate_term", "left")
    else:
        terms = terms.withColumns({"ui": F.lit(None).cast("string"), "label": F.lit(None).cast("string"), "score": F.lit(None).cast("double")})
    none = F.lit("")
    return terms.select(
        "doc_id", "candidate_term", F.lit(kind).alias("candidate_type"), (snippet if snippet is not None else none).alias("context_snippet"), F.coalesce("ui", none).alias("mesh_ui_suggested"),
        F.coalesce("label", none).alias("mesh_label_suggested"), F.coalesce("score", F.lit(0.0)).alias("score"), none.alias("human_validation"), none.alias("human_target_mesh_ui"),
        none.alias("human_new_entity_label"), none.alias("comment"),
    )


def unknown_terms(terms: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Candidate terms that are no term of the dictionary."""
    return terms.withColumn("term", F.lower("candidate_term")).join(dictionary.select("term").distinct(), "term", "left_anti").drop("term")


def accepted(rows: DataFrame) -> DataFrame:
    return rows.filter(F.lower(T.strip(F.col("human_validation"))) == "accepted")


def extended_vocabulary(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of accepted rows: mappings to existing uis, new entities, and one row with the counts of both and of all."""
    ok = accepted(rows).withColumn("target", T.stripped_or_null(F.col("human_target_mesh_ui")))
    mappings = ok.filter("target is not null").select("doc_id", "candidate_term", F.col("target").alias("mesh_ui"))
    label = F.coalesce(T.stripped_or_null(F.col("human_new_entity_label")), T.stripped_or_null(F.col("candidate_term")))
    new = ok.filter("target is null").withColumn("label", label).filter("label is not null").select("doc_id", "candidate_term", "label")
    counts = ok.agg(
        F.count(F.lit(1)).alias("n_accepted"), F.count("target").alias("n_mappings"), F.count(F.when(F.col("target").isNull() & label.isNotNull(), 1)).alias("n_new")
    )
    return mappings, new, counts


def judge(candidate: Column, label: Column) -> Column:
    """(verdict, score, rationale) of a candidate term against a suggested label, by the words they share."""
    ct, sl = T.strip(T.text_or_empty(candidate)), T.strip(T.text_or_empty(label))
    parts = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-zà-öø-ÿ]+)"), F.lit(1)))
    shared = F.size(F.array_intersect(parts(ct), parts(sl))) / F.greatest(F.lit(1), F.size(parts(ct)))
    short = (ct == F.upper(ct)) & (F.lower(ct) != ct) & (F.length(ct) <= 8) & (F.size(parts(sl)) >= 2)
    made = lambda verdict, score, why: F.struct(F.lit(verdict).alias("verdict"), score.cast("double").alias("score"), F.lit(why).alias("rationale"))
    return (
        F.when((ct == "") | (sl == ""), made("unsure", F.lit(0.0), "term or label missing"))
        .when(F.lower(ct) == F.lower(sl), made("accepted", F.lit(1.0), "same text"))
        .when(short, made("unsure", F.lit(0.55), "looks like an abbreviation"))
        .when(shared >= 0.75, made("accepted", F.least(F.lit(0.95), shared), "many shared words"))
        .when(shared <= 0.2, made("rejected", F.greatest(F.lit(0.05), shared), "few shared words"))
        .otherwise(made("unsure", F.greatest(F.lit(0.25), shared), "some shared words"))
    )


def judge_cosine(similarity: Column, accept: float = 0.75, reject: float = 0.45) -> Column:
    """(verdict, score) of a cosine similarity."""
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), similarity))
    return F.struct(F.when(similarity >= accept, "accepted").when(similarity <= reject, "rejected").otherwise("unsure").alias("verdict"), score.alias("score"))


def last_wins(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row for each key, the last in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))).filter("_n = 1").drop("_n")


def first_wins(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row for each key, the first in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")
