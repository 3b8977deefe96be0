"""Queries of the llm problems and the SQL that some of them have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medloom.llm import mixing, neighbours, personal, pieces, reading, splits, tokens
from medloom.runtime import cut, table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    records = pieces.oversized_items(table(spark, sf, "records"), "record_id", "text", "records")
    return records.unionByName(pieces.oversized_items(table(spark, sf, "medical_documents"), "filename", "raw_text", "medical_documents"))


def p1_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """All texts of both tables as ordered pieces."""
    records = pieces.split_oversized(table(spark, sf, "records"), "record_id", "text").withColumn("tbl", F.lit("records"))
    return records.unionByName(pieces.split_oversized(table(spark, sf, "medical_documents"), "filename", "raw_text").withColumn("tbl", F.lit("medical_documents")))


def p1_cover(spark: SparkSession, sf: str) -> DataFrame:
    """What the pieces of each item add up to without their overlaps, and whether all are within the limit."""
    rows = p1_pieces(spark, sf).groupBy("tbl", "item_id")
    return rows.agg(F.sum(F.col("n_chars") - F.col("n_overlap")).alias("n_chars"), (F.max("n_chars") <= pieces.LIMIT).alias("within"), F.sum((F.col("piece_no") == 0).cast("int")).alias("n_rows"))


def _stays(spark: SparkSession, sf: str) -> DataFrame:
    stays = table(spark, sf, "stays")
    return stays.select(splits.identifier(F.col("patient_id"), "PAT").alias("a"), splits.identifier(F.col("admission_id"), "ADM").alias("b")).distinct()


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    groups = splits.components(_stays(spark, sf)).filter(F.col("node").startswith("PAT-"))
    return splits.linked_pairs(groups).select(F.col("a").alias("patient_a"), F.col("b").alias("patient_b"))


def p2_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Each patient with the group that shares a split, named by its smallest patient, and the group's size."""
    return splits.memberships(splits.components(_stays(spark, sf)), "PAT-").select(F.col("node").alias("patient"), "group", "n_nodes")


def _assigned(spark: SparkSession, sf: str) -> DataFrame:
    groups = splits.components(_stays(spark, sf))
    records = table(spark, sf, "records").select(
        F.lit("records").alias("tbl"), F.col("record_id").alias("row_key"), splits.identifier(F.col("patient_id"), "PAT").alias("entity"), F.concat(F.lit("record "), "record_id").alias("fallback")
    )
    clinical = table(spark, sf, "clinical_records").select(
        F.lit("clinical_records").alias("tbl"), F.col("row_id").cast("string").alias("row_key"), splits.identifier(F.col("admission_id"), "ADM").alias("entity"),
        F.concat(F.lit("text "), F.coalesce(F.sha2("text_content", 256), F.col("row_id").cast("string"))).alias("fallback"),
    )
    return splits.assign(records.unionByName(clinical), "entity", "fallback", groups)


def p2_splits(spark: SparkSession, sf: str) -> DataFrame:
    """The split of every row of records and clinical_records."""
    return _assigned(spark, sf).select("tbl", "row_key", "component", "split")


def p2_together(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of both tables, and how many components lie in more than one split."""
    groups = _assigned(spark, sf).groupBy("component", "split").agg(F.count(F.lit(1)).alias("n")).groupBy("component").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("splits"))
    return groups.agg(F.sum("n").alias("n_rows"), F.sum((F.col("splits") > 1).cast("int")).alias("n_divided"))


def p2_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and components of each split, with the share that was asked for."""
    by_component = _assigned(spark, sf).groupBy("tbl", "split", "component").agg(F.count(F.lit(1)).alias("n"))
    counts = by_component.groupBy("tbl", "split").agg(F.sum("n").alias("n_rows"), F.count("component").alias("n_components"))
    wanted = F.create_map(*[x for k, v in splits.SPLITS.items() for x in (F.lit(k), F.lit(v))])
    return counts.withColumn("target_share", wanted[F.col("split")])


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.usable(table(spark, sf, "mesh_embeddings"), "ui", "vector")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.close_pairs(_vectors(spark, sf)).select(F.col("key_a").alias("ui_a"), F.col("key_b").alias("ui_b"))


def _queries(vectors: DataFrame) -> DataFrame:
    """The stated query set: every ui whose number is divisible by 50."""
    return vectors.filter(F.regexp_extract("key", r"(\d+)$", 1).cast("bigint") % 50 == 0)


def p5_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The ten most similar of every ui whose number is divisible by 50, among all."""
    vectors = cut(_vectors(spark, sf))
    return neighbours.exact_top_k(_queries(vectors), vectors).select(F.col("key").alias("ui"), F.col("other").alias("other_ui"), F.round("cosine", 6).alias("cosine"), "nth")


def p5_similar(spark: SparkSession, sf: str) -> DataFrame:
    """About the ten most similar of every ui whose number is divisible by 50, by multi-index hashing over all vectors."""
    vectors = cut(_vectors(spark, sf))
    return neighbours.top_k(_queries(vectors), vectors).select(F.col("key").alias("ui"), F.col("other").alias("other_ui"), F.round("cosine", 6).alias("cosine"), "nth")


def p5_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Both searches against the exact one over the query set: pairs of p5_found, and neighbours of p5_similar."""
    vectors = cut(_vectors(spark, sf))
    ten = cut(neighbours.exact_top_k(_queries(vectors), vectors))
    near = ten.filter("cosine >= 0.95").select("key", "other")
    asked = cut(near.select(F.col("other").alias("key")).distinct().join(vectors, "key"))
    back = neighbours.exact_top_k(asked, vectors).select(F.col("key").alias("other"), F.col("other").alias("key"))
    true = near.join(back, ["key", "other"]).select(F.least("key", "other").alias("key_a"), F.greatest("key", "other").alias("key_b")).distinct()
    found = neighbours.close_pairs(vectors).select("key_a", "key_b", F.lit(1).alias("hit"))
    counts = (F.count(F.lit(1)).alias("n_true"), F.count("hit").alias("n_found"))
    pairs = true.join(found, ["key_a", "key_b"], "left").agg(*counts).select(F.lit("pairs").alias("search"), "*")
    similar = neighbours.top_k(_queries(vectors), vectors).select("key", "other", F.lit(1).alias("hit"))
    return pairs.unionByName(ten.join(similar, ["key", "other"], "left").agg(*counts).select(F.lit("top").alias("search"), "*"))


def _clinical_texts(spark: SparkSession, sf: str) -> DataFrame:
    clinical = table(spark, sf, "clinical_records").select(F.lit("clinical_records").alias("tbl"), F.col("row_id").cast("string").alias("row_key"), F.col("text_content").alias("text"))
    return clinical.unionByName(table(spark, sf, "records").select(F.lit("records").alias("tbl"), F.col("record_id").alias("row_key"), "text"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    texts = _clinical_texts(spark, sf)
    return personal.find_personal(texts, personal.learn(texts))


def p6_sanitised(spark: SparkSession, sf: str) -> DataFrame:
    """Every text with typed placeholders in place of personal items."""
    texts = _clinical_texts(spark, sf)
    return personal.sanitise(texts, personal.learn(texts))


def p6_disclosure(spark: SparkSession, sf: str) -> DataFrame:
    """How much each capitalised word of the corpus, and each context of its numbers, says about persons, in bits."""
    words = personal.disclosure(_clinical_texts(spark, sf))[0]
    context = F.col("word").startswith(personal._CONTEXT)
    return words.select(F.when(context, "context").otherwise("word").alias("kind"), F.ltrim("word", F.lit(personal._CONTEXT)).alias("term"), "n", "n_protected", "disclosure")


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode_texts(table(spark, sf, "documents"))


def p7_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by whether decoding their ids gives the text again (null and empty texts give the empty text)."""
    docs = table(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("was"))
    back = tokens.decode_ids(tokens.encode_texts(table(spark, sf, "documents"))).select("doc_id", F.sha2("text", 256).alias("now"))
    return docs.join(back, "doc_id").groupBy((F.col("was") == F.col("now")).alias("same")).agg(F.count(F.lit(1)).alias("n_docs"))


def _mixture(spark: SparkSession, sf: str):
    docs = table(spark, sf, "documents").select("doc_id", mixing.source_name(F.col("source")).alias("source"), "text")
    weights = table(spark, sf, "source_weights").select(mixing.source_name(F.col("source")).alias("source"), "target_share", "max_repeats")
    counted = cut(tokens.count_tokens(docs, keep=("doc_id", "source")))
    mixture, plans = mixing.mix(counted, weights)
    return mixture, plans, counted, weights


def p8_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of the mixture with the number of their copies."""
    return _mixture(spark, sf)[0]


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Each source of either side with its target share, its share among the sources of both sides and the share reached."""
    mixture, plans, counted, weights = _mixture(spark, sf)
    reached = mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("n_docs"), F.max("copies").alias("most_copies"))
    total = sum(p.planned for p in plans)
    has = counted.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"))
    planned = spark.createDataFrame([(p.source, p.target_share, p.budget) for p in plans], "source string, share_of_both double, budget bigint")
    rows = weights.select("source", "target_share", "max_repeats").join(has, "source", "full").join(planned, "source", "left").join(reached, "source", "left")
    return rows.withColumn("tokens", F.coalesce("tokens", F.lit(0))).withColumn("actual_share", F.col("tokens") / F.lit(float(max(total, 1))))


def _levels(spark: SparkSession, sf: str) -> DataFrame:
    return reading.reading_levels(table(spark, sf, "documents"), table(spark, sf, "reading_labels"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return _levels(spark, sf).filter("level >= 4").select("doc_id")


def p9_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Difficulty and level of every document with words."""
    return _levels(spark, sf).select("doc_id", "difficulty", "level")


QUERIES = {
    "p1_found": p1_found, "p1_pieces": p1_pieces, "p1_cover": p1_cover, "p2_found": p2_found, "p2_groups": p2_groups, "p2_splits": p2_splits, "p2_together": p2_together, "p2_shares": p2_shares,
    "p5_found": p5_found, "p5_topk": p5_topk, "p5_similar": p5_similar, "p5_recall": p5_recall,
    "p6_found": p6_found, "p6_sanitised": p6_sanitised, "p6_disclosure": p6_disclosure,
    "p7_ids": p7_ids, "p7_roundtrip": p7_roundtrip, "p8_mixture": p8_mixture, "p8_shares": p8_shares,
    "p9_found": p9_found, "p9_levels": p9_levels,
}
_COSINES = """
        WITH v AS (SELECT ui, min(vector) AS vector FROM (SELECT ui, vector::DOUBLE[] AS vector FROM mesh_embeddings WHERE ui IS NOT NULL AND len(vector) = 64)
            WHERE len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0 GROUP BY ui),
          c AS (SELECT x.ui AS a, y.ui AS b, list_cosine_similarity(x.vector, y.vector) AS cosine FROM v x JOIN v y ON x.ui <> y.ui),
          near AS (SELECT a, b, cosine, row_number() OVER (PARTITION BY a ORDER BY round(cosine, 9) DESC, b) AS nth FROM c QUALIFY nth <= 10)"""
_LINKED = r"""
        WITH RECURSIVE s AS (SELECT DISTINCT p, a FROM (SELECT regexp_extract(upper(regexp_replace(patient_id, '[^\p{L}\p{Nd}]', '', 'g')), '^PAT(\d+)$', 1) AS p,
          regexp_extract(upper(regexp_replace(admission_id, '[^\p{L}\p{Nd}]', '', 'g')), '^ADM(\d+)$', 1) AS a FROM stays) WHERE p <> '' AND a <> ''),
          near AS (SELECT DISTINCT x.p AS a, y.p AS b FROM s x JOIN s y USING (a) WHERE x.p <> y.p),
          far AS (SELECT a, b FROM near UNION SELECT f.a, n.b FROM far f JOIN near n ON n.a = f.b)"""
SQL: dict[str, str] = {
    "p1_found": r"""
        SELECT tbl, item_id, CASE WHEN max(longest) > 2000 THEN 'forced' ELSE 'boundary' END AS cut FROM (
          SELECT tbl, item_id, list_max(list_transform(regexp_split_to_array(txt, '[ \t\r\n]+'), lambda x: length(x))) AS longest FROM (
            SELECT 'records' AS tbl, record_id AS item_id, "text" AS txt FROM records UNION ALL
            SELECT 'medical_documents', filename, raw_text FROM medical_documents) WHERE length(txt) > 2000)
        GROUP BY tbl, item_id""",
    "p1_cover": """
        SELECT tbl, item_id, sum(length(txt))::BIGINT AS n_chars, true AS within, count(*) AS n_rows FROM (SELECT 'records' AS tbl, record_id AS item_id, "text" AS txt FROM records UNION ALL
            SELECT 'medical_documents', filename, raw_text FROM medical_documents) WHERE txt IS NOT NULL GROUP BY tbl, item_id""",
    "p2_together": "SELECT (SELECT count(*) FROM records) + (SELECT count(*) FROM clinical_records) AS n_rows, 0::BIGINT AS n_divided",
    "p2_found": rf"""{_LINKED} SELECT DISTINCT 'PAT-' || a AS patient_a, 'PAT-' || b AS patient_b FROM far WHERE a < b""",
    "p2_groups": rf"""{_LINKED}, g AS (SELECT p, least(p, coalesce(min(b), p)) AS g FROM (SELECT DISTINCT p FROM s) LEFT JOIN far ON a = p GROUP BY p)
        SELECT 'PAT-' || p AS patient, 'PAT-' || g AS "group", count(*) OVER (PARTITION BY g) AS n_nodes FROM g""",
    "p5_found": f"""{_COSINES}
        SELECT x.a AS ui_a, x.b AS ui_b FROM near x JOIN near y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b AND x.cosine >= 0.95""",
    "p5_topk": f"""{_COSINES}
        SELECT a AS ui, b AS other_ui, round(cosine, 6) AS cosine, nth::INTEGER AS nth FROM near WHERE CAST(regexp_extract(a, '(\\d+)$', 1) AS BIGINT) % 50 = 0""",
    "p7_roundtrip": "SELECT true AS same, count(*) AS n_docs FROM documents",
}
