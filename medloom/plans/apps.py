"""The four applications end to end, as compositions of the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medloom import schemas
from medloom.functions import text as T
from medloom.functions import values as V
from medloom.operators import admissions, candidates, eda, encoders, entities, fulltext, metrics, ml, segments, validation, vectors
from medloom.runtime import cut
from medloom.sources import readers, writers


def annotate(spark: SparkSession, dictionary: DataFrame, labelled_csv: str | None = None, texts: str | None = None, out: str | None = None) -> DataFrame:
    """Records from a labelled CSV or a folder of texts (one of the two) with dictionary entities; invalid rows stop it."""
    if (labelled_csv is None) == (texts is None):
        raise ValueError("give either labelled_csv or texts")
    rows = readers.labelled_records(spark, labelled_csv) if labelled_csv else readers.text_records(spark, texts)
    found = entities.annotate(rows.select("record_id", "text"), dictionary).select("record_id", F.col("entities").alias("_found"))
    done = rows.drop("entities").join(found, "record_id", "left").withColumnRenamed("_found", "entities").withColumn("date_document", V.iso_date(F.col("date_document")))
    done = validation.strict(done.withColumn("errors", validation.record_errors(F.col("entities")))).drop("errors")
    if out:
        writers.records_csv(done, out)
    return done


def label_documents(labelled: DataFrame, manifest: DataFrame, unlabelled: DataFrame, backend: str = "hashing", k: int = 5, threshold: float = schemas.LABEL_THRESHOLD) -> DataFrame:
    """Labels of documents by their segments' nearest labelled segments.

    In: labelled and unlabelled (name, text), manifest (filename, label). Out: as vectors.label_by_neighbours, by name.
    """

    def encoded(docs: DataFrame) -> DataFrame:
        found = segments.segment_texts(docs, "name", "text")
        # written once: the search, its counts and the names all read it, and the model runs once
        return cut(found.select("name", F.xxhash64("name", "segment_id").alias("id"), "segment", encoders.encode(F.col("segment"), backend).alias("vector")))

    index = encoded(labelled.join(manifest.select(F.col("filename").alias("name")).distinct(), "name", "left_semi"))
    asked = encoded(unlabelled)
    near = vectors.nearest(asked.select(F.col("id").alias("query_id"), "vector"), index.select(F.col("id").alias("entry_id"), "vector"), k)
    labels = index.select(F.col("id").alias("entry_id"), "name").join(manifest.withColumnRenamed("filename", "name"), "name").select("entry_id", "label")
    near = near.join(asked.select(F.col("id").alias("query_id"), "name"), "query_id").join(labels, "entry_id")
    out = vectors.label_by_neighbours(near, list(schemas.DOCUMENT_LABELS), "name", threshold)
    shown = index.select(F.col("id").alias("entry_id"), F.col("name").alias("evidence_name"), F.col("segment").alias("evidence_text"))
    return out.withColumn("entry_id", F.col("evidence.entry_id")).join(shown, "entry_id", "left").drop("entry_id")


def export_labels(predictions: DataFrame, path: str, evidence: bool = True) -> None:
    """A row for each document with flag, score and evidence ('name | score | text', cut to what an export shows)."""
    shown = F.when(F.col("evidence_name").isNotNull(), F.concat_ws(" | ", "evidence_name", F.round("score", 4).cast("string"), "evidence_text"))
    wide = vectors.wide_predictions(predictions, "name", list(schemas.DOCUMENT_LABELS), shown if evidence else None)
    writers.predictions_csv(wide, path)


def describe(docs: DataFrame, manifest: DataFrame | None = None) -> dict[str, DataFrame]:
    """Summary, keyword hits and, with a manifest, label counts of a folder of documents."""
    n = eda.window_count(F.size(T.words(F.coalesce("text", F.lit("")))), segments.WINDOW, segments.OVERLAP)
    out = {"summary": eda.summary(docs.withColumn("_n", n), "text", F.col("_n")), "keywords": eda.keyword_hits(docs, "text", schemas.KEYWORD_HINTS)}
    if manifest is not None:
        lists = manifest.groupBy("filename").agg(F.collect_set("label").alias("labels"))  # at most one of each label
        out |= {"labels": eda.label_counts(lists, "labels"), "labels_per_document": eda.labels_per_document(lists, "labels")}
    return out


def clinical_table(spark: SparkSession, admissions_folder: str, documents_folder: str) -> DataFrame:
    """Documents of all admissions with the first admission line of each."""
    lines = readers.admission_lines(spark, admissions_folder)
    if missing := admissions.missing_columns(lines, "admission_id", "primary_diagnosis_code"):
        raise ValueError(f"missing columns: {missing}")
    return admissions.join_documents(readers.admission_documents(spark, documents_folder), lines, "file", "block", "line")


def training_table(clinical: DataFrame, order: str = "file_name") -> tuple[DataFrame, dict[str, int]]:
    """(admission_id, text, label) and the numbers of admissions left out for want of a label or a text."""
    labels = clinical.groupBy("admission_id").agg(F.min_by(T.stripped_or_null(F.col("primary_diagnosis_code")), order).alias("label"))
    texts = admissions.joined_text(clinical, "admission_id", "text_content", order).select("admission_id", T.preprocess(F.col("text_content")).alias("text"))
    both = labels.join(texts, "admission_id", "left")
    missing = both.agg(F.count(F.when(F.col("label").isNull(), 1)).alias("no_label"), F.count(F.when(F.col("label").isNotNull() & F.col("text").isNull(), 1)).alias("no_text")).first()
    return both.filter("label is not null and text is not null"), missing.asDict()


@dataclass
class Trained:
    model: PipelineModel
    measures: dict[str, float]


def train_codes(table: DataFrame, kind: str = "logreg", test_share: float = 0.2, settings: ml.Features = ml.Features(), **options) -> Trained:
    """A classifier of codes with its measures on admissions held out by hash."""
    held_out = F.pmod(F.xxhash64("admission_id"), F.lit(1000)) < int(test_share * 1000)
    model = ml.train(table.filter(~held_out), kind, settings, **options)
    known = table.filter(held_out).filter(F.col("label").isin(ml.classes(model)))
    scored = ml.predict(model, known).select(F.col("label").alias("y_true"), F.col("predicted_label").alias("y_pred"))
    return Trained(model, metrics.accuracy_f1(scored).first().asDict())


def predict_batch(model: PipelineModel, texts: DataFrame, k: int = 5) -> DataFrame:
    """``texts`` with the k most probable codes of each; k between 1 and 20."""
    if not 1 <= k <= 20:
        raise ValueError("k must be between 1 and 20")
    out = ml.predict(model, texts.withColumn("text", T.preprocess(F.col("text"))).filter("text is not null"))
    return out.withColumn("predictions", V.top_labels(F.col("probabilities"), ml.classes(model), k)).select(*texts.columns, "predictions")


def expand_vocabulary(docs: DataFrame, vocabulary: DataFrame, most: int = 100, backend: str | None = None, embedded: DataFrame | None = None) -> DataFrame:
    """Rows for validation: abbreviations with their long forms, and candidate terms that are no term of the vocabulary,
    each with the best entry of a full-text search, abbreviations also with the text around them.

    In: docs (doc_id string, text), vocabulary as sources.readers has it with line_no. At most ``most`` terms a document.
    With vectors of the vocabulary, embedded (entry_id, vector), and the backend they were made with, the comment of a
    candidate term names its most similar entry.
    """
    flat = vocabulary.select("ui", F.array_join("preferred_terms", " | ").alias("label"), F.array_join("synonyms", " | ").alias("synonyms"), "scope_note")
    columns = ("ui", "label", "synonyms", "scope_note")
    index, size = fulltext.postings(flat, "ui", *columns), fulltext.corpus_size(flat, *columns)
    pairs = cut(candidates.abbreviations(docs, "doc_id", "text"))
    terms = cut(candidates.unknown_terms(candidates.candidate_terms(docs, "doc_id", "text", most), entities.label_dictionary(vocabulary)))
    asked = terms.select(F.lower("candidate_term").alias("query_id")).unionByName(pairs.select(F.col("long_form").alias("query_id"))).distinct()
    best = fulltext.bm25(index, asked.withColumn("query", F.col("query_id")), *size, 1).join(flat.select(F.col("ui").alias("key"), "label"), "key")
    found = best.select("query_id", F.col("key").alias("ui"), "label", "score")
    if embedded is not None:
        words = terms.select("candidate_term").distinct().select(F.xxhash64("candidate_term").alias("query_id"), "candidate_term", encoders.encode(F.col("candidate_term"), backend or "hashing").alias("vector"))
        words = cut(words)
        near = vectors.nearest(words.select("query_id", "vector"), embedded, 1).join(words.select("query_id", "candidate_term"), "query_id")
        note = F.concat(F.lit("vector_ui="), F.col("entry_id").cast("string"), F.lit(" vector_score="), F.col("score").cast("string"))
        terms = terms.join(near.select("candidate_term", note.alias("comment")), "candidate_term", "left")
    suggested = lambda rows, query, kind: _suggested(rows.withColumn("query_id", query), found, kind)
    return (
        suggested(pairs.select("doc_id", F.col("abbreviation").alias("candidate_term"), "long_form", "context"), F.col("long_form"), "abbreviation")
        .unionByName(suggested(pairs.select("doc_id", F.col("long_form").alias("candidate_term"), "context"), F.col("candidate_term"), "long_form"))
        .unionByName(suggested(terms.select("doc_id", "candidate_term", *(["comment"] if embedded is not None else [])), F.lower("candidate_term"), "candidate_term"))
    )


def _suggested(rows: DataFrame, found: DataFrame, kind: str) -> DataFrame:
    none = F.lit("")
    given = lambda c: F.coalesce(c, none) if c in rows.columns else none
    joined = rows.join(found, "query_id", "left")
    return joined.select(
        "doc_id", "candidate_term", F.lit(kind).alias("candidate_type"), given("context").alias("context_snippet"), F.coalesce("ui", none).alias("mesh_ui_suggested"), F.coalesce("label", none).alias("mesh_label_suggested"),
        F.coalesce("score", F.lit(0.0)).alias("score"), none.alias("human_validation"), none.alias("human_target_mesh_ui"), none.alias("human_new_entity_label"), given("comment").alias("comment"),
    )
