"""Queries of composed operators: files written and read back, streams, stored indexes, and chains of steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medloom import schemas
from medloom.functions import text as T
from medloom.operators import admissions, candidates, documents, entities, fulltext, metrics, segments, taxonomy, validation, vectors
from medloom.plans import apps, catalogue
from medloom.plans.catalogue import _COLLAPSE, _S, _STRIP, _TREE, _W, _WORDS
from medloom.runtime import scratch, table
from medloom.sources import readers, writers
from medloom.streaming import stateless

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- files written and read back

@query("SELECT record_id, patient_id, type_document, coalesce(date_document, '') AS date_document, md5(coalesce(text, '')) AS digest FROM records")
def csv_readback(spark, sf):
    """Records with quotes and line breaks through CSV; its empty and null fields are one."""
    path = scratch(spark)
    writers.records_csv(table(spark, sf, "records"), path)
    rows = readers.csv(spark, path, schemas.RECORD)
    return rows.select("record_id", "patient_id", "type_document", F.coalesce("date_document", F.lit("")).alias("date_document"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"))


_CELL = lambda c: f"coalesce(regexp_split_to_array({c}, '[|;]'), [])"


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """The vocabulary with cells divided where two signs stand, in the schema of its files."""
    cell = lambda c: F.coalesce(F.split(c, "[|;]"), F.array().cast("array<string>")).alias(c)
    return table(spark, sf, "mesh").select("ui", cell("preferred_terms"), cell("synonyms"), cell("tree_numbers"), "scope_note", "source")


@query(f"SELECT ui, len({_CELL('synonyms')})::INTEGER AS n_synonyms, md5(array_to_string({_CELL('preferred_terms')}, '|')) AS terms, scope_note FROM mesh")
def json_lines_readback(spark, sf):
    path = scratch(spark)
    writers.json_lines(_lines(spark, sf), path)
    rows = readers.vocabulary_lines(spark, path)
    return rows.select("ui", F.size("synonyms").alias("n_synonyms"), F.md5(F.array_join("preferred_terms", "|")).alias("terms"), "scope_note")


_FILLED = lambda c: f"list_filter(list_transform({_CELL(c)}, lambda x: {_STRIP('x')}), lambda x: x <> '')"


@query(
    rf"""WITH v AS (SELECT {_STRIP('ui')} AS ui, {_STRIP("coalesce(preferred_terms, '')")} AS name, {_FILLED('synonyms')} AS syn, {_FILLED('tree_numbers')} AS trees, {_STRIP("coalesce(scope_note, '')")} AS note
          FROM mesh WHERE {_STRIP('ui')} <> '')
        SELECT ui, name AS preferred, len(list_filter(syn, lambda x, i: list_position(list_transform(syn, lambda y: lower(y)), lower(x)) = i AND lower(x) <> lower(name)))::INTEGER AS n_synonyms, array_to_string(trees, ' ') AS trees, note AS scope_note FROM v"""
)
def xml_vocabulary(spark, sf):
    """Descriptor XML made of the vocabulary, read by the XML reader."""
    path = scratch(spark)
    array = lambda c: F.coalesce(F.split(c, "[|;]"), F.array().cast("array<string>"))
    concept = F.struct(F.col("scope_note").alias("ScopeNote"), F.struct(F.transform(array("synonyms"), lambda x: F.struct(x.alias("String"))).alias("Term")).alias("TermList"))
    rows = table(spark, sf, "mesh").select(
        F.col("ui").alias("DescriptorUI"), F.struct(F.col("preferred_terms").alias("String")).alias("DescriptorName"), F.struct(array("tree_numbers").alias("TreeNumber")).alias("TreeNumberList"), F.struct(F.array(concept).alias("Concept")).alias("ConceptList")
    )
    rows.write.format("xml").option("rowTag", "DescriptorRecord").option("rootTag", "DescriptorRecordSet").save(path)
    read = readers.vocabulary_xml(spark, path)
    return read.select("ui", F.array_join("preferred_terms", "").alias("preferred"), F.size("synonyms").alias("n_synonyms"), F.array_join("tree_numbers", " ").alias("trees"), "scope_note")


@query(f"SELECT DISTINCT filename, doc_label AS label FROM medical_documents WHERE filename IS NOT NULL AND doc_label IN ({', '.join(repr(x) for x in schemas.DOCUMENT_LABELS)})")
def manifest_labels(spark, sf):
    """A manifest, one JSON object from file names to labels, as the format wants it: one object for the labelled files."""
    path = scratch(spark)
    rows = table(spark, sf, "medical_documents").filter("filename is not null and doc_label is not null").groupBy("filename").agg(F.collect_set("doc_label").alias("labels"))
    rows.groupBy().agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("filename", "labels"))))).write.text(path)
    return readers.manifest(spark, path)


@query(catalogue.SQL["fixed_width_parse"].replace("SELECT row_id, ", "SELECT ").replace("FROM clinical_records", f"FROM clinical_records WHERE {_STRIP("concat(facility_id, rss_id, admission_id, rum_id, birth_date, sex, admission_date, discharge_date, primary_diagnosis_code, related_diagnosis_code, associated_diagnosis_codes)")} <> ''"))
def admission_files(spark, sf):
    """Fixed-width files of a folder, parsed."""
    path = scratch(spark)
    catalogue._lines(spark, sf).select("value").write.option("lineSep", "\n").text(path)
    return admissions.parse_lines(spark.read.text(path)).select(*schemas.ADMISSION_FIELDS, F.array_join("associated_diagnosis_codes", " ").alias("associated"))


# ---- streams

@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def stream_counts(spark, sf):
    """Rows of each kind in each hour, counted over a stream that is read to its end."""
    rows = table(spark, sf, "events")
    stream = spark.readStream.schema(rows.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    path = scratch(spark)
    stateless.tables_of(stateless.counted(stream, "ts", "event_type"), path, scratch(spark))
    return spark.read.parquet(path).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_distinct(spark, sf):
    """Each user and kind once, over a stream."""
    rows = table(spark, sf, "events")
    stream = spark.readStream.schema(rows.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    path = scratch(spark)
    stateless.run_to_end(stateless.deduplicated(stream, "ts", ["user_id", "event_type"], "60 days"), path, scratch(spark))
    return spark.read.parquet(path).select("user_id", "event_type")


# ---- stored indexes

_ASKED = [(1, "cardiac dysplasia"), (2, "family history"), (3, "spirometry liver"), (4, "Angiopathy, Subacute"), (5, "hépatofibrose")]


def _stored(spark: SparkSession, sf: str) -> fulltext.StoredIndex:
    path = scratch(spark)
    fulltext.StoredIndex.write(catalogue._vocabulary(spark, sf), "ui", *catalogue._INDEXED, path=path)
    return fulltext.StoredIndex.open(spark, path)


@query(catalogue.SQL["bm25_search"])
def stored_search(spark, sf):
    """bm25_search on an index that was written and opened again."""
    return _stored(spark, sf).search(spark.createDataFrame(_ASKED, "query_id int, query string"))


@query(catalogue.SQL["cosine_topk"])
def stored_vectors(spark, sf):
    """cosine_topk on a stored index."""
    rows, path = table(spark, sf, "embeddings"), scratch(spark)
    vectors.write_index(rows.filter("vec_id % 5 <> 0").select(F.col("vec_id").alias("entry_id"), F.col("embedding").alias("vector")), path)
    return vectors.nearest(rows.filter("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), vectors.open_index(spark, path))


# ---- chains of steps

_ENTRIES = f"(SELECT lower(item) AS term, min(ui) AS ui FROM (SELECT ui, {_STRIP("unnest(regexp_split_to_array(concat_ws('|', preferred_terms, synonyms), '[|;]'))")} AS item FROM mesh WHERE trim(ui) <> '') WHERE item <> '' GROUP BY 1)"
_TEXTS = "(SELECT filename, raw_text AS text FROM medical_documents WHERE filename IS NOT NULL AND raw_text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY filename ORDER BY raw_text) = 1)"
_TOKEN = "[A-Za-zÀ-ÖØ-öø-ÿ\\-]{4,}"


@query(
    f"""WITH {catalogue._spans_sql(_TEXTS, "filename")}, tok AS (SELECT DISTINCT filename, unnest(regexp_extract_all(text, '{_TOKEN}')) AS label FROM {_TEXTS}),
        best AS ({catalogue._bm25_sql("SELECT DISTINCT lower(label) AS query_id, lower(label) AS query FROM tok", 1)})
        SELECT filename, concept_id AS ui, term AS label, start, "end", 'dict' AS method, 1.0::DOUBLE AS score FROM spans UNION ALL
        SELECT filename, key, label, -1, -1, 'fts', score FROM tok JOIN best ON query_id = lower(label)"""
)
def detect_entities(spark, sf):
    """Vocabulary entries in documents: terms where they stand, and the best search hit of every other word."""
    docs = candidates.first_wins(table(spark, sf, "medical_documents").filter("filename is not null and raw_text is not null"), "filename", "raw_text").select("filename", F.col("raw_text").alias("text"))
    entries = catalogue._dictionary(spark, sf).select("term", F.col("concept_id").alias("ui"))
    return entities.detect(docs, entries, "filename", "text", _stored(spark, sf))


@query(
    """SELECT record_id, len(s)::INTEGER AS n, list_aggregate(list_transform(s, lambda e: e->>'start' || '-' || (e->>'end') || ' ' || (e->>'label')), 'string_agg', ',') AS spans
       FROM (SELECT record_id, list_filter(TRY_CAST(entities AS JSON[]), lambda e: e->>'label' IN ('DISEASE', 'MEDICATION')) AS s FROM records) WHERE len(s) > 0"""
)
def ner_training_rows(spark, sf):
    """Texts and spans of two labels, as a recogniser's trainer takes them."""
    rows = table(spark, sf, "records").withColumn("entities", validation.parse_entities(F.col("entities")))
    found = entities.training_spans(rows, ["DISEASE", "MEDICATION"])
    shown = F.array_join(F.transform("entities", lambda e: F.concat(e["start"].cast("string"), F.lit("-"), e["end"].cast("string"), F.lit(" "), e["label"])), ",")
    return found.select("record_id", F.size("entities").alias("n"), shown.alias("spans"))


_TOP3 = f"""(SELECT vec_id, 'c' || pos AS code, v AS score FROM (SELECT vec_id, pos, v, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, pos DESC) AS n FROM
    (SELECT vec_id, unnest(range(10)) AS pos, unnest(p) AS v FROM {catalogue._SOFT})) WHERE n <= 3)"""


@query(
    f"""WITH t AS {_TOP3}, up AS (SELECT vec_id, 'c0' AS code, 0.9::DOUBLE * min(score) AS score FROM t WHERE code IN ('c1', 'c2', 'c3', 'c4') GROUP BY 1)
        SELECT vec_id, code, round(score, 6) AS score FROM t UNION ALL SELECT vec_id, code, round(score, 6) FROM up WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.vec_id = up.vec_id AND t.code = 'c0')"""
)
def postprocess_chain(spark, sf):
    """Logits to probabilities, the three best, and the parent that four of the labels share."""
    parents = spark.createDataFrame([(f"c{i}", "c0") for i in range(1, 5)], "code string, parent string")
    return metrics.postprocess(catalogue._logits(spark, sf), "vec_id", "z", catalogue._NAMES, 3, parents=parents, logits=True).withColumn("score", F.round("score", 6))


@query(
    f"""WITH near AS (SELECT * FROM ({catalogue._NEAR}) WHERE rank <= 5), p AS ({catalogue._BY_LABEL}) SELECT doc, {', '.join(
        f'bool_or(predicted) FILTER (label = {i}) AS "{i}_flag", max(score) FILTER (label = {i}) AS "{i}_score", max(CASE WHEN entry_id IS NOT NULL THEN entry_id::VARCHAR END) FILTER (label = {i}) AS "{i}_evidence"' for i in range(10))} FROM p GROUP BY doc"""
)
def predictions_evidence(spark, sf):
    """One row for each document with flag, score and evidence of each label."""
    out = vectors.label_by_neighbours(catalogue._labelled_near(spark, sf), catalogue._LABELS, "doc", catalogue._THRESHOLD)
    return vectors.wide_predictions(out, "doc", catalogue._LABELS, F.col("evidence.entry_id"))


@query(
    f"""WITH near AS (SELECT * FROM ({catalogue._NEAR}) WHERE rank <= 5), p AS ({catalogue._BY_LABEL}), c AS (SELECT vec_id // 25 AS doc, label, max(greatest(embedding[1]::DOUBLE, 0)) AS s FROM embeddings WHERE vec_id % 5 = 0 GROUP BY ALL)
        SELECT doc, p.label::VARCHAR AS label, round(greatest(score, coalesce(c.s, 0.0)), 6) AS score, greatest(score, coalesce(c.s, 0.0)) >= 0.3 + 0.01 * p.label AS predicted FROM p LEFT JOIN c USING (doc, label)"""
)
def hybrid_predictions(spark, sf):
    """Labels by neighbours and by a second score, each label with its own threshold."""
    near = catalogue._labelled_near(spark, sf).withColumn("label", F.col("label").cast("string"))
    second = table(spark, sf, "embeddings").filter("vec_id % 5 = 0").select(F.floor(F.col("vec_id") / 25).alias("doc"), F.col("label").cast("string").alias("label"), F.greatest(F.col("embedding")[0].cast("double"), F.lit(0.0)).alias("score"))
    limits = spark.createDataFrame([(i, str(i), 0.3 + 0.01 * i) for i in range(10)], "pos int, label string, threshold double")
    return vectors.hybrid_labels(near, limits, "doc", classified=second).select("doc", "label", F.round("score", 6).alias("score"), "predicted")


@query(" UNION ALL ".join(f"SELECT {i} AS pos, '{x}' AS label, {0.6 if x == 'crh' else schemas.LABEL_THRESHOLD}::DOUBLE AS threshold, {len(schemas.KEYWORD_HINTS[x])} AS n_hints" for i, x in enumerate(schemas.DOCUMENT_LABELS)))
def label_definitions(spark, sf):
    return documents.label_definitions(spark, {"crh": 0.6}).select("pos", "label", "threshold", F.size("keyword_hints").alias("n_hints"))


@query(
    """WITH placed AS (SELECT admission_id, row_id, text_content AS t, coalesce(sum(length(text_content) + 1) OVER (PARTITION BY admission_id ORDER BY row_id, text_content ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM clinical_records WHERE text_content IS NOT NULL)
       SELECT admission_id, (place // 20000)::BIGINT AS chunk, md5(string_agg(t, ' ' ORDER BY row_id, t)) AS digest FROM placed GROUP BY 1, 2"""
)
def text_chunks(spark, sf):
    """The texts of each admission in order, in chunks."""
    rows = admissions.text_chunks(table(spark, sf, "clinical_records"), "admission_id", "text_content", "row_id", 20_000)
    return rows.select("admission_id", "chunk", F.md5("text_content").alias("digest"))


_MADE = "(SELECT row_no, 'Seen  for ' || description || ' (ABC) and' || chr(10) || 'then ' || description || ' (XY) today.' AS t FROM icd10_nodes WHERE description IS NOT NULL)"
_ABBREVIATION = r"([A-Za-zÀ-ÖØ-öø-ÿ\-\s]+?)\s*\(([A-Z]{2,8})\)"


@query(
    rf"""WITH h AS (SELECT row_no, t, regexp_extract_all(t, '{_ABBREVIATION}') AS hits, string_split_regex(t, '{_ABBREVIATION}') AS gaps FROM {_MADE}),
        p AS (SELECT *, unnest(range(len(hits))) AS pos FROM h), a AS (SELECT row_no, t, pos, hits[pos + 1] AS hit, (coalesce(list_sum(list_transform(gaps[1:pos + 1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hits[1:pos], lambda x: length(x))), 0))::BIGINT AS place FROM p)
        SELECT row_no, pos::INTEGER AS pos, regexp_extract(hit, '{_ABBREVIATION}', 2) AS abbreviation, {_COLLAPSE("substr(t, greatest(place - 60, 0) + 1, least(length(t), place + length(hit) + 60) - greatest(place - 60, 0))")} AS context FROM a"""
)
def abbreviation_context(spark, sf):
    """The text around every abbreviation in brackets."""
    made = F.concat(F.lit("Seen  for "), "description", F.lit(" (ABC) and\nthen "), "description", F.lit(" (XY) today."))
    rows = table(spark, sf, "icd10_nodes").filter("description is not null").select("row_no", made.alias("t"))
    return candidates.abbreviations(rows, "row_no", "t").select("row_no", "pos", "abbreviation", "context")


@query("SELECT filename, coalesce(len(allergies), 0)::INTEGER + 1 AS n_parts, doc_label AS last_part FROM medical_documents WHERE doc_label IS NOT NULL UNION ALL SELECT filename, len(allergies)::INTEGER, allergies[-1] FROM medical_documents WHERE doc_label IS NULL")
def documents_with_parts(spark, sf):
    """A part added to the list that each document has."""
    parts = documents.with_part(F.col("allergies"), F.col("doc_label"))
    return table(spark, sf, "medical_documents").select("filename", F.when(parts.isNotNull(), F.size(parts)).alias("n_parts"), F.when(F.size(parts) > 0, F.element_at(parts, -1)).alias("last_part"))


@query(
    f"""WITH v AS {catalogue._VOCABULARY}, d AS (SELECT filename, text FROM {_TEXTS}), k AS (SELECT DISTINCT lower(unnest([{_STRIP('preferred_terms')}])) AS term FROM v WHERE {_STRIP('preferred_terms')} <> ''),
        c AS (SELECT filename, u AS candidate_term, pos FROM (SELECT filename, unnest(t) AS u, unnest(range(len(t))) AS pos FROM (SELECT filename, regexp_extract_all(text, '{_TOKEN}') AS t FROM d)) QUALIFY row_number() OVER (PARTITION BY filename, lower(u) ORDER BY pos) = 1),
        top AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY filename ORDER BY pos) <= 100), ok AS (SELECT * FROM top WHERE lower(candidate_term) NOT IN (SELECT term FROM k)),
        best AS ({catalogue._bm25_sql("SELECT DISTINCT lower(candidate_term) AS query_id, lower(candidate_term) AS query FROM ok", 1)})
        SELECT filename AS doc_id, candidate_term, coalesce(key, '') AS mesh_ui_suggested, coalesce(score, 0.0) AS score FROM ok LEFT JOIN best ON query_id = lower(candidate_term)"""
)
def expand_rows(spark, sf):
    """Rows for validation of the candidate terms of documents, with the best entry of a search."""
    docs = candidates.first_wins(table(spark, sf, "medical_documents").filter("filename is not null and raw_text is not null"), "filename", "raw_text").select(F.col("filename").alias("doc_id"), F.col("raw_text").alias("text"))
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(F.col(c)))
    vocabulary = catalogue._vocabulary(spark, sf).select("line_no", "ui", one("preferred_terms").alias("preferred_terms"), F.lit(None).cast("array<string>").alias("synonyms"), F.concat_ws(" ", "synonyms", "scope_note").alias("scope_note"))
    rows = apps.expand_vocabulary(docs, vocabulary).filter("candidate_type = 'candidate_term'")
    return rows.select("doc_id", "candidate_term", "mesh_ui_suggested", "score")


_TAKEN = f"(SELECT doc_id, t, w, g, unnest(range(0, (greatest(0, ceil((len(w) - 220) / 160.0)) * 160)::BIGINT + 1, 160)) AS first FROM (SELECT doc_id, t, {_WORDS('t')} AS w, string_split_regex(t, '{_W}+') AS g FROM (SELECT doc_id, {_COLLAPSE('text')} AS t FROM documents)) WHERE len(w) > 0)"
_CHARS = lambda parts, n: f"coalesce(list_sum(list_transform({parts}[1:{n}], lambda x: length(x))), 0)"


@query(
    f"""WITH s AS (SELECT doc_id, t, first, ({_CHARS('g', 'first + 1')} + {_CHARS('w', 'first')})::INTEGER AS a, ({_CHARS('g', 'least(first + 220, len(w))')} + {_CHARS('w', 'least(first + 220, len(w))')})::INTEGER AS b FROM {_TAKEN})
        SELECT doc_id, format('seg_{{:04d}}', row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1) AS segment_id, a AS start_char, b AS end_char, md5(substr(t, a + 1, b - a)) AS digest FROM s WHERE b - a >= 50"""
)
def segment_text_spans(spark, sf):
    return segments.segment_texts(table(spark, sf, "documents"), "doc_id", "text").select("doc_id", "segment_id", "start_char", "end_char", F.md5("segment").alias("digest"))


# ---- rules

_ONE = lambda *rules: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN NOT coalesce({ok}, false) THEN '{name}' END" for name, ok in rules) + "], lambda x: x IS NOT NULL), ',')"
_FIELD = lambda name, kind="VARCHAR": f"TRY_CAST(e->>'{name}' AS {kind})"
_IN = lambda values: "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _entity_rules(free: bool) -> str:
    time = " ".join(f"WHEN e->>'label' = '{k}' THEN coalesce(e->>'temporality' IN {_IN(v)}, false)" for k, v in schemas.TEMPORALITIES.items())
    time = f"(CASE {time} ELSE e->>'temporality' IS NULL END)" + (" OR e->>'temporality' IS NULL" if free else "")
    source = f"CASE WHEN e->>'source' IN {_IN(schemas.PROVENANCES)} THEN e->>'source' ELSE 'manual' END"
    return _ONE(
        ("id", "regexp_matches(e->>'id', '^ent_[0-9]{6}$')"), ("text", f"regexp_replace(coalesce(e->>'text', ''), '{_S}+', '', 'g') <> ''"), ("span", f"{_FIELD('start', 'INTEGER')} >= 0 AND {_FIELD('start', 'INTEGER')} < {_FIELD('end', 'INTEGER')}"),
        ("label", f"e->>'label' IN {_IN(schemas.ENTITY_LABELS)}"), ("dictionary", f"coalesce(e->>'dictionary', 'mesh') IN {_IN(schemas.DICTIONARIES)}"), ("negation", "true"), ("temporality", time),
        ("confidence", f"{_FIELD('confidence', 'DOUBLE')} IS NULL OR {_FIELD('confidence', 'DOUBLE')} BETWEEN 0 AND 1"), ("source", "true"),
        ("concept", f"{source} NOT IN ('mesh_auto', 'dict_auto') OR (coalesce(e->>'concept_id', '') <> '' AND coalesce(e->>'concept_name', '') <> '')"),
    )


@query(f"SELECT record_id, e->>'id' AS id, {_entity_rules(False)} AS errors FROM (SELECT record_id, unnest(TRY_CAST(entities AS JSON[])) AS e FROM records)")
def validate_entities(spark, sf):
    rows = table(spark, sf, "records").select("record_id", F.explode(validation.parse_entities(F.col("entities"))).alias("e"))
    return rows.select("record_id", F.col("e.id").alias("id"), F.array_join(validation.entity_errors(F.col("e")), ",").alias("errors"))


_HAS = lambda c: f"regexp_replace(coalesce({c}, ''), '{_S}+', '', 'g') <> ''"


@query(
    f"""SELECT record_id, {_ONE(("record_id", "regexp_matches(record_id, '^[A-Za-z0-9_.:-]{1,128}$')"), ("patient_id", "regexp_matches(patient_id, '^[A-Za-z0-9_.:-]{1,128}$')"), ("name_document", _HAS("name_document")), ("type_document", _HAS("type_document")), ("text", _HAS('"text"')),
        ("too_many_entities", "len(es) <= 300"), ("entity", f"len(list_filter(es, lambda e: {_entity_rules(True)} <> '')) = 0"), ("entity_ids", "len(list_distinct(list_transform(es, lambda e: coalesce(e->>'id', '-')))) = len(es)"),
        ("bounds", "len(list_filter(es, lambda e: NOT coalesce(TRY_CAST(e->>'end' AS INTEGER) <= length(text), false))) = 0"))} AS errors
        FROM (SELECT *, coalesce(TRY_CAST(entities AS JSON[]), []) AS es FROM records)"""
)
def validate_records(spark, sf):
    rows = table(spark, sf, "records").withColumn("entities", validation.parse_entities(F.col("entities")))
    return rows.select("record_id", F.array_join(validation.record_errors(F.col("entities")), ",").alias("errors"))


# ---- lookups

@query(_TREE + "SELECT code, EXISTS (SELECT 1 FROM tree p WHERE p.parent = t.code) AS has_children, (SELECT count(*) FROM tree) AS n_codes FROM tree t WHERE code LIKE 'A%'")
def taxonomy_get(spark, sf):
    """Lookups of codes: whether a node is there, whether it has children, and how many nodes there are."""
    tree = catalogue._tree(spark, sf)
    wanted = tree.filter(F.col("code").startswith("A")).select("code")
    return taxonomy.get(tree, wanted).crossJoin(F.broadcast(taxonomy.size(tree))).select("code", "has_children", "n_codes")
