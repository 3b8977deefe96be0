import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import WordLevel
from tokenizers.pre_tokenizers import Whitespace

from medloom import schemas
from medloom.operators import admissions, candidates, eda, encoders, entities, fulltext, metrics, ml, segments, validation, vectors


def test_segments(spark):
    df = spark.createDataFrame([(1, " ".join(f"mot{i}" for i in range(60))), (2, ""), (3, None)], "k int, t string")
    rows = segments.word_windows(df, "k", "t", 20, 10).orderBy("seq").collect()
    assert [r.start_token for r in rows] == [0, 10, 20, 30, 40] and {r.k for r in rows} == {1}
    spans = segments.segment_texts(df, "k", "t", 20, 10, 10, "t").orderBy("start_char").collect()
    text = df.first()["t"]
    assert len(spans) == 5 and all(text[r.start_char : r.end_char] == r.segment and r.segment_id.startswith("t_") for r in spans)
    with pytest.raises(ValueError):
        segments.word_windows(df, "k", "t", 10, 10)


def test_nearest(spark):
    index = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [2.0, 0.0]), (4, None), (5, [math.nan, 1.0])], "entry_id int, vector array<float>")
    query = spark.createDataFrame([(9, [1.0, 0.0])], "query_id int, vector array<float>")
    got = vectors.nearest(query, index, 2).orderBy("rank").collect()
    assert [(r.entry_id, r.score) for r in got] == [(3, 1.0), (1, 1.0)]
    assert vectors.nearest(query, index.limit(0), 2).count() == 0


def test_nearest_of_one_length(spark):
    index = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0, 0.0])], "entry_id int, vector array<float>").coalesce(1)
    for odd in ([1.0], [1.0, 0.0, 0.0]):
        for place in range(3):
            rows = [(7, [1.0, 0.0]), (8, [0.0, 1.0])]
            rows.insert(place, (9, odd))
            got = vectors.nearest(spark.createDataFrame(rows, "query_id int, vector array<float>").coalesce(1), index, 1).collect()
            assert sorted((r.query_id, r.entry_id, r.rank) for r in got) == [(7, 1, 1), (8, 2, 1)]
    assert [r.entry_id for r in vectors.nearest(spark.createDataFrame([(9, [1.0, 0.0, 0.0])], "query_id int, vector array<float>"), index, 1, width=3).collect()] == [3]


def test_labels_by_neighbours(spark):
    near = spark.createDataFrame([("f", 1, 10, 0.9, 1, "crh"), ("f", 2, 11, 0.9, 1, "crh"), ("f", 1, 12, 0.2, 2, "cro")], "doc string, query_id int, entry_id int, score double, rank int, label string")
    got = {r["label"]: r for r in vectors.label_by_neighbours(near, ["crh", "cro", "cra"], "doc", 0.55).collect()}
    assert got["crh"].predicted and got["crh"].evidence.entry_id == 10
    assert not got["cro"].predicted and got["cra"].score == 0.0
    wide = vectors.wide_predictions(vectors.label_by_neighbours(near, ["crh"], "doc", 0.55), "doc", ["crh"]).first()
    assert wide["crh_flag"] and wide["crh_score"] == 0.9


VOCABULARY = [
    (1, "D000001", ["Myocardial Infarction"], ["Heart Attack", "MI"], ["C14.280.647"], "An infarction of the myocardium."),
    (2, "D000002", ["Hypertension"], ["High Blood Pressure", "HTN"], ["C14.907.489"], "Persistently high arterial blood pressure."),
    (3, "D000003", ["Diabetes Mellitus"], ["Diabetes", "DM"], ["C19.246"], "A group of metabolic diseases."),
]


@pytest.fixture(scope="module")
def vocabulary(spark):
    return spark.createDataFrame(VOCABULARY, "line_no int, ui string, preferred_terms array<string>, synonyms array<string>, tree_numbers array<string>, scope_note string")


def test_search(spark, vocabulary):
    flat = vocabulary.withColumn("p", F.array_join("preferred_terms", " | ")).withColumn("s", F.array_join("synonyms", " | "))
    columns = ("ui", "p", "s", "scope_note")
    index = fulltext.postings(flat, "ui", *columns)
    queries = spark.createDataFrame([(1, "Hypertension"), (2, "hyper-tension"), (3, "blood high"), (4, " ")], "query_id int, query string")
    got = fulltext.bm25(index, queries, *fulltext.corpus_size(flat, *columns), 5).collect()
    assert {(r.query_id, r.key) for r in got} == {(1, "D000002"), (3, "D000002")} and all(r.score < 0 for r in got)
    assert [r.key for r in fulltext.boolean_search(index, "of THE infarction", 5).collect()] == ["D000001"]
    assert [r.ui for r in fulltext.browse(vocabulary, "tree_numbers", "c14", "ui", prefix=True).collect()] == ["D000001", "D000002"]
    assert fulltext.lookup(vocabulary, "ui", "D000001").first()["preferred_terms"] == ["Myocardial Infarction"]
    assert fulltext.substring_search(flat, "p", "DIAB", "ui").count() == 1


def test_dictionary_of_long_terms(spark):
    long = "acute respiratory distress syndrome of the very-low-birth newborn"
    dictionary = spark.createDataFrame([(long,), ("asthma",), ("x y z v w",)], "term string")
    docs = spark.createDataFrame([(1, f"Known {long.capitalize()}, no asthma; x y z v."), (2, None), (3, "")], "doc_id int, text string")
    got = entities.dictionary_matches(docs, dictionary, "doc_id", "text").collect()
    assert sorted((r.doc_id, r.start, r.term, r.surface) for r in got) == [(1, 6, long, long.capitalize()), (1, 6 + len(long) + 5, "asthma", "asthma")]
    assert entities.dictionary_matches(docs, dictionary.limit(0), "doc_id", "text").count() == 0


@pytest.mark.parametrize("most", [entities.TERMS, 3])
def test_dictionary_like_expressions(spark, most):
    """Terms of any signs against an expression for each, whether one automaton holds them all or several do."""
    rng = random.Random(4)
    terms = ["a", "a b", "(a)", "b-", "-b", "é", "a.b", "ab", "b a b", "++", "a  b", "É a", "(a", "b)"]
    texts = ["".join(rng.choice(["a", "b", "A", "É", " ", " ", "-", "(", ")", ".", "+", "_", "İ"]) for _ in range(60)) for _ in range(40)] + [None, "", " "]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id int, text string, term string")
    dictionary = spark.createDataFrame([(t, t.upper()) for t in terms] + [(" a ", "again"), (None, "none"), ("", "empty")], "term string, concept_id string")
    got = entities.dictionary_matches(docs, dictionary, "doc_id", "text", most).collect()
    wanted = []
    for i, text in enumerate(texts):
        for term in terms:
            for m in re.finditer(rf"\b{re.escape(term)}\b", text or "", re.I):
                wanted += [(i, term.lower(), m.start(), m.end(), m[0], "not_negated", name) for name in ([term.upper(), "again"] if term == "a" else [term.upper()])]
    assert sorted(tuple(r) for r in got) == sorted(wanted) and len(wanted) > 100


def test_dictionary(spark, vocabulary):
    terms = {r.term: r.ui for r in entities.label_dictionary(vocabulary).collect()}
    assert terms["htn"] == "D000002" and len(terms) == 9
    dictionary = entities.label_dictionary(vocabulary).withColumnRenamed("ui", "concept_id").withColumns({"concept_name": F.col("term"), "dictionary": F.lit("mesh"), "label": F.lit("DISEASE")})
    docs = spark.createDataFrame([("r1", "No history of hypertension. Chronic heart attack, not MI-like HTNs"), ("r2", None), ("r3", "")], "record_id string, text string")
    got = {r.record_id: r.entities for r in entities.annotate(docs, dictionary).collect()}
    assert [(e["text"], e["id"], e["negation"], e["temporality"]) for e in got["r1"]] == [
        ("hypertension", "ent_000000", "negated", "past"), ("heart attack", "ent_000001", "negated", "past"), ("MI", "ent_000002", "negated", "past"),
    ]
    assert all(docs.first()["text"][e["start"] : e["end"]] == e["text"] for e in got["r1"])
    assert got["r2"] == [] and got["r3"] == []


def test_negation_like_the_column(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice(["no", "not", "NO", "x", " ", " ", "\u00a0", "\n", "-", "deny", "without"]) for _ in range(50)) for _ in range(20)] + ["", "no"]
    rows = [(i, t, at) for i, t in enumerate(texts) for at in range(0, len(t), 3)]
    for window in (12, 2):
        df = spark.createDataFrame(rows, "i int, t string, at int")
        wanted = {(r.i, r.at): r.n for r in df.select("i", "at", entities.negation(F.col("t"), F.col("at"), window).alias("n")).collect()}
        assert {(i, at): entities.negations(t, [at], window)[0] for i, t, at in rows} == wanted and len(set(wanted.values())) == 2


def test_temporality_and_scores(spark):
    df = spark.createDataFrame([("chronic diabetes",), ("will come",), ("x",)], "t string")
    assert [r[0] for r in df.select(entities.temporality(F.col("t"))).collect()] == ["chronic", "future", None]
    assert [r[0] for r in df.select(entities.temporality_of(F.lit("DISEASE"), entities.temporality(F.col("t")))).collect()] == ["chronic", None, None]
    spans = "start int, end int, label string"
    gold, pred = spark.createDataFrame([(0, 1, "A"), (2, 3, "B")], spans), spark.createDataFrame([(0, 1, "A"), (5, 6, "A")], spans)
    r = entities.annotation_scores(gold, pred).first()
    assert (r.tp, r.fp, r.fn, r.f1) == (1, 1, 1, 0.5)
    assert entities.annotation_scores(gold.limit(0), pred.limit(0)).first().f1 == 0.0


def test_candidates(spark):
    df = spark.createDataFrame([(1, "Foie foie RATE pancréas l'été foie-gras"), (2, None), (3, "")], "doc_id int, t string")
    got = candidates.candidate_terms(df, "doc_id", "t", 3).orderBy("pos").collect()
    assert [(r.candidate_term, r.pos) for r in got] == [("Foie", 0), ("RATE", 2), ("pancréas", 3)]
    text = spark.createDataFrame([(1, "Le patient présente une hypertension artérielle (HTA) sévère.")], "doc_id int, t string")
    assert [(r.long_form, r.abbreviation) for r in candidates.abbreviations(text, "doc_id", "t", "hypertension").collect()] == [("hypertension artérielle", "HTA")]
    assert candidates.abbreviations(text, "doc_id", "t").count() == 1
    rows = candidates.candidate_rows(got and spark.createDataFrame([("d", "foie")], "doc_id string, candidate_term string"), "baseline_term")
    assert tuple(rows.columns) == schemas.CANDIDATE_COLUMNS and rows.first().score == 0.0


def test_judge(spark):
    pairs = [("Hypertension", "Hypertension", "accepted", 1.0), ("Hypertension", "Diabetes Mellitus", "rejected", 0.05), ("HTA", "Arterial Hypertension", "unsure", 0.55), ("", "x", "unsure", 0.0), (None, None, "unsure", 0.0), ("heart big attack", "heart attack", "unsure", 2 / 3)]
    df = spark.createDataFrame(pairs, "a string, b string, verdict string, score double")
    for r in df.select("verdict", "score", candidates.judge(F.col("a"), F.col("b")).alias("j")).collect():
        assert (r.j.verdict, round(r.j.score, 9)) == (r.verdict, round(r.score, 9))


def test_curation(spark):
    rows = spark.createDataFrame([("d", "t1", " Accepted", "D1", ""), ("d", "t2", "accepted", " ", "new"), ("d", " ", "accepted", None, None), ("d", "t4", "rejected", "D2", "")], "doc_id string, candidate_term string, human_validation string, human_target_mesh_ui string, human_new_entity_label string")
    mappings, new, counts = candidates.extended_vocabulary(rows)
    assert [r.mesh_ui for r in mappings.collect()] == ["D1"] and [r["label"] for r in new.collect()] == ["new"]
    assert tuple(counts.first()) == (3, 1, 1)


def entity(**change):
    base = {"id": "ent_000001", "text": "aspirin", "start": 0, "end": 7, "label": "MEDICATION", "concept_id": "D001241", "concept_name": "Aspirin", "dictionary": "mesh", "negation": "not_negated", "temporality": "current", "confidence": 0.9, "source": "mesh_auto", "meta": {}}
    return base | change


def test_validation(spark):
    cases = [(entity(), ""), (entity(id="bad_id"), "id"), (entity(label="DISEASE", temporality="future"), "temporality"), (entity(start=7), "span"), (entity(confidence=2.0), "confidence"), (entity(concept_id=None), "concept"), (entity(label="TEST", temporality=None), "")]
    df = spark.createDataFrame([(e, w) for e, w in cases], f"e {schemas.ENTITY.simpleString()}, w string")
    for r in df.select("w", F.array_join(validation.entity_errors(F.col("e")), ",").alias("got")).collect():
        assert r.got == r.w
    record = f"record_id string, patient_id string, name_document string, type_document string, text string, entities array<{schemas.ENTITY.simpleString()}>"
    rows = [("r", "p", "n", "t", "aspirin then flu", [entity(), entity()], "entity_ids"), ("r", "p", "n", "t", "aspirin", [entity(end=999)], "bounds"), ("r r", None, " ", "t", "x", None, "record_id,patient_id,name_document")]
    got = spark.createDataFrame(rows, record + ", w string").select("w", F.array_join(validation.record_errors(F.col("entities")), ",").alias("got")).collect()
    assert all(r.got == r.w for r in got)
    parsed = spark.createDataFrame([('[{"id": "a", "negation": "odd"}]',), ("[{",), (None,), ("{}",)], "j string").select(validation.parse_entities(F.col("j")).alias("e")).collect()
    assert [len(r.e) for r in parsed] == [1, 0, 0, 0] and parsed[0].e[0].negation == "unknown" and parsed[0].e[0].dictionary == "mesh"
    bad = spark.createDataFrame([(["x"],)], "errors array<string>")
    with pytest.raises(Exception, match="invalid row"):
        validation.strict(bad).collect()
    assert validation.strict(bad.select(F.array().cast("array<string>").alias("errors"))).count() == 1


def test_admissions(spark):
    line = " " * 47 + "ADM1".ljust(20) + " " * 73 + "A01".ljust(8) + " " * 44 + "B02 c9 B02 D33"
    got = admissions.parse_lines(spark.createDataFrame([(line,), ("  ",), ("short",)], "value string")).collect()
    assert [r.admission_id for r in got] == ["ADM1", ""]
    assert got[0].primary_diagnosis_code == "A01" and got[0].associated_diagnosis_codes == ["B02", "D33"] and got[0].sex is None
    docs = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "admission_id string, n int")
    stays = spark.createDataFrame([("a", 2, "late"), ("a", 1, "first"), (None, 1, "x")], "admission_id string, o int, s string")
    assert {r.n: r.s for r in admissions.join_documents(docs, stays, "o").collect()} == {1: "first", 2: None, 3: None}
    texts = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("a", 3, None)], "k string, o int, t string")
    assert admissions.joined_text(texts, "k", "t", "o").first().t == "x y"


def test_metrics(spark):
    perfect = spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "y_true int, y_pred int")
    assert tuple(metrics.accuracy_f1(perfect).first()) == (1.0, 1.0, 1.0)
    partial = spark.createDataFrame([(0, 0), (1, 2), (2, 2)], "y_true int, y_pred int")
    r = metrics.accuracy_f1(partial).first()
    assert r.accuracy == pytest.approx(2 / 3) and r.f1_macro == pytest.approx((1 + 0 + 2 / 3) / 3)
    assert metrics.report(partial).count() == 5
    matrix = {x.y_true: (x.pred_0, x.pred_1, x.pred_2) for x in metrics.confusion_matrix(partial, [0, 1, 2]).collect()}
    assert matrix == {0: (1, 0, 0), 1: (0, 0, 1), 2: (0, 0, 1)}
    pred = spark.createDataFrame([(1, "c", 0.8), (1, "d", 0.5)], "row_id int, code string, score double")
    tree = spark.createDataFrame([("c", "p"), ("d", "p"), ("p", None)], "code string, parent string")
    assert {x.code: round(x.score, 3) for x in metrics.with_parents(pred, tree).collect()} == {"c": 0.8, "d": 0.5, "p": 0.45}


def test_eda(spark):
    docs = spark.createDataFrame([("Scanner et IRM", ["a", "b"]), (None, None)], "t string, l array<string>")
    assert {r["label"]: r.n_docs for r in eda.keyword_hits(docs, "t", {"x": ("irm",), "y": ("zz",)}).collect()} == {"x": 1, "y": 0}
    assert {r.n_labels: r.n_docs for r in eda.labels_per_document(docs, "l").collect()} == {2: 1, 0: 1}
    assert eda.summary(docs.limit(0), "t", F.lit(0)).first().n_files == 0


def test_encoders(spark):
    df = spark.createDataFrame([("",), ("a  b",), ("a b",), (None,)], "t string")
    v = [r[0] for r in df.select(encoders.encode(F.col("t"))).collect()]
    assert len(v[0]) == encoders.DIMS and not any(v[0]) and v[1] == v[2] and not any(v[3])
    words = spark.createDataFrame([("test", [1.0] * 3)], "word string, vector array<float>")
    docs = spark.createDataFrame([(1, ""), (2, "test Test")], "k int, t string")
    assert {r.k: list(r.vector) for r in encoders.mean_of_words(docs, "k", "t", words, 3).collect()} == {1: [0.0] * 3, 2: [1.0] * 3}
    with pytest.raises(ValueError):
        encoders.encode(F.col("t"), "none")


def test_training(spark, tmp_path):
    rows = [("fever and cough today", "a"), ("cough with fever", "a"), ("broken arm bone", "b"), ("bone of the arm", "b"), ("skin rash red", "c"), ("red rash on skin", "c")]
    df = spark.createDataFrame(rows, "text string, label string")
    model = ml.train(df, settings=ml.Features(min_df=1, max_df=1.0, max_words=2), maxIter=20)
    out = ml.predict(model, df).collect()
    assert [r.predicted_label for r in out] == [r["label"] for r in out]
    assert all(len(r.probabilities) == 3 and sum(r.probabilities) == pytest.approx(1) for r in out) and ml.classes(model) == ["a", "b", "c"]
    assert len(ml.linear_features(model, 0, 3)) == 3
    ml.save(model, str(tmp_path / "m"))
    assert ml.predict(ml.load(str(tmp_path / "m")), df).first().predicted_label == "a"
    with pytest.raises(ValueError):
        ml.classifier("none")


def test_nearest_beside_and_in_blocks(spark):
    rng = random.Random(2)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(3)]) for i in range(60)]
    index = spark.createDataFrame(rows + [(99, None), (98, [1.0])], "entry_id int, vector array<float>")
    queries = spark.createDataFrame(rows[:20], "query_id int, vector array<float>")
    beside, blocks = ({(r.query_id, r["rank"]): (r.entry_id, r.score) for r in vectors.nearest(queries, index, 4, few=few).collect()} for few in (vectors.FEW, 0))
    assert beside == blocks and len(beside) == 80
    assert vectors.nearest(queries.limit(0), index).count() == vectors.nearest(queries, index.limit(0)).count() == 0


def test_stored_indexes(spark, vocabulary, tmp_path):
    flat = vocabulary.withColumn("p", F.array_join("preferred_terms", " | "))
    fulltext.StoredIndex.write(flat, "ui", "ui", "p", "scope_note", path=f"{tmp_path}/text")
    index = fulltext.StoredIndex.open(spark, f"{tmp_path}/text")
    asked = spark.createDataFrame([(1, "hypertension"), (2, "nothing here"), (3, None)], "query_id int, query string")
    assert [(r.query_id, r.key) for r in index.search(asked).collect()] == [(1, "D000002")]
    assert "In(term" in index.search(asked)._jdf.queryExecution().toString() or "EqualTo(term" in index.search(asked)._jdf.queryExecution().toString()
    vectors.write_index(spark.createDataFrame([(1, [3.0, 4.0]), (2, None)], "entry_id int, vector array<float>"), f"{tmp_path}/v")
    assert [list(r.vector) for r in vectors.open_index(spark, f"{tmp_path}/v").collect()] == [[0.6, 0.8]]


def test_detect(spark, vocabulary, tmp_path):
    flat = vocabulary.withColumn("p", F.array_join("preferred_terms", " | "))
    fulltext.StoredIndex.write(flat, "ui", "ui", "p", path=f"{tmp_path}/text")
    docs = spark.createDataFrame([("d", "Hypertension, infarction"), ("e", None), ("f", "")], "name string, text string")
    entries = entities.label_dictionary(vocabulary)
    got = {(r.name, r.ui, r.label, r.start, r.method) for r in entities.detect(docs, entries, "name", "text", fulltext.StoredIndex.open(spark, f"{tmp_path}/text")).collect()}
    assert got == {("d", "D000002", "hypertension", 0, "dict"), ("d", "D000002", "Hypertension", -1, "fts"), ("d", "D000001", "infarction", -1, "fts")}
    assert entities.detect(docs, entries, "name", "text").count() == 1


def test_labels_and_chains(spark):
    near = spark.createDataFrame([(7, 1, 10, 0.6, 1, "a"), (7, 1, 11, 0.4, 2, "b")], "doc int, query_id int, entry_id int, score double, rank int, label string")
    limits = spark.createDataFrame([(0, "a", 0.7), (1, "b", 0.3)], "pos int, label string, threshold double")
    assert {r.label: r.predicted for r in vectors.hybrid_labels(near, limits, "doc").collect()} == {"a": False, "b": True}
    second = spark.createDataFrame([(7, "a", 0.9), (8, "b", 0.1)], "doc int, label string, score double")
    assert {(r.doc, r.label): r.predicted for r in vectors.hybrid_labels(near, limits, "doc", similarity=False, classified=second).collect()} == {(7, "a"): True, (8, "b"): False}
    for bad in (lambda: vectors.hybrid_labels(near, limits, "doc", similarity=False), lambda: vectors.hybrid_labels(near, limits.limit(0), "doc"), lambda: vectors.hybrid_labels(near, limits.union(limits), "doc")):
        with pytest.raises(ValueError):
            bad()
    scores = spark.createDataFrame([(1, [0.2, 0.7, 0.1]), (2, []), (3, None)], "id int, p array<double>")
    parents = spark.createDataFrame([("y", "x"), ("x", None)], "code string, parent string")
    got = {(r.id, r.code, round(r.score, 6)) for r in metrics.postprocess(scores, "id", "p", ["x", "y", "z"], 1, parents=parents).collect()}
    assert got == {(1, "y", 0.7), (1, "x", 0.63)}
    assert {r.code for r in metrics.postprocess(scores, "id", "p", ["x", "y", "z"], thresholds={"x": 0.1, "y": 0.8, "z": 0.1}).collect()} == {"x", "z"}


def test_chunks_of_a_hot_key(spark):
    rows = [("hot" if i % 3 else "k%d" % i, i, "t%d" % i * (i % 4)) for i in range(60)] + [(None, 1, "x"), ("hot", 99, None)]
    df = spark.createDataFrame(rows, "key string, n int, text string")
    wanted = {}
    for key in {r[0] for r in rows}:
        at = 0
        for _, _, t in sorted(r for r in rows if r[0] == key and r[2] is not None):
            wanted.setdefault((key, at // 20), []).append(t)
            at += len(t) + 1
    got = {(r.key, r.chunk): r.text for r in admissions.text_chunks(df, "key", "text", "n", 20).collect()}
    assert got == {k: " ".join(v) for k, v in wanted.items()}
    with pytest.raises(ValueError):
        admissions.joined_text(df, "key", "text", "n", most=10)


def test_encoders_of_words_and_models(spark, tmp_path):
    assert encoders.mean_pool(np.array([[[1.0, 2.0], [3.0, 4.0]], [[5.0, 5.0], [1.0, 1.0]]]), np.array([[1, 1], [0, 0]])).tolist() == [[2.0, 3.0], [0.0, 0.0]]
    vocab = Tokenizer(WordLevel({"[UNK]": 0, "a": 1, "b": 2, "[PAD]": 3}, unk_token="[UNK]"))
    vocab.pre_tokenizer = Whitespace()
    vocab.save(f"{tmp_path}/tokenizer.json")

    class Session:
        def get_inputs(self):
            return [type("Input", (), {"name": n}) for n in ("input_ids", "attention_mask")]

        def run(self, _, given):
            assert set(given) == {"input_ids", "attention_mask"}
            return [np.stack([given["input_ids"], given["input_ids"] ** 2], axis=-1).astype(np.float32)]

    run = encoders.onnx_backend(str(tmp_path), open_session=lambda folder: Session())()
    assert run(["a b", "b"]).tolist() == [[1.5, 2.5], [2.0, 4.0]]
    texts = spark.createDataFrame([("a b zz",), ("",), (None,)], "t string")
    assert [r[0] for r in texts.select(encoders.tokenize(F.col("t"), "model", f"{tmp_path}/tokenizer.json")).collect()] == [["a", "b", "[UNK]"], [], []]
    assert [r[0] for r in texts.select(encoders.tokenize(F.col("t"))).collect()] == [["a", "b", "zz"], [], []]
    with pytest.raises(ValueError):
        encoders.tokenize(F.col("t"), "model")
    table = spark.createDataFrame([("<ab>", [1.0]), ("<ab", [3.0]), ("bcd", [5.0])], "word string, vector array<double>")
    docs = spark.createDataFrame([(1, "Ab abcd"), (2, "zz"), (3, None)], "id int, text string")
    got = {r.id: r.vector[0] for r in encoders.mean_of_subwords(docs, "id", "text", table, 1).collect()}
    assert got == {1: 3.0, 2: 0.0, 3: 0.0}
