import os

import pytest
from pyspark.sql import functions as F

from medloom import schemas
from medloom.sources import readers, writers
from medloom.streaming import stateless


def put(path, text, mode="w"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode, **({} if "b" in mode else {"encoding": "utf-8"})) as file:
        file.write(text)


def test_texts(spark, tmp_path):
    put(f"{tmp_path}/b/#crh#x_doc 1+.TXT", "Patient denies\nasthma")
    put(f"{tmp_path}/a.txt", b"ok \xff", "wb")
    put(f"{tmp_path}/no.pdf", "x")
    rows = readers.texts(spark, str(tmp_path), recursive=True).orderBy("name").collect()
    assert [r.name for r in rows] == ["#crh#x_doc 1+.TXT", "a.txt"] and rows[1].text == "ok �"
    assert readers.texts(spark, str(tmp_path), bad_bytes="ignore").first().text == "ok "
    assert readers.text_records(spark, str(tmp_path), 1).count() == 1
    docs = readers.admission_documents(spark, str(tmp_path)).filter("admission_id = 'b'").first()
    assert docs.document_types == ["crh", "x"] and docs.text_content == "Patient denies asthma"
    with pytest.raises(readers.MissingData):
        readers.texts(spark, f"{tmp_path}/none")
    assert len(readers.checksums(spark, f"{tmp_path}/a.txt").first().sha256) == 64


def test_records_round_trip(spark, tmp_path):
    entity = {"id": "ent_000001", "text": "a", "start": 0, "end": 1, "label": "TEST", "concept_id": None, "concept_name": None, "dictionary": "mesh", "negation": "unknown", "temporality": None, "confidence": None, "source": "manual", "meta": {"k": "v"}}
    rows = [("r1", "p", 'say "hi", you', "t", "2021-01-01", "two\nlines", [entity]), ("r2", "p", "n", "t", None, "x", [])]
    df = spark.createDataFrame(rows, f"record_id string, patient_id string, name_document string, type_document string, date_document string, text string, entities array<{schemas.ENTITY.simpleString()}>")
    writers.records_csv(df.coalesce(1), f"{tmp_path}/out")
    back = readers.csv(spark, f"{tmp_path}/out", schemas.RECORD).orderBy("record_id").collect()
    assert back[0].name_document == 'say "hi", you' and back[0].text == "two\nlines" and back[1].entities == "[]"
    writers.csv(df.limit(0), f"{tmp_path}/empty", one_file=True)
    writers.json_lines(df, f"{tmp_path}/json")
    assert readers.json_lines(spark, f"{tmp_path}/json", df.schema).count() == 2


def test_fixed_width_codes_manifest(spark, tmp_path):
    put(f"{tmp_path}/rss/a.rss.txt", " " * 47 + "ADM7\n\n" + " " * 47 + "ADM8")
    assert sorted(r.admission_id for r in readers.admission_lines(spark, f"{tmp_path}/rss").collect()) == ["ADM7", "ADM8"]
    put(f"{tmp_path}/codes.csv", "code,description\n001,first\n")
    assert readers.codes(spark, f"{tmp_path}/codes.csv").first().code == "001"
    put(f"{tmp_path}/m.json", '{"f1.txt": ["crh ", "none"], "f2.txt": "crh", "f3.txt": []}')
    assert [tuple(r) for r in readers.manifest(spark, f"{tmp_path}/m.json").collect()] == [("f1.txt", "crh")]


XML = """<Set><DescriptorRecord><DescriptorUI>D1</DescriptorUI><DescriptorName><String> Hypertension </String></DescriptorName>
<TreeNumberList><TreeNumber>C14.1</TreeNumber></TreeNumberList><ConceptList><Concept><ScopeNote>High.</ScopeNote><TermList><Term><String>hypertension</String></Term>
<Term><String>HTN</String></Term><Term><String>htn</String></Term></TermList></Concept></ConceptList></DescriptorRecord><DescriptorRecord><DescriptorUI> </DescriptorUI></DescriptorRecord></Set>"""


def test_xml_and_embeddings(spark, tmp_path):
    put(f"{tmp_path}/v.xml", XML)
    rows = readers.vocabulary_xml(spark, f"{tmp_path}/v.xml")
    got = rows.collect()
    assert len(got) == 1 and got[0].preferred_terms == ["Hypertension"] and got[0].synonyms == ["HTN"] and got[0].tree_numbers == ["C14.1"] and got[0].scope_note == "High."
    assert readers.embedding_texts(rows).first().text == "Hypertension | HTN"
    vectors = spark.createDataFrame([("D1", [1.0, 2.0])], "ui string, vector array<float>")
    writers.embeddings_wide(vectors, 2, f"{tmp_path}/wide")
    assert list(readers.embeddings(spark, f"{tmp_path}/wide").first().vector) == [1.0, 2.0]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "write to a@b.test now"), (2, None)], "k int, t string")
    rows.write.parquet(f"{tmp_path}/in")
    stream = stateless.parquet_stream(spark, f"{tmp_path}/in", rows)
    stateless.run_to_end(stateless.masked(stream, "t"), f"{tmp_path}/out", f"{tmp_path}/check")
    assert {r.k: r.t for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {1: "write to <email> now".replace("<email>", "<EMAIL>"), 2: None}
    stateless.run_to_end(stateless.candidates(stateless.parquet_stream(spark, f"{tmp_path}/in", rows), "k", "t"), f"{tmp_path}/out2", f"{tmp_path}/check2")
    assert spark.read.parquet(f"{tmp_path}/out2").select(F.count("*")).first()[0] == 2


def test_small_files(spark, tmp_path):
    df = spark.createDataFrame([(0.5, None, " a|b ")], "accuracy double, note string, name string")
    writers.json_object(df, f"{tmp_path}/m.json")
    assert readers.json_object(spark, f"{tmp_path}/m.json", df.schema).first() == df.first()
    writers.markdown(df, "Report", f"{tmp_path}/m.md")
    assert open(f"{tmp_path}/m.md").read().splitlines()[0::4] == ["# Report", "| 0.5 |  |  a\\|b  |"]
    digest = writers.checksum_file(spark, f"{tmp_path}/m.json")
    assert open(f"{tmp_path}/m.json.sha256").read() == f"{digest}  m.json\n"
    writers.csv(df, f"{tmp_path}/c")
    assert spark.read.csv(f"{tmp_path}/c", header=True).first()["name"] == " a|b "
    put(f"{tmp_path}/x/desc2024.xml", "")
    put(f"{tmp_path}/x/desc2025.xml", "")
    assert readers.descriptor_file(f"{tmp_path}/x").endswith("desc2025.xml")
    with pytest.raises(readers.MissingData):
        readers.descriptor_file(str(tmp_path))
