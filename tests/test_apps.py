import pytest
from pyspark.sql import functions as F

from medloom import __main__ as cli
from medloom import schemas
from medloom.operators import ml
from medloom.plans import apps
from medloom.sources import readers, writers
from tests.test_sources import put


def test_annotate(spark, tmp_path):
    put(f"{tmp_path}/t/doc1.txt", "Patient denies asthma")
    dictionary = spark.createDataFrame([("Asthma", "D1", "Asthma", "mesh", "DISEASE")], schemas.DICTIONARY)
    got = apps.annotate(spark, dictionary, texts=f"{tmp_path}/t", out=f"{tmp_path}/out").first()
    assert got.record_id == "doc1" and got.entities[0]["negation"] == "negated"
    assert readers.csv(spark, f"{tmp_path}/out", schemas.RECORD).first().name_document == "doc1.txt"
    with pytest.raises(ValueError):
        apps.annotate(spark, dictionary)


def test_label_documents(spark, tmp_path):
    long = "operation incision suture bloc " * 10
    docs = spark.createDataFrame([("a.txt", long), ("b.txt", "potassium sodium glucose level " * 10)], "name string, text string")
    manifest = spark.createDataFrame([("a.txt", "cro"), ("b.txt", "analyse_labo"), ("gone.txt", "crh")], "filename string, label string")
    new = spark.createDataFrame([("n.txt", long)], "name string, text string")
    got = apps.label_documents(docs, manifest, new)
    assert {r["label"]: r.predicted for r in got.collect()}["cro"] and got.count() == len(schemas.DOCUMENT_LABELS)
    apps.export_labels(got, f"{tmp_path}/labels")
    shown = spark.read.csv(f"{tmp_path}/labels", header=True, sep=";").first()
    assert shown["cro_evidence"].startswith("a.txt | 1.0 | operation") and len(shown["cro_evidence"]) == 250 and shown["crh_evidence"] is None
    described = apps.describe(docs, manifest)
    assert described["summary"].first().n_files == 2 and described["labels"].count() == 3


def test_codes(spark, tmp_path):
    for i in range(12):
        sick = "fever cough" if i % 2 else "broken bone"
        put(f"{tmp_path}/docs/ADM{i}/#crh_x.txt", f"{sick} patient {i}")
        put(f"{tmp_path}/rss/f{i}.rss", " " * 47 + f"ADM{i}".ljust(20) + " " * 73 + ("J10" if i % 2 else "S42").ljust(8))
    clinical = apps.clinical_table(spark, f"{tmp_path}/rss", f"{tmp_path}/docs")
    assert clinical.count() == 12
    table, missing = apps.training_table(clinical)
    assert table.count() == 12 and missing == {"no_label": 0, "no_text": 0}
    trained = apps.train_codes(table, settings=ml.Features(min_df=1, max_df=1.0), maxIter=20)
    assert 0 <= trained.measures["accuracy"] <= 1
    got = apps.predict_batch(trained.model, spark.createDataFrame([("cough and fever",), (" ",)], "text string"), 2).collect()
    assert len(got) == 1 and got[0].predictions[0]["label"] == "J10"
    with pytest.raises(ValueError):
        apps.predict_batch(trained.model, table, 21)


def test_expand(spark):
    vocabulary = spark.createDataFrame([(1, "D2", ["Hypertension"], ["High Blood Pressure"], ["C14"], "Pressure.", "x")], "line_no int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.VOCABULARY))
    docs = spark.createDataFrame([("d", "hypertension artérielle (HTA) with pressure")], "doc_id string, text string")
    got = {(r.candidate_term, r.candidate_type): r.mesh_ui_suggested for r in apps.expand_vocabulary(docs, vocabulary).collect()}
    rows = apps.expand_vocabulary(docs, vocabulary, embedded=spark.createDataFrame([("D9", [1.0] * 256)], "entry_id string, vector array<float>")).collect()
    assert {r.context_snippet for r in rows if r.candidate_type != "candidate_term"} == {"hypertension artérielle (HTA) with pressure"}
    assert all(r.comment.startswith("vector_ui=D9 ") for r in rows if r.candidate_type == "candidate_term")
    assert got[("HTA", "abbreviation")] == "" and got[("pressure", "candidate_term")] == "D2" and ("hypertension", "candidate_term") not in got


def test_command_line(capsys):
    assert cli.main(["list"]) == 0 and "candidate_terms" in capsys.readouterr().out


def test_commands(spark, capsys, tmp_path):
    put(f"{tmp_path}/x/desc2025.xml", "<S><DescriptorRecord><DescriptorUI>D1</DescriptorUI><DescriptorName><String>Hypertension</String></DescriptorName><TreeNumberList><TreeNumber>C14.9</TreeNumber></TreeNumberList></DescriptorRecord></S>")
    put(f"{tmp_path}/t/doc.txt", "High pressure, hypertension artérielle (HTA) here")
    at = lambda *names: [f"{tmp_path}/{n}" for n in names]
    run = lambda *args: cli.main(["--master", "local[4]", *args])
    assert run("parse", *at("x", "v")) == 0 and run("index", *at("v", "i")) == 0 and run("embed", *at("v", "e")) == 0
    assert spark.read.parquet(f"{tmp_path}/e").first().entry_id == "D1"
    for command in (["search", at("i")[0], "hypertension"], ["search", at("v")[0], "hypertension"], ["lookup", at("v")[0], "D1"], ["browse", at("v")[0], "c14"]):
        assert run(*command) == 0 and "D1" in capsys.readouterr().out
    assert run("expand", *at("t", "v", "rows")) == 0
    rows = readers.candidates(spark, f"{tmp_path}/rows").withColumn("human_validation", F.lit("accepted"))
    writers.candidates_csv(rows, f"{tmp_path}/done")
    assert run("extend", *at("done", "out")) == 0
    assert f'"n_accepted":{rows.count()}' in open(f"{tmp_path}/out/counts.json").read()
    spark.createDataFrame([("fever cough", "J10"), ("broken bone", "S42")] * 6, "text string, label string").write.parquet(f"{tmp_path}/table")
    assert run("train", *at("table", "model"), "--kind", "bayes") == 0 and run("predict", *at("model", "table", "p"), "--top", "1") == 0
    assert {r.predictions[0].label for r in spark.read.json(f"{tmp_path}/p").filter("text like 'fever%'").collect()} == {"J10"}
    assert run("train", *at("table", "m2"), "--kind", "none") == 1 and "unknown classifier" in capsys.readouterr().err
