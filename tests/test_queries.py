"""Queries against their SQL on the smallest tables, and the shape of plans."""

import glob
import hashlib
import math
import os
import re
from collections import Counter

import duckdb
import pytest
from pyspark.ml.feature import HashingTF

import __spark_entry__ as entry
from medloom.functions import text as T
from medloom.plans import catalogue, composed, general
from medloom.runtime import default_data

DATA = default_data()
SQL = catalogue.SQL | general.SQL | composed.SQL
QUERIES = catalogue.QUERIES | general.QUERIES | composed.QUERIES
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "-"
    return repr(round(v, 5) + 0.0) if isinstance(v, float) else str(v)


def agree(df, cursor):
    names = [x[0] for x in cursor.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    ours = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in cursor.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(SQL))
def test_like_sql(spark, duck, name):
    agree(QUERIES[name](spark, DATA), duck.execute(SQL[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    assert rows and len(rows[0]) == len(df.columns)


def test_packed_values_of_plain_cells(spark):
    """p3 against a plain division, for the cells that have one divider and no quotes or brackets."""
    rows = [(r.line_no, r.synonyms) for r in spark.read.parquet(f"{DATA}/mesh.parquet").select("line_no", "synonyms").collect()]
    rows = [(n, s) for n, s in rows if s and re.fullmatch(r"[^\"\[\],;#\n\t]*(\|[^\"\[\],;#\n\t]*)+", s)]
    wanted = sorted((n, i, x) for n, s in rows for i, x in enumerate(x.strip() for x in s.split("|") if x.strip()))
    got = QUERIES["p3_found"](spark, DATA).filter("tbl = 'mesh' and field_name = 'synonyms'").collect()
    assert wanted and sorted((r.row_no, r.pos, r["item"]) for r in got if r.row_no in {n for n, _ in rows}) == wanted


def test_hashed_features_like_sparks_hash(spark):
    rows = catalogue._labelled_texts(spark, DATA).collect()
    hashing = HashingTF(numFeatures=1 << 20, inputCol="t", outputCol="f")
    wanted = {}
    for r in rows:
        words = re.findall(r"\b\w\w+\b", r.text)
        counts = Counter(hashing.indexOf(t) for t in words + [" ".join(p) for p in zip(words, words[1:])])
        length = math.sqrt(sum(n * n for n in counts.values()))
        wanted |= {(r.filename, place): n / length for place, n in counts.items()}
    got = {(r.filename, r.place): r.weight for r in QUERIES["hashing_features"](spark, DATA).collect()}
    assert got == pytest.approx(wanted, abs=1e-6)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan(df):
    return df._jdf.queryExecution().toString()


def test_plans(spark):
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan(QUERIES["candidate_terms"](spark, DATA))
    for name in ("candidate_terms", "segment_windows", "mask_pii", "normalize_spaces", "tokenize_words", "judge_baseline"):
        assert "Python" not in plan(QUERIES[name](spark, DATA))
    assert "Exchange" not in plan(QUERIES["candidate_terms"](spark, DATA))
    assert "WindowGroupLimit" in plan(QUERIES["upsert_last_wins"](spark, DATA))


def test_masks_of_every_text(spark, tmp_path):
    """Against Python's own expressions, whose word boundaries are Unicode's; accented texts aren't left out."""
    odd = ["Réveillé, tél. 0536 49 87 36 à rappeler", "é0536 49 87 36 et 0536 49 87 36é", "écrire à jean.dupré@x.test ou a@b.test", "é 0536 49 87 36", "０５ 36 49 87 36", "plain 0536 49 87 36, a@b.test", "", None]
    spark.createDataFrame(list(enumerate(odd)), "row_id bigint, text_content string").write.parquet(f"{tmp_path}/clinical_records.parquet")
    mask = lambda pattern, by, t: None if t is None else hashlib.md5(re.sub(pattern, by, t).encode()).hexdigest()
    for folder in (str(tmp_path), DATA):
        rows = spark.read.parquet(f"{folder}/clinical_records.parquet").select("row_id", "text_content").collect()
        wanted = [(r.row_id, mask(T.EMAIL, "<EMAIL>", r.text_content), mask(T.PHONE, "<PHONE>", r.text_content)) for r in rows]
        got = [tuple(r) for r in QUERIES["mask_pii"](spark, folder).collect()]
        assert sorted(got, key=str) == sorted(wanted, key=str)


def test_every_vector_can_be_found(spark):
    ids = {r.vec_id for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id").collect()}
    got = QUERIES["cosine_topk_all"](spark, DATA).collect()
    assert {r.query_id for r in got} == ids and len(got) == 5 * len(ids) and all(r.query_id != r.entry_id for r in got)
    assert any(r.entry_id % 5 == 0 for r in got)


def test_training_query_has_the_defaults(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(catalogue.ml, "train", lambda df, *given, **options: seen.append((given, options)))
    monkeypatch.setattr(catalogue.ml, "predict", lambda model, df: df.withColumn("predicted_label", df.label))
    QUERIES["logreg_predict"](spark, DATA)
    assert seen == [(("logreg",), {})]
