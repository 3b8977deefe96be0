import glob
import os

import duckdb
import pytest

from medloom.llm import __main__ as cli
from medloom.llm import plans
from medloom.runtime import default_data

DATA = default_data()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
COLUMNS = {
    "p1_found": {"tbl": "string", "item_id": "string", "cut": "string"},
    "p2_found": {"patient_a": "string", "patient_b": "string"},
    "p5_found": {"ui_a": "string", "ui_b": "string"},
    "p6_found": {"tbl": "string", "row_key": "string", "kind": "string", "found_text": "string"},
    "p7_ids": {"doc_id": "bigint", "ids": "array<int>"},
    "p9_found": {"doc_id": "bigint"},
}


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_runs(spark, name):
    df = plans.QUERIES[name](spark, DATA)
    assert name not in COLUMNS or dict(df.dtypes) == COLUMNS[name]
    assert df.count() >= 0


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_like_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    cursor = con.execute(plans.SQL[name])
    names = [x[0] for x in cursor.description]
    df = plans.QUERIES[name](spark, DATA).select(*names)
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, cursor.fetchall()))


def test_components_are_counted_exactly(spark):
    wanted = {}
    for r in plans.p2_splits(spark, DATA).collect():
        rows, components = wanted.setdefault((r.tbl, r.split), ([], set()))
        rows.append(r.row_key)
        components.add(r.component)
    got = {(r.tbl, r.split): (r.n_rows, r.n_components) for r in plans.p2_shares(spark, DATA).collect()}
    assert got == {k: (len(rows), len(components)) for k, (rows, components) in wanted.items()}


def test_command_line(spark, capsys, tmp_path):
    assert cli.main([]) == 0 and "p7_ids" in capsys.readouterr().out
    assert cli.main(["--master", "local[4]", "p1_found", DATA, "--out", f"{tmp_path}/out"]) == 0
    assert spark.read.parquet(f"{tmp_path}/out").columns == ["tbl", "item_id", "cut"]
