import random
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from medloom.operators import packed
from medloom.operators.packed import BAD_LIST, OPEN_QUOTE, explode_packed, parse_cell


@pytest.mark.parametrize(
    "cell, kind, items",
    [
        (None, "terms", []),
        ("", "terms", []),
        ("  \t ", "terms", []),
        ("a | b|c ", "terms", ["a", "b", "c"]),
        ("|a||b|", "terms", ["a", "b"]),
        ("a, b", "terms", ["a", "b"]),
        ("a, b; c", "terms", ["a, b", "c"]),
        ('"a, b",c,"d; e"', "terms", ["a, b", "c", "d; e"]),
        ('"a | b"; c', "terms", ["a | b", "c"]),
        ('"x ""wet"" y"\tz', "terms", ['x "wet" y', "z"]),
        ('["a", "b \\"q\\" c", "d\\u00e9"]', "terms", ["a", 'b "q" c', "dé"]),
        ("[]", "terms", []),
        ("o'x/y-z_w", "terms", ["o'x/y-z_w"]),
        ("#crh##cro #cra ", "tags", ["crh", "cro", "cra"]),
        ('["crh","ordonnance medicaments"]', "tags", ["crh", "ordonnance medicaments"]),
        ("A01.1  B02.3 ,C03;d04", "tree_numbers", ["A01.1", "B02.3", "C03", "d04"]),
    ],
)
def test_items_in_order(cell, kind, items):
    parsed = parse_cell(cell, kind)
    assert [x[1] for x in parsed] == items
    assert [x[0] for x in parsed] == list(range(len(items)))


def test_malformed_parts_are_flagged_and_kept_as_written():
    assert parse_cell('"open | b') == [(0, '"open', OPEN_QUOTE), (1, "b", "ok")]
    assert parse_cell('["a", | b')[0][2] == BAD_LIST


@given(st.lists(st.text(alphabet='ab |;,"\t\'', min_size=1).filter(lambda x: x.strip()), min_size=1, max_size=5))
def test_quoted_values_survive(values):
    cell = " ; ".join('"' + v.replace('"', '""') + '"' for v in values)
    assert [x[1] for x in parse_cell(cell)] == [v.strip() for v in values]


@given(st.text(max_size=60))
def test_anything_parses(cell):
    for kind in ("terms", "tags", "tree_numbers"):
        assert all(item == item.strip() and item for _, item, _ in parse_cell(cell, kind))


def test_rows_keep_repeats_nulls_and_foreign_columns(spark):
    df = spark.createDataFrame([(1, "a|b", "x"), (1, "a|b", "x"), (2, None, "y"), (3, " ", None)], "n long, cell string, item string")
    got = explode_packed(df, "n", {"cell": "terms"}, "t").orderBy("row_no", "pos").collect()
    assert [(r.row_no, r.pos, r["item"]) for r in got] == [(1, 0, "a"), (1, 0, "a"), (1, 1, "b"), (1, 1, "b")]
    assert explode_packed(df.limit(0), "n", {"cell": "terms"}, "t").count() == 0


def test_quotes_close_as_an_expression_says():
    rng = random.Random(8)
    quoted = re.compile(r'"((?:[^"]|"")*)"')
    for _ in range(3000):
        cell = "".join(rng.choice('"" ab,') for _ in range(rng.randrange(1, 14)))
        quotes = packed.Quotes(cell)
        for at, c in enumerate(cell):
            if c == '"':
                m = quoted.match(cell, at)
                assert quotes.close(at) == (m.end() if m else None), (cell, at)


def test_long_malformed_cells():
    """Hundreds of thousands of open quotes and brackets are read in a moment and leave the text as written."""
    for cell in ('a "b ' * 60_000, "[" * 100_000, '"a"b ' * 60_000, '"' * 100_001):
        assert "".join(i for _, i, _ in packed.parse_cell(cell)).replace(" ", "")
