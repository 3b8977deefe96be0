import pytest
from pyspark.sql import functions as F

from medloom.functions import text as T
from medloom.functions import values as V


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "f, given, wanted",
    [
        (T.collapse_spaces, "A   B\t\tC\n\nD", "A B C D"),
        (T.collapse_spaces, " a b ", "a b"),
        (T.collapse_spaces, None, None),
        (lambda c: T.normalise(c, accents=False), "  Héllo   World  ", "hello world"),
        (lambda c: T.clean_document(c, True), "a\r\n\r\n\r\n\r\nb \t c", "a\n\nb c"),
        (T.clean_document, "a\x07b\x00c", "a b c"),
        (T.mask_numbers, "dose 500 mg x2 7é", "dose <NUM> mg x2 7é"),
        (T.mask_emails, "write a.b@c.test now", "write <EMAIL> now"),
        (T.mask_phones, "call 0536 49 87 36", "call <PHONE>"),
        (T.tokens, " a b  c ", ["a", "b", "c"]),
        (T.words, "CRH: Patient Jean Dupont, 42 ans.", ["CRH", "Patient", "Jean", "Dupont", "42", "ans"]),
        (T.file_tags, "#CRH#analyse labo_x_y.txt", ["crh", "analyse-labo"]),
        (T.file_base, "#crh_x_y.txt", "x_y.txt"),
        (T.single_line, "a\nb\r\nc ", "a b c"),
        (T.preprocess, "  \n ", None),
        (T.nfc, "é", "é"),
        (T.strip_accents, "Éàœç é", "Eaœc e"),
        (V.iso_date, "7/3/2021", "2021-03-07"),
        (V.iso_date, "2021.3.7", "2021-03-07"),
        (V.iso_date, "soon ", "soon"),
        (V.iso_date, " ", None),
        (V.associated_codes, "A01 b2 A01 C22x 9zz", ["A01", "C22x"]),
    ],
)
def test_text(spark, f, given, wanted):
    assert one(spark, given, f) == wanted


def test_context_and_fields(spark):
    df = spark.createDataFrame([("0123456789", 4, 6)], "t string, a int, b int")
    assert df.select(T.context(F.col("t"), F.col("a"), F.col("b"), 2)).first()[0] == "234567"
    assert df.select(T.context(F.col("t"), F.lit(-1), F.lit(-1))).first()[0] == ""
    assert df.select(T.fixed_field(F.col("t"), 8, 20)).first()[0] == "89"
    assert df.select(T.fixed_field(F.col("t"), 18, 20)).first()[0] == ""


def test_probabilities(spark):
    p = spark.createDataFrame([([0.1, 0.7, 0.2],), ([0.3, 0.3, 0.4],), ([],)], "p array<double>")
    top = [[x["label"] for x in r[0]] for r in p.select(V.top_labels(F.col("p"), ["A", "B", "C"], 2)).collect()]
    assert top == [["B", "C"], ["C", "B"], []]
    kept = [[x["label"] for x in r[0]] for r in p.select(V.above_thresholds(F.col("p"), ["A", "B", "C"], {"A": 0.1}, 0.3)).collect()]
    assert kept == [["B", "A"], ["C", "A", "B"], []]
    soft = p.select(V.softmax(F.col("p"))).first()[0]
    assert sum(soft) == pytest.approx(1.0) and soft[1] == max(soft)


def test_clean_map(spark):
    df = spark.sql("SELECT map(' a ', ' 1 ', 'a', '2', ' ', 'x') AS m")
    assert df.select(V.clean_map(F.col("m"))).first()[0] == {"a": "2"}
