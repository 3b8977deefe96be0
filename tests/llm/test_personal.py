import math

import pytest

from medloom.llm import personal

TEXTS = [
    "Le Dr Jeanne Valorne a revu le dossier. Mme Valorne, suivie en consultation.",
    "Dictated by Paul Merisot. Reviewed by Dr MERISOT Paul today. Next of kin: Valorne, Paul.",
    "Selon Jeanne Merisot les troubles datent de l'été. Signe de Tarvel négatif, maladie de Tarvel.",
    "Tableau de maladie de Tarvel typique. La plaie est propre. La tension est à 12/8. The wound was clean. The scar will fade.",
    "Unité Tarvel prévenue. Le patient est sorti. Le patient marche. La douleur est cotée à 3. The dressing was changed.",
    *["Jeanne Valorne a signé le refus.", "Paul Merisot a signé le refus.", "Merisot a signé le refus."] * 3,
]


@pytest.fixture(scope="module")
def judge():
    words, protected, positions = personal.count_words(TEXTS)
    disclosing = {w for w in words if protected[w] >= 2**-personal.LEFT * words[w]} | {"\x01" + x for x in ("nir", "health number", "insurance number", "passport")}
    harmless = {w for w in words if w not in disclosing and words[w] >= personal.HARMLESS_FROM}

    class Some(dict):
        def __init__(self, members):
            self.members = members

        def __missing__(self, key):
            return key in self.members

    return personal.Judge(Some(disclosing), Some(harmless), Some({"a signé"}))


def found(text, judge):
    return [(text[a:b], kind) for a, b, kind in personal.items(text, judge)]


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("Mme Jeanne Valorne (NIR 2 80 05 75 123 456 clé 12) sort ce jour.", [("Jeanne Valorne", "NAME"), ("2 80 05 75 123 456 clé 12", "IDNUM")]),
        ("Handed over by VALORNE Jeanne to Dr P. Merisot.", [("VALORNE Jeanne", "NAME"), ("P. Merisot", "NAME")]),
        ("Next of kin: Merisot, Paul. The scar will fade.", [("Merisot, Paul", "NAME")]),
        ("Valorne a signé le refus de soins", [("Valorne", "NAME")]),
        ("Signe de Tarvel négatif. Unité Tarvel prévenue.", []),
        ("Tél : 01 99 00 12 34 ou +33(0)639980123.", [("01 99 00 12 34", "PHONE"), ("+33(0)639980123", "PHONE")]),
        ("Next of kin ((212) 555-0176).", [("(212) 555-0176", "PHONE")]),
        ("Health number 999-850-1542. Can be reached on 415-555-0166.", [("999-850-1542", "IDNUM"), ("415-555-0166", "PHONE")]),
        ("mail a.b+c@x.example, d (at) y.test or e-f at z dot invalid now", [("a.b+c@x.example", "EMAIL"), ("d (at) y.test", "EMAIL"), ("e-f at z dot invalid", "EMAIL")]),
        ("Habite résidence du Parc, bât. A, 12 ter rue des Lilas, 99100 Marcourt depuis peu.", [("résidence du Parc, bât. A, 12 ter rue des Lilas, 99100 Marcourt", "ADDRESS")]),
        ("Lives at Apt 6B, 155 Old Ferry Lane, Puygny ZZ1 2AG.", [("Apt 6B, 155 Old Ferry Lane, Puygny ZZ1 2AG", "ADDRESS")]),
        ("Lot H2957-68, prélèvement 2342 4312 95, série 9069206934, le 12/03/2021 @ 3 ml/h, poste 12.", []),
        ("", []),
        ("   ", []),
    ],
)
def test_items(judge, text, wanted):
    assert found(text, judge) == wanted


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("Insurance number ZZ 56 13 58 A.", [("ZZ 56 13 58 A", "IDNUM")]),
        ("Vu ce jour, ZZ 72 05 60 A, sans suite.", [("ZZ 72 05 60 A", "IDNUM")]),
        ("Passport AB 123456.", [("AB 123456", "IDNUM")]),
        ("Lot AB 123456, dose 12 34 56.", []),
    ],
)
def test_numbers_of_six_digits(judge, text, wanted):
    assert found(text, judge) == wanted
    assert personal.replaced(text, personal.items(text, judge)) == (text.replace(wanted[0][0], "[IDNUM]") if wanted else text)


def test_placeholders(judge):
    text = "Mme Jeanne Valorne, tel 01 99 00 12 34."
    assert personal.replaced(text, personal.items(text, judge)) == "Mme [NAME], tel [PHONE]."


def test_tables(spark):
    rows = [("t", str(i), x, "NAME") for i, x in enumerate(TEXTS)] + [("t", "n", None, None), ("t", "e", "", None), ("t", "0", TEXTS[0], "x"), ("t", "l", "La plaie est propre. " * 5000 + "Mme Valorne", "x")]
    df = spark.createDataFrame(rows, "tbl string, row_key string, text string, kind string")
    sets = personal.learn(df)
    got = {(r.row_key, r.kind, r.found_text) for r in personal.find_personal(df, sets).collect()}
    assert ("0", "NAME", "Jeanne Valorne") in got and ("l", "NAME", "Valorne") in got and not any("Tarvel" in x[2] for x in got)
    assert personal.find_personal(df, sets).count() == len(got)
    clean = {r.row_key: r.text for r in personal.sanitise(df, sets).collect()}
    assert clean["n"] is None and clean["e"] == "" and "Valorne" not in clean["1"]
    none = personal.learn(df.limit(0))
    assert all(not any(s) for s in none) and personal.find_personal(df.limit(0), none).count() == 0


def test_bit_set(spark):
    members = [f"name{i}" for i in range(40_000)]
    made = personal.BitSet(personal._bit_set(spark.createDataFrame([(x,) for x in members], "word string")))
    assert made.bits == personal.filter_bits(len(members)) > personal.BLOCK_BITS and all(made[x] for x in members)
    # sized by the count, so the share of false members stays as stated at any size
    assert sum(made[f"other{i}"] for i in range(50_000)) <= 3 * 50_000 * personal.FALSE_MEMBERS
    for n in (1, 10**6, 3 * 10**7):
        assert (1 - math.exp(-personal.HASHES * n / personal.filter_bits(n))) ** personal.HASHES <= personal.FALSE_MEMBERS * 1.01


def test_contexts_of_numbers_are_learned(spark):
    """Contexts that no list names: numbers of a sure form in them disclose others there; those of devices don't."""
    nir = "1 68 05 00 200 780 clé 21"
    rows = [f"Kodo vivi {nir if i % 3 else '4246348895'}. Serie nene 42463488{i % 10}5. Dose 5 mg." for i in range(12)] * 5
    df = spark.createDataFrame([("t", str(i), x) for i, x in enumerate([*rows, "Kodo vivi 99887766.", "Serie nene 99887766.", "Vivi 12345678."])], "tbl string, row_key string, text string")
    got = {(r.row_key, r.kind, r.found_text) for r in personal.find_personal(df, personal.learn(df)).collect() if r.kind != "NAME"}
    assert ("60", "IDNUM", "99887766") in got and ("62", "IDNUM", "12345678") in got and not any(key == "61" for key, _, _ in got)
    assert ("0", "IDNUM", "4246348895") in got and not any(x.startswith("42463488") and x != "4246348895" for _, _, x in got)
