"""Rules for entities and records as lists of errors.

``errors`` columns are never null: a valid row has an empty list. ``strict`` stops the job at the first invalid row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medloom.functions import text as T
from medloom.schemas import DICTIONARIES, ENTITIES, ENTITY_LABELS, NEGATIONS, PROVENANCES, TEMPORALITIES

# Forms of identifiers.
ENTITY_ID, ROW_ID = r"^ent_[0-9]{6}$", r"^[A-Za-z0-9_.:-]{1,128}$"
MAX_ENTITIES = 300


def matches(c: Column, form: str) -> Column:
    return F.coalesce(c.rlike(form), F.lit(False))


def temporality_applies(label: Column) -> Column:
    return label.isin(*TEMPORALITIES)


def temporality_valid(label: Column, value: Column) -> Column:
    """The value is one of the label's; labels without temporality have none."""
    out = value.isNull()
    for name, values in TEMPORALITIES.items():
        out = F.when(label == name, F.coalesce(value.isin(*values), F.lit(False))).otherwise(out)
    return out


def known(c: Column, values: tuple[str, ...], upper: bool = False) -> Column:
    """A spelling of one of ``values`` in its canonical form; null for anything else."""
    plain = (F.upper if upper else F.lower)(T.strip(c))
    return F.when(plain.isin(*values), plain)


def _errors(*rules: tuple[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules]))


def entity_errors(e: Column, allow_no_temporality: bool = False) -> Column:
    """Names of the rules an entity breaks."""
    temporal = temporality_valid(e["label"], e["temporality"])
    if allow_no_temporality:
        temporal = temporal | e["temporality"].isNull()
    return _errors(
        ("id", matches(e["id"], ENTITY_ID)),
        ("text", T.strip(T.text_or_empty(e["text"])) != ""),
        ("span", (e["start"] >= 0) & (e["start"] < e["end"])),
        ("label", e["label"].isin(*ENTITY_LABELS)),
        ("dictionary", e["dictionary"].isin(*DICTIONARIES)),
        ("negation", e["negation"].isin(*NEGATIONS)),
        ("temporality", temporal),
        ("confidence", e["confidence"].isNull() | e["confidence"].between(0.0, 1.0)),
        ("source", e["source"].isin(*PROVENANCES)),
        ("concept", ~e["source"].isin("mesh_auto", "dict_auto") | ((T.text_or_empty(e["concept_id"]) != "") & (T.text_or_empty(e["concept_name"]) != ""))),
    )


def record_errors(entities: Column, max_entities: int = MAX_ENTITIES) -> Column:
    """Names of the rules a record (columns record_id, patient_id, name_document, type_document, text) breaks.

    A null list of entities counts as empty."""
    entities = F.coalesce(entities, F.array().cast(ENTITIES))
    filled = lambda c: T.strip(T.text_or_empty(F.col(c))) != ""
    return _errors(
        ("record_id", matches(F.col("record_id"), ROW_ID)),
        ("patient_id", matches(F.col("patient_id"), ROW_ID)),
        ("name_document", filled("name_document")),
        ("type_document", filled("type_document")),
        ("text", filled("text")),
        ("too_many_entities", F.size(entities) <= max_entities),
        ("entity", F.forall(entities, lambda e: F.size(entity_errors(e, True)) == 0)),
        ("entity_ids", F.size(F.array_distinct(F.transform(entities, lambda e: e["id"]))) == F.size(entities)),
        ("bounds", F.forall(entities, lambda e: e["end"] <= F.length("text"))),
    )


def parse_entities(c: Column) -> Column:
    """Entities from JSON; anything that is no list of objects gives an empty list, missing fields their defaults."""
    # from_json would keep the sound start of a broken list
    sound = F.when(F.try_parse_json(c).isNotNull() & c.rlike(r"^\s*\["), F.from_json(c, ENTITIES, {"mode": "PERMISSIVE"}))
    parsed = F.filter(F.coalesce(sound, F.array().cast(ENTITIES)), lambda e: e.isNotNull())
    default = lambda e: e.withField("dictionary", F.coalesce(e["dictionary"], F.lit("mesh"))).withField(
        "negation", F.when(e["negation"].isin(*NEGATIONS), e["negation"]).otherwise("unknown")
    ).withField("source", F.when(e["source"].isin(*PROVENANCES), e["source"]).otherwise("manual"))
    return F.transform(parsed, default)


def strict(df: DataFrame, errors: str = "errors") -> DataFrame:
    """``df`` as it is, failing on a row with errors."""
    return df.filter(F.coalesce(F.assert_true(F.size(errors) == 0, F.concat(F.lit("invalid row: "), F.array_join(errors, ", "))).cast("boolean"), F.lit(True)))
