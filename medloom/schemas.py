"""Table schemas, label sets and other fixed values of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Labels, spellings and defaults that results depend on.
ENTITY_LABELS = (
    "MEDICATION", "DISEASE", "ALLERGY", "PROCEDURE", "TEST", "ANATOMY", "SYMPTOM", "FAMILY_HISTORY", "SOCIAL_HISTORY", "DEVICE",
    "MICROORGANISM", "CHEMICAL", "DOSAGE", "FREQUENCY", "DURATION", "ROUTE",
)
DICTIONARIES = ("mesh", "custom", "umls")
PROVENANCES = ("manual", "mesh_auto", "dict_auto", "model")
NEGATIONS = ("negated", "not_negated", "unknown")
TEMPORALITIES = {"MEDICATION": ("past", "current", "chronic", "future"), "DISEASE": ("past", "current", "chronic")}
DOCUMENT_LABELS = ("crh", "cro", "cra", "ordonnance_examen", "ordonnance_medicaments", "analyse_labo", "fiche_patient_admission")
LABEL_DESCRIPTIONS = {
    "crh": "Hospital discharge summary (Compte Rendu d'Hospitalisation).",
    "cro": "Operative report (Compte Rendu Operatoire).",
    "cra": "Anesthesia report (Compte Rendu d'Anesthesie).",
    "ordonnance_examen": "Prescription for medical exams (imaging, lab, etc.).",
    "ordonnance_medicaments": "Medication prescription.",
    "analyse_labo": "Laboratory analysis results.",
    "fiche_patient_admission": "Patient admission or administrative intake form.",
}
DOCUMENT_CLASSES = {
    "crh": "crh", "cro": "cro", "cra": "cra", "ordonnance_medicaments": "prescription", "ordonnance_examen": "prescription",
    "analyse_labo": "lab", "fiche_patient_admission": "admission",
}
PRESCRIPTION_TYPES = {"ordonnance_medicaments": "medicaments", "ordonnance_examen": "examen"}
LABEL_THRESHOLD = 0.55
KEYWORD_HINTS = {
    "crh": ("compte rendu", "hospitalisation", "sortie", "diagnostic", "traitement"),
    "cro": ("compte rendu operatoire", "intervention", "bloc", "incision", "suture"),
    "cra": ("anesthesie", "induction", "intubation", "asa", "reveil"),
    "ordonnance_examen": ("prescription", "examen", "scanner", "irm", "radiographie"),
    "ordonnance_medicaments": ("posologie", "comprime", "mg", "prise", "renouvelable"),
    "analyse_labo": ("biochimie", "hematologie", "resultats", "normes", "valeurs"),
    "fiche_patient_admission": ("identite", "adresse", "assure", "mutuelle", "admission"),
}
NEGATION_CUES = ("no", "not", "without", "denies", "deny", "absence", "absent")
TEMPORAL_CUES = {
    "past": ("history", "previously", "formerly", "past"),
    "chronic": ("chronic", "long-term", "longterm", "longstanding"),
    "current": ("currently", "ongoing", "today", "active", "now"),
    "future": ("will", "planned", "schedule", "tomorrow", "next"),
}
#: Fields of a fixed-width admission line: start and end character, from 0, end excluded.
ADMISSION_FIELDS = {
    "facility_id": (16, 24), "rss_id": (27, 47), "admission_id": (47, 67), "rum_id": (67, 77), "birth_date": (77, 85), "sex": (85, 86),
    "admission_date": (92, 100), "discharge_date": (102, 110), "primary_diagnosis_code": (140, 148), "related_diagnosis_code": (148, 156),
}
ASSOCIATED_FROM = 192
CANDIDATE_COLUMNS = (
    "doc_id", "candidate_term", "candidate_type", "context_snippet", "mesh_ui_suggested", "mesh_label_suggested", "score",
    "human_validation", "human_target_mesh_ui", "human_new_entity_label", "comment",
)
RECORD_COLUMNS = ("record_id", "patient_id", "name_document", "type_document", "date_document", "text", "entities")

ENTITY = T.StructType(
    [
        T.StructField("id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
        T.StructField("label", T.StringType()), T.StructField("concept_id", T.StringType()), T.StructField("concept_name", T.StringType()), T.StructField("dictionary", T.StringType()),
        T.StructField("negation", T.StringType()), T.StructField("temporality", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("source", T.StringType()),
        T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
    ]
)
ENTITIES = T.ArrayType(ENTITY)
VOCABULARY = T.StructType(
    [
        T.StructField("ui", T.StringType()), T.StructField("preferred_terms", T.ArrayType(T.StringType())), T.StructField("synonyms", T.ArrayType(T.StringType())),
        T.StructField("tree_numbers", T.ArrayType(T.StringType())), T.StructField("scope_note", T.StringType()), T.StructField("source", T.StringType()),
    ]
)
DICTIONARY = T.StructType([T.StructField(c, T.StringType()) for c in ("term", "concept_id", "concept_name", "dictionary", "label")])


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


RECORD = strings(*RECORD_COLUMNS)
CANDIDATE = strings(*CANDIDATE_COLUMNS)
CODE = strings("code", "description")
