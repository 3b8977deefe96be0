"""Dictionary matching with negation and temporality, and comparison of annotations."""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medloom.functions import text as T
from medloom.functions.values import let
from medloom.operators import fulltext
from medloom.operators.candidates import TERM
from medloom.schemas import ENTITIES, NEGATION_CUES, TEMPORAL_CUES, TEMPORALITIES

MAX_ENTITIES, NEGATION_WINDOW = 300, 12
#: Terms and characters one automaton holds; a larger dictionary is several, each of which passes over the texts.
TERMS, CHARACTERS = 200_000, 3_000_000
#: Matches in a batch that leaves a task.
MATCHES = 50_000
_TOKEN = re.compile(r"\S+")
#: Automata a worker keeps, by what they were made of.
_automata: dict[str, ahocorasick.Automaton] = {}


def _lowered(text: str) -> str:
    """Small letters, as many characters as before."""
    small = text.lower()
    return small if len(small) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _wordlike(c: str) -> bool:
    return c.isalnum() or c == "_"


def _automaton(name: str, terms: list[str]) -> ahocorasick.Automaton:
    if name not in _automata:
        made = ahocorasick.Automaton()
        for term in terms:
            made.add_word(term, term)
        made.make_automaton()
        if len(_automata) >= 2:
            _automata.clear()
        _automata[name] = made
    return _automata[name]


def term_matches(text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, term) of every occurrence of a term between word boundaries; those of one term don't overlap.

    A boundary lies between a word character and another one, so before a term that begins with a bracket, say, a word
    character must stand.
    """
    small, out, upto = _lowered(text), [], {}
    for last, term in automaton.iter(small):
        end = last + 1
        start = end - len(term)
        before, after = start > 0 and _wordlike(small[start - 1]), end < len(small) and _wordlike(small[end])
        if before != _wordlike(term[0]) and after != _wordlike(term[-1]) and upto.get(term, 0) <= start:
            upto[term] = end
            out.append((start, end, term))
    return out


def label_dictionary(vocabulary: DataFrame, max_synonyms: int = 8) -> DataFrame:
    """(term, ui): preferred terms and the first synonyms of rows (line_no, ui, preferred_terms, synonyms), small letters.

    Of several uis with a term the first line, then the first place in it, holds; blank terms and uis are dropped.
    """
    names = F.concat(F.coalesce("preferred_terms", F.array().cast("array<string>")), F.slice(F.coalesce("synonyms", F.array().cast("array<string>")), 1, max_synonyms))
    rows = vocabulary.filter(T.strip(F.col("ui")) != "").select("ui", "line_no", F.posexplode(names).alias("pos", "name")).withColumn("term", F.lower(T.strip(F.col("name")))).filter("term <> ''")
    return rows.groupBy("term").agg(F.min(F.struct("line_no", "pos", "ui")).alias("m")).select("term", F.col("m.ui").alias("ui"))


def negations(text: str, starts: list[int], window: int = NEGATION_WINDOW) -> list[str]:
    """What ``negation`` says of a span at each of ``starts``, with the text divided once."""
    tokens = [(m.start(), m.end(), m[0].lower()) for m in _TOKEN.finditer(text)]
    begins = [a for a, _, _ in tokens]
    cues = [i for i, (_, _, token) in enumerate(tokens) if token in NEGATION_CUES]
    out = []
    for start in starts:
        n = bisect_left(begins, start)
        # the last token may reach into the span, which leaves its beginning
        parted = n > 0 and tokens[n - 1][1] > start
        cue = parted and text[begins[n - 1] : start].lower() in NEGATION_CUES
        whole = n - 1 if parted else n
        near = bisect_left(cues, whole) - 1
        out.append("negated" if cue or (near >= 0 and cues[near] >= n - window) else "not_negated")
    return out


def _chunks(terms: DataFrame, most: int, characters: int):
    """Lists of terms of bounded size, one at a time on the driver."""
    chunk, size = [], 0
    for row in terms.toLocalIterator():
        if chunk and (len(chunk) >= most or size + len(row[0]) > characters):
            yield chunk
            chunk, size = [], 0
        chunk.append(row[0])
        size += len(row[0])
    if chunk:
        yield chunk


def dictionary_matches(docs: DataFrame, dictionary: DataFrame, key: str, text: str, most: int = TERMS, characters: int = CHARACTERS) -> DataFrame:
    """Occurrences of dictionary terms between word boundaries, in any case: (key, term, start, end, surface, negation, and
    the dictionary's columns).

    Terms of any length and with any signs match. Each text is read once by an automaton of all terms; a dictionary of
    more than ``most`` terms or so many ``characters`` becomes several automata of at most that size, each of which
    reads the texts. Nothing but the matches is shuffled, to fetch the dictionary's columns. Null and blank texts and an
    empty dictionary have no rows; a term that several rows have matches for each.
    """
    dictionary = dictionary.withColumn("term", F.lower(T.strip(F.col("term")))).filter("term <> ''")
    rows = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("_text")).filter("_text is not null")
    schema = f"`{key}` {rows.dtypes[0][1]}, term string, start int, end int, surface string, negation string"
    found = rows.filter(F.lit(False)).select(key, *[F.lit(None).cast(kind).alias(c) for c, kind in (("term", "string"), ("start", "int"), ("end", "int"), ("surface", "string"), ("negation", "string"))])
    for terms in _chunks(dictionary.select("term").distinct(), most, characters):
        found = found.unionByName(rows.mapInArrow(_searcher(rows.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, terms)), key), schema))
    return found.join(dictionary, "term").select(key, "term", "start", "end", "surface", "negation", *[c for c in dictionary.columns if c != "term"])


def _searcher(shared, key: str):
    def run(batches):
        automaton = _automaton(*shared.value)
        for batch in batches:
            at, spans = [], []

            def taken():
                columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array([x[2] for x in spans], pa.string()), *[pa.array([x[i] for x in spans], pa.int32()) for i in range(2)], *[pa.array([x[i] for x in spans], pa.string()) for i in (3, 4)]]
                return pa.RecordBatch.from_arrays(columns, names=[key, "term", "start", "end", "surface", "negation"])

            for i, t in enumerate(batch.column(1).to_pylist()):
                found = term_matches(t, automaton)
                at += [i] * len(found)
                spans += [(a, b, term, t[a:b], n) for (a, b, term), n in zip(found, negations(t, [x[0] for x in found]) if found else ())]
                if len(at) >= MATCHES:
                    yield taken()
                    at, spans = [], []
            yield taken()

    return run


def token_matches(docs: DataFrame, dictionary: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, n): how often each one-word term occurs as a word, without leaving the JVM."""
    found = docs.select(key, F.explode(T.words(F.lower(F.col(text)))).alias("term"))
    return found.join(dictionary.select(F.lower("term").alias("term")).distinct(), "term").groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))


def negation(text: Column, start: Column, window: int = NEGATION_WINDOW) -> Column:
    """'negated' if a cue is among the ``window`` blank-separated tokens before the span, else 'not_negated'."""
    cues = F.array(*map(F.lit, NEGATION_CUES))
    near = lambda before: F.slice(before, F.greatest(F.size(before) - window + 1, F.lit(1)), F.lit(window))
    negated = let(T.tokens(F.lower(F.substr(text, F.lit(1), start))), lambda before: F.arrays_overlap(near(before), cues))
    return F.when(negated, "negated").otherwise("not_negated")


def temporality(text: Column, default: str | None = None) -> Column:
    """The first of past, chronic, current and future of which the text has a cue."""

    def first(found: Column) -> Column:
        out = F.lit(default).cast("string")
        for value, cues in reversed(TEMPORAL_CUES.items()):
            out = F.when(F.arrays_overlap(found, F.array(*map(F.lit, cues))), value).otherwise(out)
        return out

    return let(T.tokens(F.lower(text)), first)


def temporality_of(label: Column, value: Column) -> Column:
    """The value where the label takes it, else null."""
    out = F.lit(None).cast("string")
    for name, values in TEMPORALITIES.items():
        out = F.when((label == name) & value.isin(*values), value).otherwise(out)
    return out


def annotate(docs: DataFrame, dictionary: DataFrame, key: str = "record_id", text: str = "text", max_entities: int = MAX_ENTITIES) -> DataFrame:
    """``docs`` (key, text) with entities: dictionary matches with negation and temporality, numbered in text order.

    In: dictionary (term, concept_id, concept_name, dictionary, label). At most ``max_entities`` for each record, the
    first in the text; numbering comes after all labels are together. Records without a match have an empty array.
    """
    found = dictionary_matches(docs, dictionary, key, text)
    order = Window.partitionBy(key).orderBy("start", "end", "label", "concept_id")
    found = found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= max_entities)
    # a record's own entities, at most max_entities of them; no match carries its text
    row = F.struct("n", "surface", "start", "end", "label", "concept_id", "concept_name", "dictionary", "negation")
    lists = found.groupBy(key).agg(F.array_sort(F.collect_list(row), lambda a, b: a["n"] - b["n"]).alias("_found"))
    entity = lambda e: F.struct(
        F.format_string("ent_%06d", e["n"] - 1).alias("id"), e["surface"].alias("text"), e["start"].alias("start"), e["end"].alias("end"), e["label"].alias("label"), e["concept_id"].alias("concept_id"),
        e["concept_name"].alias("concept_name"), e["dictionary"].alias("dictionary"), e["negation"].alias("negation"), temporality_of(e["label"], F.col("_time")).alias("temporality"), F.lit(1.0).alias("confidence"),
        F.lit("dict_auto").alias("source"), F.create_map().cast("map<string,string>").alias("meta"),
    )
    joined = docs.select(key, text, temporality(F.col(text)).alias("_time")).join(lists, key, "left")
    made = F.transform("_found", entity)
    return joined.select(key, text, F.coalesce(made, F.array().cast(ENTITIES)).alias("entities"))


def annotation_scores(gold: DataFrame, predicted: DataFrame, labels: list[str] | None = None, keys: tuple[str, ...] = ("start", "end", "label")) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1 over the distinct keys of both sides; 0.0 where a share has no base.

    Give ``keys`` a record column to tell records apart; without one equal spans of different records are one.
    """
    sides = []
    for rows, side in ((gold, "g"), (predicted, "p")):
        rows = rows.filter(F.col("label").isin(*labels)) if labels else rows
        sides.append(rows.select(*keys).distinct().withColumn(side, F.lit(1)))
    both = sides[0].join(sides[1], list(keys), "full")
    counts = both.agg(F.count(F.when(F.col("g").isNotNull() & F.col("p").isNotNull(), 1)).alias("tp"), F.count(F.when(F.col("g").isNull(), 1)).alias("fp"), F.count(F.when(F.col("p").isNull(), 1)).alias("fn"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = counts.withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def detect(docs: DataFrame, dictionary: DataFrame, key: str, text: str, index: fulltext.StoredIndex | None = None, hits: int = 1) -> DataFrame:
    """(key, ui, label, start, end, method, score) of vocabulary entries in texts.

    In: dictionary (term, ui). Occurrences of terms have method 'dict' and score 1.0; with an index every distinct
    candidate term of a text also has its ``hits`` best entries of a full-text search, with method 'fts', no place (-1)
    and the search's score. Each distinct term of the corpus is searched once.
    """
    found = dictionary_matches(docs, dictionary, key, text)
    out = found.select(key, "ui", F.col("term").alias("label"), "start", "end", F.lit("dict").alias("method"), F.lit(1.0).alias("score"))
    if index is None:
        return out
    tokens = docs.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(TERM), F.lit(1)))).alias("label")).withColumn("query_id", F.lower("label"))
    best = index.search(tokens.select("query_id").distinct().withColumn("query", F.col("query_id")), hits)
    nowhere = F.lit(-1)
    return out.unionByName(tokens.join(best, "query_id").select(key, F.col("key").alias("ui"), "label", nowhere.alias("start"), nowhere.alias("end"), F.lit("fts").alias("method"), "score"))


def training_spans(records: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """(record_id, text, entities (start, end, label)) of the records that have any, with ``labels`` only of these: what an
    entity recogniser is trained on."""
    kept = F.filter("entities", lambda e: e["label"].isin(*labels)) if labels is not None else F.col("entities")
    spans = F.transform(kept, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["label"].alias("label")))
    return records.select("record_id", "text", spans.alias("entities")).filter(F.size("entities") > 0)
