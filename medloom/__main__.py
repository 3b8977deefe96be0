"""Command line: python -m medloom list | query | annotate | parse | index | search | lookup | browse | embed | expand | extend | train | predict."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medloom import schemas
from medloom.operators import candidates, encoders, fulltext, ml, vectors
from medloom.plans import apps, catalogue, composed, general
from medloom.runtime import session
from medloom.sources import readers, writers

COLUMNS = ("ui", "preferred_terms", "synonyms", "scope_note")


def parser() -> argparse.ArgumentParser:
    made = argparse.ArgumentParser(prog="medloom")
    made.add_argument("--master", default="local[*]")
    do = made.add_subparsers(dest="do", required=True)

    def command(name: str, help: str, *arguments: str) -> argparse.ArgumentParser:
        one = do.add_parser(name, help=help)
        for a in arguments:
            one.add_argument(a)
        return one

    command("list", "names of the queries")
    command("query", "run a query over a folder of Parquet tables", "name", "folder").add_argument("--out", help="Parquet folder; else the first rows are shown")
    annotate = command("annotate", "dictionary entities of a labelled CSV or a folder of texts")
    annotate.add_argument("--labelled-csv")
    annotate.add_argument("--texts")
    annotate.add_argument("--dictionary", required=True, help="CSV with term, concept_id, concept_name, dictionary, label")
    annotate.add_argument("--out", required=True)
    command("parse", "descriptor XML (a file, or the newest of a folder) to JSON lines", "xml", "out")
    command("index", "text index of a vocabulary in JSON lines", "vocabulary", "out")
    search = command("search", "full-text search of a vocabulary in JSON lines, or of its index", "vocabulary", "query")
    search.add_argument("--limit", type=int, default=10, choices=range(1, 101), metavar="1..100")
    command("lookup", "the entry of a ui", "vocabulary", "ui")
    command("browse", "entries by a part of a tree number", "vocabulary", "part").add_argument("--limit", type=int, default=50, choices=range(1, 501), metavar="1..500")
    command("embed", "vectors of a vocabulary's entries", "vocabulary", "out").add_argument("--backend", default="hashing")
    command("expand", "candidate rows of a folder of texts for validation", "texts", "vocabulary", "out")
    command("extend", "mappings and new entries of validated candidate rows", "rows", "out")
    train = command("train", "a classifier of codes of a Parquet table with text and label", "table", "out")
    train.add_argument("--kind", default="logreg")
    command("predict", "codes of the texts of a Parquet table", "model", "table", "out").add_argument("--top", type=int, default=5, choices=range(1, 21), metavar="1..20")
    return made


def _flat(spark: SparkSession, path: str) -> DataFrame:
    """A vocabulary with its lists as text."""
    return readers.vocabulary_lines(spark, path).withColumns({c: F.array_join(c, " | ") for c in ("preferred_terms", "synonyms")})


def _index(spark: SparkSession, path: str) -> fulltext.StoredIndex:
    """A stored index, or one made of a vocabulary file."""
    if readers.exists(spark, f"{path}/postings"):
        return fulltext.StoredIndex.open(spark, path)
    rows = _flat(spark, path)
    return fulltext.StoredIndex(fulltext.postings(rows, "ui", *COLUMNS), *fulltext.corpus_size(rows, *COLUMNS))


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.do == "query":
        df = (catalogue.QUERIES | general.QUERIES | composed.QUERIES)[args.name](spark, args.folder)
        df.write.mode("overwrite").parquet(args.out) if args.out else df.show(truncate=60)
    elif args.do == "annotate":
        apps.annotate(spark, readers.csv(spark, args.dictionary, schemas.DICTIONARY), args.labelled_csv, args.texts, args.out)
    elif args.do == "parse":
        writers.json_lines(readers.vocabulary_xml(spark, args.xml if args.xml.lower().endswith(".xml") else readers.descriptor_file(args.xml)), args.out)
    elif args.do == "index":
        fulltext.StoredIndex.write(_flat(spark, args.vocabulary), "ui", *COLUMNS, path=args.out)
    elif args.do == "search":
        asked = spark.createDataFrame([(1, args.query)], "query_id int, query string")
        _index(spark, args.vocabulary).search(asked, args.limit).orderBy("rank").show(args.limit, truncate=60)
    elif args.do == "lookup":
        fulltext.lookup(readers.vocabulary_lines(spark, args.vocabulary), "ui", args.ui).show(truncate=False)
    elif args.do == "browse":
        fulltext.browse(readers.vocabulary_lines(spark, args.vocabulary), "tree_numbers", args.part, "ui", args.limit).select("ui", "preferred_terms", "tree_numbers").show(args.limit, truncate=60)
    elif args.do == "embed":
        texts = readers.embedding_texts(readers.vocabulary_lines(spark, args.vocabulary))
        vectors.write_index(texts.select(F.col("ui").alias("entry_id"), encoders.encode(F.col("text"), args.backend).alias("vector")), args.out)
    elif args.do == "expand":
        docs = readers.texts(spark, args.texts, (".txt", ".md"), recursive=True).select(F.col("name").alias("doc_id"), "text")
        vocabulary = readers.vocabulary_lines(spark, args.vocabulary).withColumn("line_no", F.monotonically_increasing_id())
        writers.candidates_csv(apps.expand_vocabulary(docs, vocabulary), args.out)
    elif args.do == "extend":
        mappings, new, counts = candidates.extended_vocabulary(readers.candidates(spark, args.rows))
        writers.csv(mappings, f"{args.out}/mappings")
        writers.csv(new, f"{args.out}/new")
        writers.json_object(counts, f"{args.out}/counts.json")
        writers.markdown(counts, "Validated candidates", f"{args.out}/report.md")
    elif args.do == "train":
        ml.save(ml.train(spark.read.parquet(args.table), args.kind), args.out)
    elif args.do == "predict":
        writers.json_lines(apps.predict_batch(ml.load(args.model), spark.read.parquet(args.table), args.top), args.out)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.do == "list":
        print("\n".join(sorted(catalogue.QUERIES | general.QUERIES | composed.QUERIES)))
        return 0
    try:
        run(session(args.master), args)
    except (ValueError, KeyError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
