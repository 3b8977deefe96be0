"""Readers with explicit schemas; nothing is inferred."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medloom import schemas
from medloom.functions import text as T
from medloom.operators.admissions import parse_lines
from medloom.operators.validation import parse_entities


class MissingData(ValueError):
    """A path that doesn't exist, is of the wrong kind or has an unsupported ending."""


def require(path: str, folder: bool = False) -> str:
    """The path, if it exists and is a folder or a file as wanted; only local paths are checked."""
    if "://" not in path and not (os.path.isdir(path) if folder else os.path.isfile(path)):
        raise MissingData(f"no such {'folder' if folder else 'file'}: {path}")
    return path


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on any file system Spark knows."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target))


def _file_name() -> Column:
    # names come URL-encoded, with a plain plus sign left alone
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def texts(spark: SparkSession, folder: str, endings: tuple[str, ...] = (".txt",), recursive: bool = False, limit: int | None = None, bad_bytes: str = "replace") -> DataFrame:
    """(path, name, stem, text) of every text file, one row a file; endings are compared in any case.

    ``bad_bytes``: 'replace' keeps U+FFFD for what is no UTF-8, 'ignore' drops it. ``limit`` takes the first files by path.
    """
    require(folder, folder=True)
    raw = spark.read.text(folder, wholetext=True, recursiveFileLookup=recursive)
    rows = raw.select(F.col("_metadata.file_path").alias("path"), _file_name().alias("name"), F.make_valid_utf8("value").alias("text"))
    rows = rows.filter(F.lower("name").rlike("(" + "|".join(e.replace(".", r"\.") for e in endings) + ")$"))
    if bad_bytes == "ignore":
        rows = rows.withColumn("text", F.replace("text", F.lit("�"), F.lit("")))
    rows = rows.select("path", "name", F.regexp_replace("name", r"\.[^.]*$", "").alias("stem"), "text")
    return rows.orderBy("path").limit(limit) if limit else rows


def text_records(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """Text files as records of unknown patient and type."""
    rows = texts(spark, folder, recursive=True, limit=limit, bad_bytes="ignore")
    unknown = F.lit("unknown")
    return rows.select(F.col("stem").alias("record_id"), unknown.alias("patient_id"), F.col("name").alias("name_document"), unknown.alias("type_document"), F.lit(None).cast("string").alias("date_document"), "text")


def decode(content: Column, encoding: str = "utf-8") -> Column:
    """Bytes as text; for UTF-8 with U+FFFD for what is none."""
    return F.make_valid_utf8(content.cast("string")) if encoding.lower().replace("-", "") == "utf8" else F.decode(content, encoding)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select(_file_name().alias("name"), F.sha2("content", 256).alias("sha256"))


def csv(spark: SparkSession, path: str, schema, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """CSV with a header, quoted line breaks and doubled quotes; all columns as the schema says."""
    return spark.read.csv(path, schema=schema, header=True, sep=sep, encoding=encoding, multiLine=True, escape='"', enforceSchema=False)


def labelled_records(spark: SparkSession, path: str) -> DataFrame:
    """Records with their entities parsed."""
    return csv(spark, require(path), schemas.RECORD).withColumn("entities", parse_entities(F.col("entities")))


def codes(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, require(path), schemas.CODE)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path, schemas.CANDIDATE)


def json_lines(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def json_object(spark: SparkSession, path: str, schema) -> DataFrame:
    """The single object of a JSON file, or the objects of its list, whatever the line breaks in it."""
    return spark.read.schema(schema).option("multiLine", True).json(require(path) if "*" not in path else path)


def vocabulary_lines(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, schemas.VOCABULARY)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(filename, label) of a JSON object of file names to lists of labels; unknown labels are dropped."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    rows = whole.select(F.explode("m").alias("filename", "labels")).select("filename", F.explode(F.from_json("labels", "array<string>")).alias("label"))
    return rows.select("filename", T.strip(F.col("label")).alias("label")).filter(F.col("label").isin(*schemas.DOCUMENT_LABELS))


def admission_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Fixed-width admission files (*.rss*) of a folder with file and line order."""
    lines = spark.read.option("pathGlobFilter", "*.rss*").text(require(folder, folder=True))
    rows = lines.select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return parse_lines(rows).drop("value")


def admission_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(admission_id, document_types, file_name, text_content) of folder/<admission_id>/#type_name.txt."""
    rows = texts(spark, folder, recursive=True, bad_bytes="ignore")
    return rows.select(F.regexp_extract(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), r"([^/]+)/[^/]+$", 1).alias("admission_id"), T.file_tags(F.col("name")).alias("document_types"), F.col("name").alias("file_name"), T.single_line(F.col("text")).alias("text_content"))


_TERMS = "array<struct<String:string>>"
_DESCRIPTOR = f"DescriptorUI string, DescriptorName struct<String:string>, TreeNumberList struct<TreeNumber:array<string>>, ConceptList struct<Concept:array<struct<ScopeNote:string,TermList:struct<Term:{_TERMS}>>>>"


def vocabulary_xml(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Vocabulary records of descriptor XML; records without ui are dropped.

    Synonyms are all terms of all concepts but the preferred ones, once each whatever their case, the first spelling held.
    """
    raw = spark.read.format("xml").option("rowTag", "DescriptorRecord").schema(_DESCRIPTOR).load(path)
    text = lambda c: T.strip(T.text_or_empty(c))
    filled = lambda a: F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), text), lambda x: x != "")
    concepts = F.col("ConceptList.Concept")
    terms = filled(F.flatten(F.transform(concepts, lambda c: F.coalesce(F.transform(c["TermList"]["Term"], lambda t: t["String"]), F.array().cast("array<string>")))))
    notes = filled(F.transform(concepts, lambda c: c["ScopeNote"]))
    rows = raw.select(text(F.col("DescriptorUI")).alias("ui"), filled(F.array(F.col("DescriptorName.String"))).alias("preferred_terms"), terms.alias("t"), filled(F.col("TreeNumberList.TreeNumber")).alias("tree_numbers"), F.coalesce(F.get(notes, F.lit(0)), F.lit("")).alias("scope_note"))
    small = F.transform("t", F.lower)
    first = F.filter(F.col("t"), lambda x, i: (F.array_position(small, F.lower(x)) == i + 1) & ~F.array_contains(F.transform("preferred_terms", F.lower), F.lower(x)))
    rows = rows.filter("ui <> ''").select("ui", "preferred_terms", first.alias("synonyms"), "tree_numbers", "scope_note", F.lit("mesh_xml").alias("source"))
    return rows.limit(limit) if limit else rows


def embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(ui, vector) from a vector column or from wide columns emb_0, emb_1, ... in numeric order."""
    raw = spark.read.parquet(path)
    if "vector" in raw.columns:
        return raw.select("ui", F.col("vector").cast("array<float>").alias("vector"))
    wide = sorted((c for c in raw.columns if c.startswith("emb_")), key=lambda c: int(c[4:]))
    if not wide:
        raise MissingData("neither a vector column nor emb_ columns")
    return raw.select("ui", F.array(*[F.col(c).cast("float") for c in wide]).alias("vector"))


def descriptor_file(folder: str) -> str:
    """The newest descriptor XML (desc*.xml, by name) of a local folder."""
    found = sorted(x for x in os.listdir(require(folder, folder=True)) if x.lower().startswith("desc") and x.lower().endswith(".xml"))
    if not found:
        raise MissingData(f"no descriptor XML in {folder}")
    return os.path.join(folder, found[-1])


def embedding_texts(vocabulary: DataFrame, max_synonyms: int = 15) -> DataFrame:
    """(ui, text): the first preferred term and the first synonyms, joined by ' | '; empty ones dropped."""
    parts = F.filter(F.transform(F.concat(F.slice("preferred_terms", 1, 1), F.slice("synonyms", 1, max_synonyms)), T.collapse_spaces), lambda x: x != "")
    return vocabulary.select("ui", F.array_join(parts, " | ").alias("text")).filter("ui <> '' and text <> ''")
