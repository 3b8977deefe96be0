"""Writers. Output stays partitioned unless one file is the format."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medloom.functions import text as T
from medloom.schemas import CANDIDATE_COLUMNS, RECORD_COLUMNS

#: Characters of evidence an export shows.
EVIDENCE = 250


def csv(df: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists", one_file: bool = False) -> None:
    """CSV with a header and doubled quotes; arrays, maps and structs as JSON with their nulls."""
    nested = [c for c, kind in df.dtypes if kind.startswith(("array", "map", "struct"))]
    flat = df.withColumns({c: F.to_json(c, {"ignoreNullFields": "false"}) for c in nested})
    (flat.coalesce(1) if one_file else flat).write.mode(mode).csv(path, header=True, sep=sep, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def records_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    csv(df.select(*[c if c in df.columns else F.lit(None).cast("string").alias(c) for c in RECORD_COLUMNS]), path, mode=mode)


def candidates_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    csv(df.select(*CANDIDATE_COLUMNS), path, mode=mode)


def predictions_csv(wide: DataFrame, path: str, mode: str = "errorifexists") -> None:
    evidence = {c: F.left(F.col(c), F.lit(EVIDENCE)) for c, kind in wide.dtypes if c.endswith("evidence") and kind == "string"}
    csv(wide.withColumns(evidence) if evidence else wide, path, sep=";", mode=mode)


def admissions_csv(df: DataFrame, path: str, order: str = "admission_date", mode: str = "errorifexists") -> None:
    """One file sorted by the raw text of a column, as the format wants; the sort itself is distributed."""
    csv(df.orderBy(order) if order in df.columns else df, path, mode=mode, one_file=True)


def admission_folders(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A folder of CSV files for each admission."""
    nested = [c for c, kind in df.dtypes if kind.startswith(("array", "map", "struct"))]
    df.withColumns({c: F.to_json(c) for c in nested}).write.mode(mode).partitionBy("admission_id").csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def parquet(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def embeddings_wide(df: DataFrame, dims: int, path: str, mode: str = "errorifexists") -> None:
    df.select("ui", *[F.col("vector")[i].cast("float").alias(f"emb_{i}") for i in range(dims)]).write.mode(mode).parquet(path)


def labelled_lines(df: DataFrame, label: str, text: str, path: str, mode: str = "errorifexists") -> None:
    """Lines '__label__x text'."""
    df.select(F.concat(F.lit("__label__"), F.col(label).cast("string"), F.lit(" "), T.single_line(F.col(text)))).write.mode(mode).text(path)


def _put(spark, path: str, text: str) -> None:
    """A small text as one file, on any file system Spark knows."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def json_object(df: DataFrame, path: str) -> None:
    """The single row of ``df`` (measures, settings, a summary) as one JSON file."""
    _put(df.sparkSession, path, one_json(df) + "\n")


def text(spark, content: str, path: str) -> None:
    _put(spark, path, content)


def markdown(df: DataFrame, title: str, path: str, most: int = 1000) -> None:
    """A report: a title and the first ``most`` rows as a table; the report is for reading, so it has an end."""
    rows = df.limit(most).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(cell(v) for v in r) + " |" for r in rows), ""]
    _put(df.sparkSession, path, "\n".join(lines))


def checksum_file(spark, path: str) -> str:
    """Writes <path>.sha256, 'digest  name', beside a file and gives the digest."""
    from medloom.sources import readers

    row = readers.checksums(spark, path).first()
    _put(spark, f"{path}.sha256", f"{row['sha256']}  {row['name']}\n")
    return row["sha256"]


def one_json(df: DataFrame) -> str:
    """The single row of ``df`` as JSON."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0]
