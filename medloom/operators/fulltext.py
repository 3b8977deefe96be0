"""Full-text search over an inverted index: BM25, boolean and substring search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from medloom.functions import text as T

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Query terms that are pushed down to the scan of a stored index.
PUSHED_TERMS = 500


def terms(c: Column) -> Column:
    """Search terms: runs of letters and digits, small, without accents."""
    return F.regexp_extract_all(F.lower(T.strip_accents(c)), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def postings(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """(term, key, tf, doc_len) of the given text columns together, null columns counting as empty.

    One shuffle, on (key, term); the length travels with each posting, so that scoring needs no second join.
    """
    tokens = terms(F.concat_ws(" ", *[F.col(c) for c in columns]))
    rows = df.select(F.col(key).alias("key"), tokens.alias("t")).filter(F.size("t") > 0)
    return rows.select("key", F.size("t").alias("doc_len"), F.explode("t").alias("term")).groupBy("term", "key").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.first("doc_len").alias("doc_len"))


def corpus_size(df: DataFrame, *columns: str) -> tuple[int, float]:
    """Number of documents and mean length in terms."""
    tokens = terms(F.concat_ws(" ", *[F.col(c) for c in columns]))
    n, mean = df.agg(F.count(F.lit(1)), F.avg(F.size(tokens))).first()
    return n, float(mean or 0.0)


def bm25(index: DataFrame, queries: DataFrame, n_docs: int, mean_len: float, k: int = 10) -> DataFrame:
    """(query_id, key, score, rank): the k best documents that have every term of the query, best (most negative) first.

    In: postings, queries (query_id, query). The higher rank among equal scores goes to the smaller key. A query without a
    term has no rows. Document frequencies are counted for the queries' terms only.
    """
    wanted = queries.select("query_id", F.array_distinct(terms(F.col("query"))).alias("t")).withColumn("n_terms", F.size("t")).select("query_id", "n_terms", F.explode("t").alias("term"))
    hits = index.join(wanted.select("term").distinct(), "term", "left_semi")
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.ln((F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    gain = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.lit(mean_len)))
    scored = hits.join(wanted.join(df, "term"), "term").withColumn("gain", gain).groupBy("query_id", "key").agg(F.sum("gain").alias("gain"), F.count(F.lit(1)).alias("n"), F.first("n_terms").alias("n_terms"))
    scored = scored.filter("n = n_terms").select("query_id", "key", F.round(-F.col("gain"), 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "key")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def boolean_search(index: DataFrame, query: str, k: int) -> DataFrame:
    """Keys of documents that have every term of the query, the k smallest."""
    wanted = index.sparkSession.range(1).select(F.explode(F.array_distinct(terms(F.lit(query)))).alias("term"))
    n = wanted.count()
    return index.join(F.broadcast(wanted), "term").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == n).select("key").orderBy("key").limit(k)


def substring_search(df: DataFrame, column: str, query: str, order: str, k: int = 5) -> DataFrame:
    """The first k rows, in the order of ``order``, whose column contains the query in any case."""
    return df.filter(F.contains(F.lower(F.col(column)), F.lower(F.lit(query)))).orderBy(order).limit(k)


def browse(df: DataFrame, column: str, part: str, order: str, k: int = 50, prefix: bool = False) -> DataFrame:
    """The first k rows whose array of tree numbers has one that contains (or starts with) ``part``, in any case."""
    small = F.lower(F.lit(part))
    test = (lambda x: F.startswith(F.lower(x), small)) if prefix else (lambda x: F.contains(F.lower(x), small))
    return df.filter(F.exists(F.col(column), test)).orderBy(order).limit(k)


def lookup(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.filter(F.col(key) == value)


def hybrid(text_hits: DataFrame, vector_hits: DataFrame) -> DataFrame:
    """Both result lists under each other, marked by their source."""
    columns = ["query_id", "key", "score", "rank"]
    return text_hits.select(F.lit("text").alias("source"), *columns).unionByName(vector_hits.select(F.lit("vector").alias("source"), *columns))


@dataclass
class StoredIndex:
    """Postings and corpus size of a text index in a folder; ``search`` reads only the row groups of its terms."""

    postings: DataFrame
    n_docs: int
    mean_len: float

    @staticmethod
    def write(df: DataFrame, key: str, *columns: str, path: str, mode: str = "errorifexists") -> None:
        """Postings sorted by term over ranges of terms, so that a term's row groups are few, and one row with the sizes."""
        postings(df, key, *columns).repartitionByRange("term").sortWithinPartitions("term").write.mode(mode).parquet(f"{path}/postings")
        n, mean = corpus_size(df, *columns)
        df.sparkSession.range(1).select(F.lit(n).cast("bigint").alias("n_docs"), F.lit(mean).alias("mean_len")).write.mode(mode).parquet(f"{path}/size")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> StoredIndex:
        n, mean = spark.read.parquet(f"{path}/size").select("n_docs", "mean_len").first()
        return cls(spark.read.parquet(f"{path}/postings"), n, mean)

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """As bm25. The terms of up to PUSHED_TERMS go down to the scan; more are joined only."""
        wanted = queries.select(F.explode(terms(F.col("query"))).alias("term")).distinct().limit(PUSHED_TERMS + 1).collect()
        index = self.postings.filter(F.col("term").isin([r["term"] for r in wanted])) if len(wanted) <= PUSHED_TERMS else self.postings
        return bm25(index, queries, self.n_docs, self.mean_len, k)
