"""The given tables seen as records, documents, vectors and query batches.

The tables hold no repository records, so customers stand in for repositories, their orders for
commits, pull requests and issues, and documents for search documents.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corvane.operators.curate import curate
from corvane.operators.lexical import doc_tokens
from corvane.plans.search import Index
from corvane.session import spread
from corvane.sources.repositories import SEQ
from corvane.sources.schemas import RAW_SCHEMA

# Orders end in August 2001.
REFERENCE = "2001-09-01T00:00:00Z"


@lru_cache(maxsize=256)
def _schema(spark: SparkSession, path: str) -> StructType:
    return spark.read.parquet(path).schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its schema is read from the footers once per session."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    return spark.read.schema(_schema(spark, path)).parquet(path)


def raw_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as raw records (text counts, mixed list items, missing values) with ``seq``."""

    def status(letter: str):
        return F.sum(F.when(F.col("o_orderstatus") == letter, 1).otherwise(0)).cast("string")

    iso = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    orders = (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(
            F.count("*").cast("string").alias("defaultBranchCommitCount"),
            status("F").alias("pullRequests"),
            status("O").alias("issues"),
            status("P").alias("forks"),
            F.date_format(F.min("o_orderdate"), iso).alias("createdAt"),
            F.date_format(F.max("o_orderdate"), iso).alias("pushedAt"),
            F.sort_array(F.collect_set("o_orderstatus")).alias("statuses"),
            F.sort_array(F.collect_set("o_orderpriority")).alias("priorities"),
        )
    )
    segment = F.col("c_mktsegment")
    anonymous = (segment == "FURNITURE") & (F.col("c_acctbal") < 0)

    def item(x):
        return F.concat(F.lit('{"name":"'), x, F.lit('","size":1}'))

    columns = {
        "owner": F.when(anonymous, "").otherwise(F.col("n_name")),
        "name": F.when(~anonymous, F.concat(F.lit("<i>"), F.col("c_name"), F.lit("</i>\n"))),
        "nameWithOwner": F.when(segment == "MACHINERY", "").when(
            segment != "FURNITURE", F.concat_ws("/", "n_name", "c_name")
        ),
        "description": F.when(
            segment != "BUILDING",
            F.concat(F.lit("<p>Orders &amp; accounts of <b>"), "c_name", F.lit("</b></p>\n\t in  "), "n_name"),
        ),
        "primaryLanguage": F.when(segment != "HOUSEHOLD", segment),
        "languages": F.concat(
            F.array(item(segment)),
            F.transform(
                F.coalesce("statuses", F.array().cast("array<string>")),
                lambda s: F.when(s == "P", s).otherwise(item(s)),
            ),
        ),
        "topics": F.transform("priorities", lambda p: F.when(p == "3-MEDIUM", p).otherwise(item(p))),
        "stars": F.when(F.col("c_acctbal") > 0, F.floor("c_acctbal").cast("string")),
        "watchers": F.lit(None).cast("string"),
        "diskUsageKb": F.col("c_acctbal").cast("string"),
        "isFork": F.when(F.col("pullRequests").cast("int") > F.col("issues").cast("int"), "true").otherwise("false"),
        "isArchived": F.lit(None).cast("string"),
        "license": F.when(segment == "AUTOMOBILE", "").when(segment == "BUILDING", "Apache <u>License</u> 2.0"),
        SEQ: F.col("c_custkey"),
    }
    return (
        table(spark, sf_dir, "customer")
        .join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .withColumns(columns)
        .select(*RAW_SCHEMA.fieldNames(), SEQ)
    )


def repos(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """Curated customers; ``id`` is the customer key."""
    return curate(raw_repos(spark, sf_dir), reference=REFERENCE, **options).withColumnRenamed(SEQ, "id")


def raw_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as arriving raw records; the name (source/length) repeats."""
    docs = spread(table(spark, sf_dir, "documents"))
    given = {
        "owner": F.col("source"),
        "name": F.col("doc_id").cast("string"),
        "nameWithOwner": F.concat_ws("/", "source", F.col("n_chars").cast("string")),
        "description": F.col("text"),
        "primaryLanguage": F.col("lang"),
        "stars": F.col("n_chars").cast("string"),
    }
    columns = [
        given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in RAW_SCHEMA.fields
    ]
    return docs.select(*columns, F.col("doc_id").alias(SEQ))


def stored_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names already stored: those of labelled documents."""
    labelled = table(spark, sf_dir, "labels").select("doc_id")
    return (
        table(spark, sf_dir, "documents")
        .join(labelled, "doc_id", "left_semi")
        .select(F.concat_ws("/", "source", F.col("n_chars").cast("string")).alias("name_with_owner"))
        .distinct()
    )


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records with a quality-based activity; unlabelled ones have no push date."""
    labels = table(spark, sf_dir, "labels")
    labelled = F.col("quality").isNotNull()
    return (
        table(spark, sf_dir, "documents")
        .join(labels, "doc_id", "left")
        .select(
            F.col("doc_id").alias("id"),
            F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("name_with_owner"),
            F.col("lang").alias("primary_language"),
            F.col("n_chars").alias("stars"),
            (0.5 * F.coalesce("quality", F.lit(0)) + 0.5 * (1 - F.coalesce("toxic", F.lit(0)))).alias("activity_score"),
            F.when(labelled, F.concat(F.lit("2001-0"), F.col("quality") + 1, F.lit("-01T00:00:00Z"))).alias("pushed_at"),
        )
    )


def doc_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole document texts with the columns a search filters on."""
    return spread(table(spark, sf_dir, "documents")).select(
        F.col("doc_id").alias("id"),
        "text",
        F.col("lang").alias("primary_language"),
        F.col("n_chars").alias("stars"),
    )


def curated_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as curated records with their text, as an index is built from."""
    texts = doc_texts(spark, sf_dir).select("id", F.col("text").alias("synthesized_text"))
    return docs(spark, sf_dir).join(texts, "id")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored vectors of documents, with the columns a search filters on."""
    stored = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    meta = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("primary_language"), F.col("n_chars").alias("stars")
    )
    return stored.join(meta, "id")


def query_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item as a query: its text, and the stored vector with its number."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    stored = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return items.join(stored, "query_id")


def doc_index(spark: SparkSession, sf_dir: str) -> Index:
    """The documents as a search index, derived from the tables in the same plan."""
    return Index(docs(spark, sf_dir), vectors(spark, sf_dir), doc_tokens(doc_texts(spark, sf_dir)))
