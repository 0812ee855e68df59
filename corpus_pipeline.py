"""The training-data pipeline: five stages over ``documents``, each by one operator.

Toxic documents go, repeated lines go, one document of each near-duplicate group stays, secrets are
replaced, and what remains is packed into sequences. Every stage takes (spark, docs, sf_dir) and works
on all rows that the stage before it kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import line_dedup, ngram_join, packing, secret_scan, toxicity
from corvane.llm.common import read_table
from corvane.llm.queries import held_out
from corvane.session import materialise


def _recounted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents with ``n_chars`` of the text as it is now."""
    length = F.char_length(F.coalesce("text", F.lit("")))
    return docs.select(*(length.cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else c for c in columns))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below the rejection mark."""
    model = toxicity.fit_toxicity(docs, read_table(spark, sf_dir, "labels").where(~held_out()))
    return toxicity.score_documents(docs, model).where(F.col("score") < toxicity.REJECT).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that ten or more documents hold; the content of ten or more copies stays once.

    A copy that is left with nothing goes, as each of its lines stays in another document.
    """
    out = line_dedup.dedup_lines(docs, copy_share=line_dedup.COPY_SHARE)
    return _recounted(out.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^ \t\n\x0B\f\r]")), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near duplicates."""
    return ngram_join.keep_one(docs).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with the values of secrets replaced."""
    return _recounted(secret_scan.scan_secrets(docs, redact=True), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents and their places in sequences of 4096 tokens."""
    return packing.pack(packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

#: The toxicity model cannot be written as SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
