"""Training-corpus pipeline over the operators of weaveline.llm.

Each stage reads what the stage before it kept and returns documents with their own columns;
the last returns the encoded documents. Rows without a doc_id pass the stages that name
documents by it (n-gram join, decontamination) unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weaveline.llm.decontaminate import contaminated
from weaveline.llm.exact_dedup import keep_one
from weaveline.llm.language_id import UNKNOWN, identify
from weaveline.llm.ngram_join import link_components
from weaveline.llm.piece_codec import encode_documents
from weaveline.llm.queries import piece_model
from weaveline.llm.shared import publish, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are null or have no letters go; a text in no learned language stays, as identify names the nearest one."""
    rest = [c for c in docs.columns if c != "text"]
    packed = docs.select("doc_id", "text", "lang", F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)]).alias("rest"))
    known = identify(packed, keep=("text", "rest")).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") > 0))
    return known.select(*["text" if c == "text" else F.col(f"rest.c{rest.index(c)}").alias(c) for c in docs.columns])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the one with the smallest doc_id stays."""
    gone = link_components(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    gone = contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers of whole texts, with the round trip's digests."""
    return encode_documents(docs, piece_model())


STAGES = [("language", language), ("exact", exact), ("near", near), ("clean", clean), ("encode", encode)]

#: SQL expresses neither the classifier nor the encoder; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = publish(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
