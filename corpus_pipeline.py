"""The corpus pipeline: stages over ``documents``, each by one operator of ``fianchetto.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fianchetto.llm import decontam, near_dedup, packing, pii, quality
from fianchetto.llm.common import materialize
from fianchetto.llm.queries import table, vocabulary


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.3; the others go. Learns from this stage's labelled documents."""
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.quality_score(model, F.col("text")) >= 0.3)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five words, similarity 0.8): the one with the least doc_id.

    Rows are told apart by numbers of their own, written with them: repeated and null doc_ids are separate documents.  Of
    rows with the same doc_id, the one whose text has the least hash stays; a null doc_id comes after all others.
    """
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("id"), F.struct("*").alias("row")), "rows")
    found = near_dedup.near_duplicates(rows.select(F.col("id").alias("doc_id"), "row.text"), percent=80, size=5)
    order = F.struct(F.col("row.doc_id").isNull().alias("none"), "row.doc_id", F.xxhash64("row.text").alias("hash"), "id")
    ranked = rows.select("id", order.alias("order")).join(found.select(F.col("doc_id").alias("id"), "component_id"), "id")
    first = ranked.groupBy("component_id").agg(F.min("order").alias("order")).select("order.id")
    return rows.join(first, "id", "left_semi").select("row.*")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item of ``benchmark``."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets; n_chars follows."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are left, packed into sequences: one row per piece. Workers that keep a large memo of pieces would
    hold it on through other stages' tasks."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), small_memo=True)


STAGES = [
    ("quality classifier", keep_quality),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("personal data", redact_pii),
    ("best-fit packing", pack),
]

#: SQL cannot express the stages (trained models, tokenizers): the tests hold them against plainer versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
