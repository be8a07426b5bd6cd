"""A bounded sample of labelled documents, for the classifiers to learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fianchetto.llm.common import fold, texts_of

#: Labelled rows that a classifier learns from at most (expected): beyond, a hash of doc_id chooses among all of them.
MAX_FIT_ROWS = 20_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """doc_id, text, label (0 or 1), fold (1 to 4) of labelled documents, of which at most about ``max_rows``.

    Rows of fold 0 (crc32(doc_id as text) mod 5), null doc_ids and labels other than 0 and 1 stay out.  Of repeated labels
    of a document the greater counts, of repeated rows of a document the greatest text; a null text counts as empty.
    The chosen labels are broadcast: their number is bounded by ``max_rows``.
    """
    known = (labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label"))
             .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
             .groupBy("doc_id").agg(F.max("label").alias("label")))
    n = known.count()
    if n > max_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))
    texts = texts_of(docs)
    return (texts.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("label").alias("label"))
            .withColumn("fold", fold(F.col("doc_id"))))
