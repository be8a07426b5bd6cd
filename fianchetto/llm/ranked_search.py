"""Ranked lexical search by pipelined term partitioning, in whole numbers.

Terms belong to owners, the rare ones to the first and the common ones to the last.  Items travel in bundles from owner to
owner: a stage is one cogroup of the bundles with the postings of one owner, which adds the contributions of that owner's
terms to the items' sparse accumulators (document -> score) and hands the bundle on.  After the last stage each item's best
documents are selected.

Documents are cut into blocks, so a stage's group is one bundle against one block: neither a word that every document
holds nor an item that touches them all makes a group grow.  An accumulator is dropped once even the most that later
owners can add does not lift its document to the k-th best of its own block: it cannot be among the k best of all.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fianchetto.llm.common import materialize, scratch, small_batches

#: Owners by document frequency: a term in at most N / STAGES[i] documents belongs to owner i, commoner ones to the last.
STAGES = (1024, 64, 8)
DOCS_PER_BLOCK = 8192
ITEMS_PER_BUNDLE = 256
TERMS_PER_BATCH = 200_000

# Fixed value: a term is a run of ASCII letters, digits and all characters beyond ASCII.
_TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_COUNTED = "row long, doc_id long, n int, term binary, tf int"
_STATE = "bundle int, block int, item_id long, terms array<long>, owners array<int>, tops array<long>, docs array<long>, orders array<long>, scores array<long>"
_NONE = np.empty(0, np.int64)


def terms_of(raw: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, only A-Z lower-cased (bytes.lower leaves other bytes alone)."""
    return _TERM.findall(raw.lower())


def _count_terms(batches):
    """Rows (row, doc_id, n, term, tf) of every document with a term; its own marker, term "\\0" + row, has tf 0."""
    row, doc, length, term, tf = [], [], [], [], []

    def flush():
        out = pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(row)), pa.array(doc, pa.int64()), pa.array(np.concatenate(length)), pa.array(term, pa.binary()), pa.array(tf, pa.int32())],
            ["row", "doc_id", "n", "term", "tf"])
        for x in (row, doc, length, term, tf):
            x.clear()
        return out

    for batch in batches:
        for r, d, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            found = Counter(terms_of(raw))
            if not found:
                continue
            k = len(found) + 1
            row.append(np.full(k, r, np.int64))
            length.append(np.full(k, found.total(), np.int32))
            doc.extend([d] * k)
            term.append(b"\0" + r.to_bytes(8, "big"))
            term.extend(found)
            tf.append(0)
            tf.extend(found.values())
            if len(term) >= TERMS_PER_BATCH:
                yield flush()
    if term:
        yield flush()


def _item_terms(batches):
    for batch in batches:
        found = [set(terms_of(raw)) for raw in batch.column(1).to_pylist()]
        ids = [i for i, t in zip(batch.column(0).to_pylist(), found, strict=True) for _ in t]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([t for f in found for t in f], pa.binary())], ["item_id", "term"])


def _stage(owner: int, k: int):
    """One owner's stage: add its contributions to the bundle's accumulators, drop those that cannot win any more."""

    def run(items: pa.Table, postings: pa.Table) -> pa.Table:
        cols = {c: items.column(c).to_pylist() for c in ("terms", "owners", "tops", "docs", "orders", "scores")}
        doc, order = (postings.column(c).to_numpy().astype(np.int64) for c in ("row", "ord"))
        no, gain = postings.column("term_no").to_numpy(), postings.column("gain").to_numpy().astype(np.int64)
        held = [np.asarray(x, np.int64) for x in cols["docs"]]
        everyone, at = np.unique(np.concatenate([doc, *held]), return_index=True)  # the block's documents that matter here
        orders = np.concatenate([order, *(np.asarray(x, np.int64) for x in cols["orders"])])[at]
        place = np.searchsorted(everyone, doc)
        by_term = np.argsort(no, kind="stable")
        place, gain, no = place[by_term], gain[by_term], no[by_term]
        out = {"docs": [], "orders": [], "scores": []}
        for i, docs in enumerate(held):
            total = np.zeros(len(everyone), np.int64)
            total[np.searchsorted(everyone, docs)] = np.asarray(cols["scores"][i], np.int64)
            owners = np.asarray(cols["owners"][i])
            for t in np.asarray(cols["terms"][i], np.int64)[owners == owner]:
                lo, hi = np.searchsorted(no, (t, t + 1))
                total[place[lo:hi]] += gain[lo:hi]  # a document holds a term once in the postings
            ahead = int(np.asarray(cols["tops"][i], np.int64)[owners > owner].sum())
            live = np.flatnonzero(total)
            if len(live) > k:
                least = np.partition(total[live], len(live) - k)[len(live) - k]  # the block's k-th best so far
                live = live[total[live] + ahead >= least]
            if not (owners > owner).any() and len(live) > k:  # nothing is to come: ties are settled as in the result
                live = live[np.lexsort((everyone[live], orders[live], -total[live]))[:k]]
            out["docs"].append(everyone[live])
            out["orders"].append(orders[live])
            out["scores"].append(total[live])
        for c, parts in out.items():
            ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
            flat = pa.array(np.concatenate(parts) if parts else _NONE)
            items = items.set_column(items.schema.get_field_index(c), c, pa.ListArray.from_arrays(pa.array(ends), flat))
        return items

    return run


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The k documents with the highest score above 0 for each item: item_id, rank (from 1), doc_id, score.

    With N documents that hold a term, L terms in all of them, n in a document, df documents with a term and tf of it in
    one: w = floor(1000 ln((2N+2) / (2df+1))), m = 10 + (90 n N) div L, and an item's terms, once each, add
    w ((10^9 tf) div (1000 tf + 8 m)).  Equal scores go by ascending doc_id.

    Null or empty texts have no terms: such documents take no part, such items have no rows.  Rows with equal or null doc_id
    are documents of their own (a null one comes last among equal scores).  Items that share an item_id (null too) are one
    item with the terms of all.  An item of which no term occurs has no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    asked = materialize(items.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
                        .mapInArrow(_item_terms, "item_id long, term binary").distinct(), "item-terms")
    words = materialize(asked.select("term").distinct().select("term", F.monotonically_increasing_id().alias("key")), "terms")
    counted = (docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
               .mapInArrow(_count_terms, _COUNTED))
    # a marker's term is no item's: it spreads by its row, stays for the totals, and no text is read twice
    postings = materialize(counted.join(words, "term", "left").where("tf = 0 OR key IS NOT NULL").select("row", "doc_id", "n", "key", "tf"), "postings")
    marks, held = postings.where("tf = 0"), postings.where("tf > 0")
    total = marks.agg(F.count("*").alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    n_docs, n_terms = total.N, max(1, total.L)

    part = F.expr(f"(1000000000L * tf) div (1000L * tf + 8L * (10L + (90L * n * {n_docs}L) div {n_terms}L))")
    weight = F.floor(1000 * F.ln((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    owner = F.lit(len(STAGES))
    for i, rare in reversed(list(enumerate(STAGES))):
        owner = F.when(F.col("df") * rare <= n_docs, i).otherwise(owner)
    known = held.groupBy("key").agg(F.count("*").alias("df"), F.max(part).alias("most"))
    known = known.withColumn("w", weight).where("w > 0").select("key", "w", owner.alias("owner"), (F.col("w") * F.col("most")).alias("top"))
    # the bundles' terms: one number for a term wherever it occurs
    n_items = asked.select("item_id").distinct().count()
    bundle = F.pmod(F.xxhash64("item_id"), F.lit(max(1, -(-n_items // ITEMS_PER_BUNDLE)))).cast("int")
    terms = materialize(asked.join(words, "term").join(known, "key").select("item_id", bundle.alias("bundle"), "key", "w", "owner", "top"), "bundle-terms")
    per_bundle = terms.select("bundle", "key", "w", "owner").distinct()
    blocks = max(1, -(-n_docs // DOCS_PER_BLOCK))
    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    by_owner = scratch(spark, "contributions")
    (held.join(per_bundle, "key")
     .select("bundle", block.alias("block"), "row", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("ord"), F.col("key").alias("term_no"),
             (F.col("w") * part).alias("gain"), "owner").write.partitionBy("owner").parquet(by_owner))
    gains = spark.read.schema("bundle int, block int, row long, ord long, term_no long, gain long, owner int").parquet(by_owner)

    none = F.array().cast("array<long>")
    listed = terms.groupBy("item_id", "bundle").agg(F.collect_list(F.struct("key", "owner", "top")).alias("t"))
    state = listed.select(
        "bundle", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "item_id", F.col("t.key").alias("terms"), F.col("t.owner").alias("owners"),
        F.col("t.top").alias("tops"), none.alias("docs"), none.alias("orders"), none.alias("scores"))
    for i in range(len(STAGES) + 1):
        state = state.groupBy("bundle", "block").cogroup(gains.where(F.col("owner") == i).groupBy("bundle", "block")).applyInArrow(_stage(i, k), _STATE)
    found = state.select("item_id", F.explode(F.arrays_zip("docs", "scores")).alias("x")).select("item_id", F.col("x.docs").alias("row"), F.col("x.scores").alias("score"))
    named = found.join(marks.select("row", "doc_id"), "row")
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    return named.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
