"""Exact top-k by integer inner product: exhaustive term-at-a-time accumulation over blocks of candidates.

A vector is a sparse row of (term, weight): its non-zero components.  Candidates are cut into blocks, queries into
blocks; for a pair of blocks, the postings of each term (the block's candidates that hold it, with their weights) are
scattered, times the query's weight, into a dense score array.  Partition selection keeps a query's best k of a block;
the blocks' lists are merged by rank.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fianchetto.llm.common import materialize

#: Rows of a block of candidates and of a block of queries: the score array of a cell has at most their product.
CANDIDATES_PER_BLOCK = 2048
QUERIES_PER_BLOCK = 512
#: Terms that are accumulated into the scores of all of a block's queries at once.
HIT_SCHEMA = "query_row long, query_id long, row long, vec_id long, score long"


def quantized(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component, x as double; null if the vector is null or has a null or non-finite x."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)), whole)


def _dense(rows) -> np.ndarray:
    """Rows of differing lengths as one matrix; what a row lacks is zero."""
    width = max((len(r) for r in rows), default=0)
    if all(len(r) == width for r in rows):
        return np.array([np.asarray(r, np.int64) for r in rows], np.int64).reshape(len(rows), width)
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Scores of all queries against all candidates, one term after the other."""
    scores = np.zeros((len(queries), len(candidates)), np.int64)
    for t in range(min(queries.shape[1], candidates.shape[1])):
        holders = np.flatnonzero(candidates[:, t])  # the postings of term t
        weights = candidates[holders, t]
        asking = np.flatnonzero(queries[:, t])
        if len(holders) == len(candidates) and len(asking) == len(queries):
            scores += queries[:, t, None] * weights
        else:
            scores[np.ix_(asking, holders)] += queries[asking, t, None] * weights
    return scores


def _select(k: int):
    def run(key, left, right):
        import pandas as pd

        right = right.sort_values(["vec_id", "row"], kind="stable")
        ids, rows = right["vec_id"].to_numpy(), right["row"].to_numpy()
        out = []
        if len(ids) and len(left):
            scores = accumulate(_dense(list(left["terms"])), _dense(list(right["terms"])))
            for q, q_row, row in zip(left["query_id"].to_numpy(), left["query_row"].to_numpy(), scores, strict=True):
                keep = np.flatnonzero(rows != q_row)
                if len(keep) > k:
                    own = row[keep]
                    least = np.partition(own, len(own) - k)[len(own) - k]  # the k-th best score
                    sure, tied = keep[own > least], keep[own == least]
                    keep = np.concatenate((sure, tied[: k - len(sure)]))  # ids ascend: ties go to the smaller
                out.append(pd.DataFrame({"query_row": q_row, "query_id": q, "row": rows[keep], "vec_id": ids[keep], "score": row[keep]}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("query_row", "query_id", "row", "vec_id", "score")}, dtype="int64")

    return run


def top_k(vectors: DataFrame, k: int = 10, query_step: int = 100, scale: int = 1024, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """The k best of all other rows for every row whose id is divisible by ``query_step``, by exact inner product.

    Returns query_id, rank (from 1), vec_id, score; all others if there are fewer than k; ties go to the smaller vec_id.
    Rows with a null id, or with a vector that is null or has a null or non-finite component, take no part.  An empty
    vector scores 0; a shorter one counts as zero where it ends.  Rows that share an id are candidates each, also for one
    another, and queries each.  Scores are 64-bit integers: components must stay below 2^53 / ``scale``, and the sums of
    their products below 2^63.  Other columns are not read.
    """
    # each row has a number of its own, written with it
    rows = materialize(vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"),
                                      quantized(F.col(vector_col), scale).alias("terms"))
                       .where("vec_id IS NOT NULL AND terms IS NOT NULL"), "vectors")
    asked = F.col("vec_id") % query_step == 0
    n, q = rows.agg(F.count("vec_id"), F.count_if(asked)).first()
    across, down = max(1, -(-n // CANDIDATES_PER_BLOCK)), max(1, -(-q // QUERIES_PER_BLOCK))
    # every cell (block of queries, block of candidates) gets its queries and its candidates once
    queries = rows.where(asked).select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), "terms",
                                       F.pmod(F.xxhash64("row"), F.lit(down)).cast("int").alias("qb"),
                                       F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("cb"))
    candidates = rows.select("row", "vec_id", "terms", F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("qb"),
                             F.pmod(F.xxhash64("row"), F.lit(across)).cast("int").alias("cb"))
    hits = queries.groupBy("qb", "cb").cogroup(candidates.groupBy("qb", "cb")).applyInPandas(_select(k), HIT_SCHEMA)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return (hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
