"""Op 2, exact top-k search with segment statistics at several resolutions.

For a segment of a vector let m be its mean and s its deviation. The inner product
of two segments of length n is at most ``n * (m1 * m2 + s1 * s2)`` (equally, their
squared distance is at least ``n * ((m1 - m2)**2 + (s1 - s2)**2)``), so coarse
segments rule out candidates, finer ones more of them, and the exact product is
taken for the survivors only. Queries and candidates meet in blocks of bounded
size; each block returns at most k rows a query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotloom.llm.base import stored
from shotloom.operators.common import top_k

LEVELS, QUERY_BLOCK, ROW_BLOCK, STEP = (4, 16), 4096, 8192, 64


def usable(vector: Column) -> Column:
    """Neither null nor with a null, NaN or infinite component."""
    return F.coalesce(vector.isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def stack(vectors, width: int) -> np.ndarray:
    """Rows of one matrix; shorter vectors end in zeros."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of equal segments, scaled so that a dot product bounds the inner product."""
    cut = x.reshape(len(x), segments, -1)
    return np.concatenate([cut.mean(2), cut.std(2)], 1) * np.sqrt(cut.shape[2])


def best_rows(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int):
    """``(query row, row, score)`` of the k largest exact products of every query in one block."""
    width = q.shape[1]
    norm = np.linalg.norm(q, axis=1).max(initial=0) * np.linalg.norm(x, axis=1).max(initial=0)
    slack = 1e-9 * norm + 1e-6  # for rounding in the bounds
    big = width * np.abs(q).max(initial=0) * np.abs(x).max(initial=0) >= 2**53
    exact_type = np.int64 if big else np.float64  # both exact; the second is faster
    qe, xe = q.astype(exact_type), x.astype(exact_type)
    stats_q, stats_x = ([statistics(v, s) for s in LEVELS] for v in (q, x))
    found = []
    for lo in range(0, len(q), STEP):
        hi = min(len(q), lo + STEP)
        own = qid[lo:hi, None] == xid[None, :]
        bound = stats_q[0][lo:hi] @ stats_x[0].T
        bound[own] = -np.inf
        # the k rows of the best bounds give a score that the k-th best reaches
        m = min(k + 1, len(x))
        first = np.argpartition(-bound, m - 1, axis=1)[:, :m]
        seed = np.einsum("ij,ikj->ik", qe[lo:hi], xe[first]).astype(float)
        seed[np.take_along_axis(own, first, 1)] = -np.inf
        floor = -np.sort(-seed, axis=1)[:, min(k, m) - 1:min(k, m)]
        alive = (bound >= floor - slack) & ~own
        for sq, sx in zip(stats_q[1:], stats_x[1:], strict=True):
            cols = np.flatnonzero(alive.any(0))
            alive[:, cols] &= sq[lo:hi] @ sx[cols].T >= floor - slack
        cols = np.flatnonzero(alive.any(0))
        score = qe[lo:hi] @ xe[cols].T
        for i in range(hi - lo):
            keep = cols[alive[i, cols]]
            s = score[i, alive[i, cols]]
            if len(s) > k:
                edge = np.partition(s, len(s) - k)[len(s) - k]
                keep, s = keep[s >= edge], s[s >= edge]
            order = np.lexsort((xid[keep], -s))[:k]
            found += [(lo + i, keep[j], int(s[j])) for j in order]
    return found


def quantised_top_k(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k largest integer products ``floor(256 x)``.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all
    rows with another vec_id, ties go to the smaller vec_id. Vectors that are null or
    hold null or non-finite components, and rows without vec_id, take no part. A
    vec_id met twice as a query is answered once, for its smallest vector; repeated
    candidates count each. Vectors of different lengths meet as if padded with zeros.
    """
    code = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long"))
    rows = stored(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
                  .filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
                  .select("vec_id", code.alias("v")), "topk-rows")
    queries = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    n = rows.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q"),
                 F.max(F.size("v")).alias("d")).first()
    unit = max(LEVELS)
    width = -(-(n.d or 1) // unit) * unit
    q_blocks, x_blocks = max(1, -(-n.q // QUERY_BLOCK)), max(1, -(-n.n // ROW_BLOCK))
    all_q, all_x = (F.explode(F.sequence(F.lit(0), F.lit(b - 1))) for b in (q_blocks, x_blocks))
    left = queries.select(F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)).cast("int").alias("qb"), all_x.alias("xb"), "vec_id", "v")
    # any even deal of the rows will do; the row number keeps repeated rows apart
    right = (rows.withColumn("xb", F.pmod(F.monotonically_increasing_id(), F.lit(x_blocks)).cast("int"))
             .select(all_q.alias("qb"), "xb", "vec_id", "v"))

    def meet(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        qid, xid = q["vec_id"].to_numpy(), x["vec_id"].to_numpy()
        found = best_rows(stack(q["v"], width), qid, stack(x["v"], width), xid, k) if len(q) and len(x) else []
        return pd.DataFrame({"query_id": [qid[i] for i, _, _ in found], "vec_id": [xid[j] for _, j, _ in found],
                             "score": [s for _, _, s in found]}, dtype="int64")

    pairs = (left.groupBy("qb", "xb").cogroup(right.groupBy("qb", "xb"))
             .applyInPandas(meet, "query_id long, vec_id long, score long"))
    ranked = top_k(pairs, ["query_id"], [F.col("score").desc(), F.col("vec_id")], k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
