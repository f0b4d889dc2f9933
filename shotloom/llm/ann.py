"""Op 6, approximate nearest neighbours by cross-polytope hashing.

``TABLES`` pseudo-rotations (three rounds of random signs and a fast Hadamard
transform) send a unit vector to its nearest signed axis. A query probes, in each
table, the buckets of its best axes until they hold ``SHARE`` of the vectors (at
least ``LEAST``); the vectors found are reranked by their exact product. Equal
vectors are one entry. Buckets and queries meet in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotloom.llm.base import stored
from shotloom.llm.topk import stack, usable
from shotloom.operators.common import top_k

TABLES, SHARE, LEAST, SEED = 4, 0.15, 2000, 77
BUCKET_BLOCK, QUERY_BLOCK = 4096, 2048


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (width a power of two), without scaling."""
    n, d = x.shape
    h = 1
    while h < d:
        pairs = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x


def axes(x: np.ndarray, t: int) -> np.ndarray:
    """Coordinates on the signed axes of table t (rows x twice the width); the largest is the bucket."""
    signs = np.random.default_rng([SEED, t]).choice([-1.0, 1.0], (3, x.shape[1]))
    for s in signs:
        x = hadamard(x * s)
    return np.concatenate([x, -x], 1)


def _width(d: int) -> int:
    return 1 << max(0, d - 1).bit_length()


def distinct_vectors(vectors: DataFrame, keep: int) -> DataFrame:
    """``(cls, rn, vec_id, v)``: the ``keep`` smallest ids of each distinct vector; cls is the smallest.

    No more ids of one vector can be among a query's nearest, as equal scores go to the smaller id.
    """
    rows = top_k(vectors, ["v"], [F.col("vec_id")], keep, "rn")
    first = rows.filter("rn = 1").select("v", F.col("vec_id").alias("cls"))
    return rows.join(first, "v").select("cls", "rn", "vec_id", "v")


def nearest(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k largest inner products found for each query.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all
    rows with another vec_id; ties go to the smaller vec_id. Vectors that are null,
    zero or hold null or non-finite components, and rows without vec_id, take no
    part; repeated rows count once. Shorter vectors meet longer ones as if padded.
    """
    rows = (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
            .filter(F.col("vec_id").isNotNull() & usable(F.col("v")) & F.exists("v", lambda x: x != 0)).distinct())
    rows = stored(rows, "ann-rows")
    base = stored(distinct_vectors(rows, k + 1), "ann-distinct")
    entries = base.filter("rn = 1").select("cls", "v")
    asked = (rows.filter(F.col("vec_id") % every == 0)
             .join(entries, "v").select(F.col("vec_id").alias("query_id"), "cls"))
    queries = asked.select("cls").distinct().join(entries, "cls")
    size = entries.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    width = _width(size.d or 1)

    def file(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = stack(f["v"], width)
            for t in range(TABLES):
                yield pd.DataFrame({"t": t, "bucket": axes(x, t).argmax(1), "cls": f["cls"], "v": f["v"]})

    v_type = entries.schema["v"].dataType.simpleString()
    index = stored(entries.mapInPandas(file, f"t int, bucket int, cls long, v {v_type}"), "ann-index")
    counts = np.zeros((TABLES, 2 * width), np.int64)
    for r in index.groupBy("t", "bucket").agg(F.count("*").alias("n")).collect():  # TABLES x 2 x width rows
        counts[r.t, r.bucket] = r.n
    blocks = np.maximum(1, -(-counts // BUCKET_BLOCK))
    need = max(LEAST, SHARE * size.n)
    q_blocks = max(1, -(-queries.count() // QUERY_BLOCK))

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x, v, cls = stack(f["v"], width), f["v"].to_numpy(), f["cls"].to_numpy()
            for t in range(TABLES):
                order = np.argsort(-axes(x, t), axis=1, kind="stable")
                held = np.cumsum(counts[t][order], axis=1)
                use = np.concatenate([np.ones((len(x), 1), bool), held[:, :-1] < need], 1) & (counts[t][order] > 0)
                i, j = np.nonzero(use)
                b = order[i, j]
                times = blocks[t, b]
                i, b = np.repeat(i, times), np.repeat(b, times)
                blk = np.arange(len(b)) - np.repeat(np.cumsum(times) - times, times)
                yield pd.DataFrame({"t": t, "bucket": b, "blk": blk, "qb": cls[i] % q_blocks, "cls": cls[i], "v": v[i]})

    probes = queries.mapInPandas(probe, f"t int, bucket int, blk int, qb int, cls long, v {v_type}")
    grid = F.broadcast(index.sparkSession.createDataFrame(
        [(t, b, int(blocks[t, b])) for t in range(TABLES) for b in range(2 * width)], "t int, bucket int, blks int"))
    filed = (index.join(grid, ["t", "bucket"])
             .select("t", "bucket", F.pmod(F.xxhash64("cls"), F.col("blks")).cast("int").alias("blk"),
                     F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"), "cls", "v"))

    def rerank(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"q": [], "cls": [], "score": []})
        a, b = stack(q["v"], width), stack(x["v"], width)
        qid, xid, m = q["cls"].to_numpy(), x["cls"].to_numpy(), min(k + 1, len(x))
        out = []
        for lo in range(0, len(a), 256):
            s = a[lo:lo + 256] @ b.T
            # a margin over m keeps all that rounding could have moved past the edge
            edge = -np.partition(-s, m - 1, axis=1)[:, m - 1:m]
            i, j = np.nonzero(s >= edge - 1e-9 * (1 + np.abs(edge)))
            exact = np.array([(a[lo + p] * b[r]).sum() for p, r in zip(i, j, strict=True)]) \
                if len(i) < 64 else (a[lo + i] * b[j]).sum(1)
            order = np.lexsort((xid[j], -exact, i))
            i, j, exact = i[order], j[order], exact[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            i, j, exact = i[place < m], j[place < m], exact[place < m]
            out.append(pd.DataFrame({"q": qid[lo + i], "cls": xid[j], "score": exact}))
        return pd.concat(out)

    keys = ["t", "bucket", "blk", "qb"]
    found = (probes.groupBy(*keys).cogroup(filed.groupBy(*keys))
             .applyInPandas(rerank, "q long, cls long, score double"))
    best = top_k(found.groupBy("q", "cls").agg(F.max("score").alias("score")), ["q"],
                 [F.col("score").desc(), F.col("cls")], k + 1, "place")
    members = base.select("cls", "vec_id")
    answers = (asked.withColumnRenamed("cls", "q").join(best.drop("place"), "q").join(members, "cls")
               .filter("vec_id <> query_id"))
    ranked = top_k(answers, ["query_id"], [F.col("score").desc(), F.col("vec_id")], k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
