"""Op 10, best-fit packing into bins of several permitted sizes.

Best-fit decreasing runs on the table of piece lengths (at most ``max(sizes)``
rows, whatever the corpus), moving whole runs of equal bins at once; the plan says
which ranks of each length go to which bins. Pieces are then ranked within their
length by a distributed prefix count and look up their bin, so the packing is the
global one while no task sees more than its range.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotloom.llm.base import stored, word_count
from shotloom.operators.common import ordered_prefix

SIZES = (512, 1024, 2048, 4096)


def bin_cost(size: int) -> float:
    """Cost of a sequence: its slots, with attention growing by the square, and a fixed share."""
    return 16 + size * (1 + size / 32768)


@dataclass
class Plan:
    """Runs of ranks and the bins they fill; columns are parallel arrays, sorted for lookup.

    ``runs``: length, first rank, first bin, pieces a bin, offset in the bin.
    ``bins``: first bin of a run of equal bins, their contents and final size.
    """

    runs: np.ndarray
    bins: np.ndarray


def best_fit(counts: dict[int, int], sizes: tuple[int, ...] = SIZES) -> Plan:
    """Best-fit decreasing of ``counts[length]`` pieces; all lengths are 1..max(sizes)."""
    sizes = tuple(sorted(sizes))
    left = np.zeros(sizes[-1] + 1, np.int64)  # tokens not yet placed, by length
    for length, c in counts.items():
        left[length] = length * c
    rooms: list[int] = []  # free rooms of open bins, ascending
    open_: dict[int, list[tuple[int, int, int]]] = {}  # room -> runs of (first bin, bins, size)
    runs, bins_made = [], 0

    def put(room: int, run: tuple[int, int, int]) -> None:
        if run[1]:
            if room not in open_:
                insort(rooms, room)
                open_[room] = []
            open_[room].append(run)

    for length in sorted(counts, reverse=True):
        todo, rank = counts[length], 0
        left[length] = 0
        smaller = np.cumsum(left)
        while todo:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, bins, size = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            else:
                # the size with the least cost for each token it can be expected to hold
                waiting = todo * length
                size = min((s for s in sizes if s >= length), key=lambda s: bin_cost(s) / min(
                    s, min(waiting, s // length * length) + int(smaller[s - length])))
                room, first, bins = size, bins_made, -(-todo // (size // length))
                bins_made += bins
            each = room // length
            full = min(bins, todo // each)
            some = todo - full * each if full < bins else 0
            if full:
                runs.append((length, rank, first, each, size - room))
                put(room - each * length, (first, full, size))
            if some:
                runs.append((length, rank + full * each, first + full, each, size - room))
                put(room - some * length, (first + full, 1, size))
            rest = first + full + (some > 0)
            put(room, (rest, first + bins - rest, size))
            placed = full * each + some
            rank, todo = rank + placed, todo - placed
    done = sorted((first, size - room) for room, rs in open_.items() for first, _, size in rs)
    fitted = [(first, used, next(s for s in sizes if s >= used)) for first, used in done]
    runs.sort()
    return Plan(np.array(runs, np.int64).reshape(-1, 5), np.array(fitted, np.int64).reshape(-1, 3))


def pieces(docs: DataFrame, longest: int) -> DataFrame:
    """``(doc_id, piece, start, length)``: each text cut every ``longest`` words; one empty piece if wordless."""
    n = word_count(F.col("text"))
    last = F.greatest(F.lit(0), F.ceil(F.col("n") / longest) - 1).cast("int")
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("n"))
            .select("doc_id", "n", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
            .withColumn("start", F.col("piece") * F.lit(longest).cast("long"))
            .select("doc_id", "piece", "start", F.least(F.col("n") - F.col("start"), F.lit(longest)).alias("length")))


def pack(docs: DataFrame, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """Every piece of every document with its place in a bin.

    Columns: ``doc_id, piece, start, length`` (words from ``start``), ``bin_id,
    bin_offset, bin_size, bin_used``. No bin overflows, pieces of a bin do not
    overlap, and ``bin_size`` is the smallest permitted size that holds
    ``bin_used``. Null and wordless texts give one row of length 0 without a bin.
    Rows that share a doc_id, equal or not, are packed separately.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, max(sizes)), "pack-pieces")
    words = cut.filter("length > 0")
    counts = {r.length: r.n for r in words.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(best_fit(counts, sizes))
    ranked = ordered_prefix(words.withColumn("h", F.xxhash64("doc_id", "piece")), ["length"], ["h", "doc_id", "piece"])

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs, bins = plan.value.runs, plan.value.bins
        step = int(runs[:, 1].max(initial=0)) + 1
        keys = runs[:, 0] * step + runs[:, 1]
        for f in frames:
            rank = f.pop("_pos").to_numpy()
            length = f["length"].to_numpy()
            at = np.searchsorted(keys, length * step + np.minimum(rank, step - 1), side="right") - 1
            _, first, start, each, offset = runs[at].T
            f["bin_id"] = start + (rank - first) // each
            f["bin_offset"] = offset + (rank - first) % each * length
            of = np.searchsorted(bins[:, 0], f["bin_id"].to_numpy(), side="right") - 1
            f["bin_size"], f["bin_used"] = bins[of, 2], bins[of, 1]
            yield f

    base = ["doc_id", "piece", "start", "length"]
    added = {"bin_id": "long", "bin_offset": "long", "bin_size": "long", "bin_used": "long"}
    schema = "doc_id long, piece int, start long, length long, " + ", ".join(f"{k} {v}" for k, v in added.items())
    placed = ranked.select(*base, "_pos").mapInPandas(place, schema)
    empty = cut.filter("length = 0").select(*base, *[F.lit(None).cast(v).alias(k) for k, v in added.items()])
    return placed.union(empty)
