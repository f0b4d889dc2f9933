"""Op 3, mixing sources to target weights.

Rows get hash-random keys, are range-sorted within their source, and distributed
prefix sums of their sizes cut every source at its exact budget; whole epochs come
first when a budget exceeds the source. A range of keys is a fixed slice of the
hash space, so a hot source is many small ranges, and a rerun repeats the cut.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotloom.llm.base import stored, word_count
from shotloom.operators.common import broadcast_if_bounded, dense_index

WEIGHTS, CAP, SEED = (1.0, 2.0, 3.0), 3, "mix-1"
MIN_SLICES, ROWS_PER_SLICE = 64, 100_000


def source_key(source: Column) -> tuple[Column, Column]:
    """(null flag, name): orders sources by code point with null last, and joins null to null."""
    return source.isNull().cast("int"), F.coalesce(source.cast("string"), F.lit(""))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """``(sn, sk, source_size, target)`` per source of ``sizes(sn, sk, size)``.

    The k-th source weighs ``weights[k % len]``. Targets share the total size by
    weight; one above ``cap`` times its source stops there and its excess is shared
    again, until none is above.
    """
    per = sizes.groupBy("sn", "sk").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*map(F.lit, weights))
    per = stored(dense_index(per, [], ["sn", "sk"], "k")
                 .withColumn("w", F.element_at(cycle, (F.col("k") % len(weights) + 1).cast("int"))), "mix-sources")
    total = float(per.agg(F.sum("source_size")).first()[0] or 0)
    most = F.col("source_size") * F.lit(float(cap))
    rate, capped = 0.0, -1
    while True:  # each round stops at least one more source
        stop = most <= F.col("w") * F.lit(rate)
        row = per.agg(F.count_if(stop).alias("n"), F.sum(F.when(stop, most).otherwise(0.0)).alias("used"),
                      F.sum(F.when(stop, 0.0).otherwise(F.col("w"))).alias("w")).first()
        if row.n == capped or not row.w:
            break
        rate, capped = (total - row.used) / row.w, row.n
    return per.select("sn", "sk", "source_size", F.least(most, F.col("w") * F.lit(rate)).alias("target"))


def row_key(seed: str) -> Column:
    """Hash-random key of a document: of its id and its text, so that rows without id or with the same id spread."""
    return F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("long").cast("string"), F.md5(F.col("text").cast("binary"))))


def mix_plan(docs: DataFrame, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """Rows ``(doc_id, h, size, copies, part, ...)`` of the mix and the per-source targets.

    A row is taken ``copies`` times whole and once more for its first ``part`` words.
    Equal rows are one row with a count until the sums are known, however many there are.
    """
    sn, sk = source_key(F.col("source"))
    rows = docs.select(F.col("doc_id").cast("long"), sn.alias("sn"), sk.alias("sk"),
                       word_count(F.col("text")).alias("size"), row_key(seed).alias("h"))
    rows = stored(rows.groupBy("doc_id", "sn", "sk", "size", "h").agg(F.count("*").alias("times")), "mix-rows")
    goal = targets(rows.select("sn", "sk", (F.col("size") * F.col("times")).alias("size")))
    slices = max(MIN_SLICES, -(-rows.count() // ROWS_PER_SLICE))
    at = F.floor(F.conv(F.substr("h", F.lit(1), F.lit(8)), 16, 10).cast("double") / 2**32 * slices).cast("int")
    rows = rows.withColumn("slice", at).withColumn("all", F.col("size") * F.col("times"))
    before = Window.partitionBy("sn", "sk").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("sn", "sk", "slice").agg(F.sum("all").alias("s"))
    offsets = sums.withColumn("offset", F.coalesce(F.sum("s").over(before), F.lit(0))).drop("s")
    budget = goal.select("sn", "sk", "source_size", "target",
                         F.floor(F.col("target") + 0.5).cast("long").alias("budget"))
    offsets = offsets.join(broadcast_if_bounded(budget, 100_000)[0], ["sn", "sk"])
    within = (Window.partitionBy("sn", "sk", "slice").orderBy("h", "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cut = (rows.withColumn("first", F.sum("all").over(within) - F.col("all")).join(offsets, ["sn", "sk", "slice"])
           .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1))))
    once = F.greatest(F.col("source_size"), F.lit(1))
    left = F.col("budget") % once - F.col("offset") - F.col("first") - F.col("copy") * F.col("size")
    part = F.least(F.greatest(left, F.lit(0)), F.col("size"))
    full = F.floor(F.col("budget") / once).cast("long") + F.when(part == F.col("size"), 1).otherwise(0)
    plan = cut.select("doc_id", "sn", "sk", "h", "size", "source_size", "target",
                      F.when(F.col("size") > 0, full).otherwise(F.lit(0)).cast("long").alias("copies"),
                      F.when(part == F.col("size"), 0).otherwise(part).cast("long").alias("part"))
    return plan, goal


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """Per document ``doc_id, size, source_size, target, taken``; taken sums to each source's rounded target.

    Null or wordless texts have size 0 and are not taken; rows with the same doc_id
    are separate rows; a null source is a source of its own, after all others.
    """
    plan, _ = mix_plan(docs, seed)
    return plan.select("doc_id", "size", "source_size", "target",
                       (F.col("copies") * F.col("size") + F.col("part")).alias("taken"))


def mixed_documents(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``.

    Documents stay whole: one that the cut meets stays if at least half of it fits.
    Wordless documents stay once. Rows that share doc_id, text and source are taken alike.
    """
    plan, _ = mix_plan(docs, seed)
    times = (F.col("copies") + F.when(2 * F.col("part") >= F.col("size"), F.when(F.col("part") > 0, 1).otherwise(0))
             .otherwise(0))
    times = F.when(F.col("size") > 0, times).otherwise(1)
    names = {c: f"_{c}_{uuid.uuid4().hex[:8]}" for c in ("h", "sn", "sk", "times", "copy")}
    take = (plan.select(*[F.col(c).alias(names[c]) for c in ("h", "sn", "sk")], times.alias("times"))
            .groupBy(names["h"], names["sn"], names["sk"]).agg(F.max("times").cast("int").alias(names["times"]))
            .filter(F.col(names["times"]) > 0))
    sn, sk = source_key(F.col("source"))
    marked = docs.select("*", row_key(seed).alias(names["h"]), sn.alias(names["sn"]), sk.alias(names["sk"]))
    out = marked.join(take, [names["h"], names["sn"], names["sk"]])
    copies = F.explode(F.sequence(F.lit(1), F.col(names["times"]))).alias(names["copy"])
    return out.select(*docs.columns, copies).drop(names["copy"])
