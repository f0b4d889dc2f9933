"""Demonstration retrieval for all targets at once.

Common output: one row per (target, demonstration) with ``rank`` 1..k; ties are
always broken by ascending demonstration id (X9).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotloom.functions import hashing
from shotloom.operators.common import block_pairs, join_small_side, ordered_prefix, shuffled, spread, stored, top_k
from shotloom.session import CONF_BROADCAST_ROWS, conf_int


def validate_k(k: int, pool_size: int | None = None) -> None:
    """0 <= k (<= pool size when the size is known)."""
    if k < 0 or (pool_size is not None and k > pool_size):
        raise ValueError(f"number of demonstrations {k} outside [0, {pool_size}]")


def _first_ids(pool: DataFrame, pool_id: str, n: int) -> Column:
    """Scalar subquery: array of the ``n`` smallest pool ids (bounded top-n, id column only)."""
    return (pool.select(F.col(pool_id).alias("_i")).orderBy("_i").limit(n)
                .agg(F.sort_array(F.collect_list("_i"))).scalar())


# --- R1 first k -------------------------------------------------------------------

def first_k(targets: DataFrame, pool: DataFrame, k: int, target_id: str = "idx",
            pool_id: str = "idx") -> DataFrame:
    """The first k pool rows (by id) for every target; no join, one bounded top-k."""
    validate_k(k)
    ids = _first_ids(pool, pool_id, k)
    return (targets.select(F.col(target_id).alias("target_id"),
                           F.posexplode(ids).alias("pos", "demo_id"))
                   .select("target_id", "demo_id", (F.col("pos") + 1).cast("bigint").alias("rank")))


# --- R5 Jaccard ---------------------------------------------------------------------

#: Rare tokens of a target that propose its first candidates, and how many of those are scored.
SEED_TOKENS, SEED_CANDIDATES = 8, 4


def _exact_jaccard(pairs: DataFrame, t: DataFrame, p: DataFrame) -> DataFrame:
    """(target_id, demo_id, score) of the given pairs from their whole token sets."""
    inter = F.size(F.array_intersect("ts", "ps"))
    union = F.col("na") + F.col("nb") - inter
    score = F.when(union == 0, F.lit(0.0)).otherwise(inter.cast("double") / union.cast("double"))
    both = join_small_side(pairs.select("target_id", "demo_id"), t.select("target_id", "na", "ts"), ["target_id"],
                           F.col("demo_id"))
    return both.join(p, "demo_id").select("target_id", "demo_id", score.alias("score"))


def jaccard(targets: DataFrame, pool: DataFrame, k: int, target_id: str = "idx",
            target_toks: str = "toks", pool_id: str = "idx", pool_toks: str = "toks",
            exclude_self: bool = False) -> DataFrame:
    """Exact top-k by token-set Jaccard with zero-overlap backfill by ascending id.

    A target's rarest tokens propose a few demos, whose k-th best score bounds the
    answer from below. A demo that reaches the bound shares at least
    ``ceil(bound * na)`` of the target's ``na`` tokens, so it shares one of all but
    that many less one: the most frequent tokens are never joined. Size and count
    bounds prune what these postings bring, and only the rest is scored on whole sets.
    Joins are broadcast after a size check, else salted; targets with fewer than k
    overlapping demos are filled from the k smallest pool ids.
    """
    validate_k(k)
    t = stored(targets.select(F.col(target_id).alias("target_id"), F.array_distinct(F.col(target_toks)).alias("ts"))
               .withColumn("na", F.size("ts")), "jac-targets")
    p = stored(spread(pool).select(F.col(pool_id).alias("demo_id"), F.array_distinct(F.col(pool_toks)).alias("ps"))
               .withColumn("nb", F.size("ps")), "jac-pool")
    # explode_outer + an explicit null filter: a plain explode lets the optimizer infer a size(...) > 0 filter
    tpost = t.select("target_id", "na", F.explode_outer("ts").alias("tok")).filter(F.col("tok").isNotNull())
    ppost = p.select("demo_id", "nb", F.explode_outer("ps").alias("tok")).filter(F.col("tok").isNotNull())
    asked = tpost.select("tok").distinct()
    freq = join_small_side(ppost, asked, ["tok"], F.col("demo_id")).groupBy("tok").agg(F.count("*").alias("f"))
    rarest = Window.partitionBy("target_id").orderBy("f", "tok")
    tpost = stored(tpost.join(freq, "tok", "left").withColumn("f", F.coalesce("f", F.lit(0)))
                   .withColumn("place", F.row_number().over(rarest))
                   .withColumn("found", F.sum((F.col("f") > 0).cast("int")).over(
                       rarest.rowsBetween(Window.unboundedPreceding, Window.currentRow))), "jac-tokens")
    seeds = tpost.filter((F.col("f") > 0) & (F.col("found") <= SEED_TOKENS)).select("target_id", "tok")
    n = k + (1 if exclude_self else 0)
    near = (join_small_side(ppost, seeds, ["tok"], F.col("demo_id")).groupBy("target_id", "demo_id")
            .agg(F.count("*").alias("c")))
    near = top_k(near, ["target_id"], [F.col("c").desc(), F.col("demo_id").asc()], SEED_CANDIDATES * n, "_r")
    first = _exact_jaccard(near, t, p)
    if exclude_self:
        first = first.filter(F.col("target_id") != F.col("demo_id"))
    bound = (top_k(first, ["target_id"], [F.col("score").desc(), F.col("demo_id").asc()], k, "_r")
             .filter(F.col("_r") == k).select("target_id", (F.col("score") - 1e-9).alias("bound")))
    tpost = stored(tpost.join(bound, "target_id", "left").withColumn("bound", F.greatest(
        F.coalesce("bound", F.lit(0.0)), F.lit(0.0))), "jac-bounded")
    left_out = F.greatest(F.ceil(F.col("bound") * F.col("na")) - 1, F.lit(0))
    prefix = tpost.filter((F.col("place") <= F.col("na") - left_out) & (F.col("f") > 0))
    prefix = prefix.select("target_id", "na", "bound", left_out.alias("rest"), "tok")
    hits = (join_small_side(ppost, prefix, ["tok"], salt_of=F.col("demo_id"))
            .filter((F.col("nb") >= F.col("bound") * F.col("na")) & (F.col("nb") * F.col("bound") <= F.col("na")))
            .groupBy("target_id", "demo_id", "na", "nb", "bound", "rest").agg(F.count("*").alias("c")))
    need = F.col("bound") / (1 + F.col("bound")) * (F.col("na") + F.col("nb"))
    pairs = hits.filter(F.col("c") + F.col("rest") >= need)
    if exclude_self:
        pairs = pairs.filter(F.col("target_id") != F.col("demo_id"))
    scored = _exact_jaccard(pairs, t, p)
    fills = t.select("target_id", F.explode(_first_ids(pool, pool_id, n)).alias("demo_id"), F.lit(0.0).alias("score"))
    if exclude_self:
        fills = fills.filter(F.col("target_id") != F.col("demo_id"))
    best = scored.unionByName(fills).groupBy("target_id", "demo_id").agg(F.max("score").alias("score"))
    out = top_k(best, ["target_id"], [F.col("score").desc(), F.col("demo_id").asc()], k)
    return out.select("target_id", "demo_id", F.round("score", 6).alias("score"), "rank")


def jaccard_pair(a: Column, b: Column) -> Column:
    """Jaccard of two token arrays as a column (0 when both are empty)."""
    inter = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(inter.cast("double") / union.cast("double"))


# --- R2 / R4 seeded sampling ---------------------------------------------------------

#: Pool rows of a sampling bucket, as a multiple of the wanted picks.
BUCKET_PICKS = 8


def seeded_sample(targets: DataFrame, pool: DataFrame, k: int, seed: int,
                  target_id: str = "idx", pool_id: str = "idx",
                  target_group: str | None = None, pool_group: str | None = None,
                  exclude_self: bool = False, start_window: int = 4) -> DataFrame:
    """Seeded k-sample without replacement per target, optionally within a group.

    Each pool row gets ``u = uniform(seed, id)`` and each target a start
    ``s = uniform(seed, 't', id)``; a target takes the k rows of its group that
    follow ``s`` on the circle, i.e. smallest ``h = (u - s) mod 1`` (X6: no shared
    random stream, so results do not depend on order or partitioning).

    Pool rows are bucketed by ``floor(u * B_g)``, about ``BUCKET_PICKS * k`` rows a bucket. A
    target meets the sorted ids of its bucket and the next one as one array, and keeps
    its k picks at once; only the rare targets with fewer than k complete candidates
    there join more buckets, widening (x4). Exact, and the work is O(targets * k)
    rather than all pairs.
    """
    validate_k(k)
    if k == 0:
        return targets.select(F.col(target_id).alias("target_id"),
                              F.lit(None).cast("bigint").alias("demo_id"),
                              F.lit(None).cast("double").alias("score"),
                              F.lit(None).cast("bigint").alias("rank")).limit(0)
    tg = F.col(target_group) if target_group else F.lit("")
    pg = F.col(pool_group) if pool_group else F.lit("")
    p = pool.select(F.col(pool_id).alias("demo_id"), pg.cast("string").alias("grp"))
    p = stored(p.withColumn("u", hashing.uniform(seed, F.col("demo_id"))), "sample-pool")
    grouped = target_group is not None or pool_group is not None
    if grouped:
        sizes = p.groupBy("grp").agg(F.count("*").alias("n_g"))
        sizes = sizes.withColumn("B", F.greatest(F.lit(1), F.ceil(F.col("n_g") / F.lit(BUCKET_PICKS * k))).cast("bigint"))
        sizes = stored(sizes, "sample-sizes")
        p = join_small_side(p, sizes, ["grp"], F.col("demo_id"))
    else:
        # One group: its bucket count is a scalar subquery, not a join on a constant key.
        n_all = p.agg(F.count("*")).scalar()
        p = p.withColumn("B", F.greatest(F.lit(1), F.ceil(n_all / F.lit(BUCKET_PICKS * k))).cast("bigint"))
    p = p.withColumn("bucket", F.floor(F.col("u") * F.col("B")).cast("bigint"))
    t = targets.select(F.col(target_id).alias("target_id"), tg.cast("string").alias("grp"))
    t = t.withColumn("s", hashing.uniform(seed, "t", F.col("target_id")))
    if grouped:
        t = join_small_side(t, sizes, ["grp"], F.col("target_id"))
    else:
        t = t.withColumn("B", F.greatest(F.lit(1), F.ceil(n_all / F.lit(BUCKET_PICKS * k))).cast("bigint"))
    t = stored(t.withColumn("b0", F.floor(F.col("s") * F.col("B")).cast("bigint")), "sample-targets")
    need = k

    both = F.explode(F.array_distinct(F.array("bucket", F.pmod(F.col("bucket") - 1, F.col("B")))))
    near = (p.filter(F.col("bucket").isNotNull()).select("grp", "u", "demo_id", both.alias("b0"))
            .groupBy("grp", "b0").agg(F.collect_list(F.struct("u", "demo_id")).alias("near")))
    turn = F.transform("near", lambda c: F.struct(
        F.when(c["u"] < F.col("s"), c["u"] - F.col("s") + F.lit(1.0)).otherwise(c["u"] - F.col("s")).alias("h"),
        c["demo_id"].alias("demo_id")))
    whole = F.col("B") <= 2
    inside = F.filter(turn, lambda c: (whole | (c["h"] < F.lit(1) / F.col("B")))
                      & ((c["demo_id"] != F.col("target_id")) if exclude_self else F.lit(True)))
    first = (t.join(near, ["grp", "b0"], "left")
             .withColumn("picks", F.slice(F.sort_array(inside), 1, k)).drop("near"))
    first = stored(first.withColumn("done", whole | F.coalesce(F.size("picks") >= need, F.lit(False))), "sample-first")
    picked = F.explode("picks").alias("c")
    results = [first.filter("done").select("target_id", picked).select("target_id", "c.demo_id", "c.h")]
    window = start_window
    pending = first.filter("not done").drop("picks", "done")
    while not pending.isEmpty():
        # Offsets 0..W (capped at B-1, which covers the whole group).
        span = F.least(F.lit(window), F.col("B") - 1)
        probe = pending.select("target_id", "grp", "s", "B", span.alias("W"),
                               F.explode(F.sequence(F.lit(0), span)).alias("off"), "b0")
        probe = probe.select("target_id", "grp", "s", "B", "W",
                             F.pmod(F.col("b0") + F.col("off"), F.col("B")).alias("bucket"))
        # (grp, bucket) keys hold ~k pool rows each by construction: no hot key, plain shuffle join.
        cand = p.select("grp", "bucket", "demo_id", "u").join(probe, ["grp", "bucket"])
        if exclude_self:
            cand = cand.filter(F.col("target_id") != F.col("demo_id"))
        h = F.col("u") - F.col("s")
        cand = cand.withColumn("h", F.when(h < 0, h + F.lit(1.0)).otherwise(h))
        complete = F.col("W") >= F.col("B") - 1
        cand = cand.withColumn("sure", complete | (F.col("h") < F.col("W") / F.col("B")))
        cand = stored(cand, "sample-candidates")
        stats = cand.groupBy("target_id").agg(F.sum(F.col("sure").cast("int")).alias("n_sure"))
        st = pending.select("target_id", span.alias("W"), "B").join(stats, "target_id", "left")
        done = st.filter((F.coalesce(F.col("n_sure"), F.lit(0)) >= need)
                         | (F.col("W") >= F.col("B") - 1)).select("target_id")
        results.append(cand.join(done, "target_id", "left_semi").select("target_id", "demo_id", "h"))
        pending = stored(pending.join(done, "target_id", "left_anti"), "sample-pending")
        window *= 4
    allc = results[0]
    for r in results[1:]:
        allc = allc.unionByName(r)
    out = top_k(allc, ["target_id"], [F.col("h").asc(), F.col("demo_id").asc()], k)
    return out.select("target_id", "demo_id", F.round("h", 9).alias("score"), "rank")


def foreign_sample(targets: DataFrame, pool: DataFrame, k: int, seed: int, target_id: str = "idx",
                   pool_id: str = "idx", target_group: str = "db_id", pool_group: str = "db_id") -> DataFrame:
    """The ``k`` pool rows of other groups that follow each target's start on the circle (all if fewer).

    Same circle as :func:`seeded_sample`, with the target's own group left out; null is
    a group of its own. Pool rows have a place P among all rows and a place j within
    their group, so P - j rows of other groups lie before them. A target's start gives
    the first of its foreign ranks r, and r is the row at place r + (own rows with
    P - j <= r). Places and these counts are running sums over range-partitioned rows,
    so a group that holds nearly the whole pool spans many tasks, and the work is
    the pool plus targets x k rows, whatever the sizes of the groups.
    """
    validate_k(k)

    def group(c: str) -> Column:
        return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))

    p = pool.select(F.col(pool_id).alias("id"), group(pool_group).alias("grp"),
                    hashing.uniform(seed, F.col(pool_id)).alias("u"), F.lit(1).cast("bigint").alias("row"))
    t = targets.select(F.col(target_id).alias("id"), group(target_group).alias("grp"),
                       hashing.uniform(seed, "t", F.col(target_id)).alias("u"), F.lit(0).cast("bigint").alias("row"))
    both = p.unionByName(t).withColumn("all", F.lit(0))
    order = ["u", "row", "id"]  # a target comes before the rows at its own place
    placed = ordered_prefix(both, ["all"], order, value=F.col("row")).withColumnRenamed("_cum", "upto").drop("_pos", "all")
    placed = ordered_prefix(placed, ["grp"], order, value=F.col("row")).withColumnRenamed("_cum", "own").drop("_pos")
    placed = stored(placed, "foreign-places")
    rows = placed.filter("row = 1").select("id", "grp", (F.col("upto") - 1).alias("at"), (F.col("own") - 1).alias("j"))
    sizes = rows.groupBy("grp").agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*")).scalar()
    starts = placed.filter("row = 0").select("id", "grp", (F.col("upto") - F.col("own")).alias("first"))
    starts = join_small_side(starts, sizes, ["grp"], F.col("id"), how="left")
    starts = starts.withColumn("others", total - F.coalesce(F.col("n"), F.lit(0))).filter(F.col("others") > 0)
    wanted = (starts.withColumn("slot", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.lit(k).cast("bigint"), F.col("others")))))
              if k else starts.withColumn("slot", F.lit(1).cast("bigint")).limit(0))
    wanted = wanted.select("grp", ((F.col("first") + F.col("slot") - 1) % F.col("others")).alias("key"), F.lit(0).cast("bigint").alias("row"),
                           "id", "slot")
    marks = rows.select("grp", (F.col("at") - F.col("j")).alias("key"), F.lit(1).cast("bigint").alias("row"), "id",
                        F.lit(0).cast("bigint").alias("slot"))
    looked = wanted.unionByName(marks).withColumn("late", 1 - F.col("row"))  # own rows with an equal key come first
    looked = ordered_prefix(looked, ["grp"], ["key", "late", "id", "slot"], value=F.col("row"))
    found = looked.filter("row = 0").select(F.col("id").alias("target_id"), F.col("slot").alias("rank"),
                                            (F.col("key") + F.col("_cum")).alias("at"))
    return found.join(rows.select("at", F.col("id").alias("demo_id")), "at").select("target_id", "demo_id", "rank")


# --- R3 structure class --------------------------------------------------------------

def structure_class(toks: Column) -> Column:
    """R3 on lower-cased SQL tokens: conjunction / aggr / join / easy.

    Aggregate tokens exclude 'none' (X4); join + aggregate falls through to easy (kept).
    """
    conj = F.arrays_overlap(toks, F.array(*[F.lit(x) for x in ("intersect", "union", "except")]))
    agg_words = F.array(*[F.lit(x) for x in ("max", "min", "count", "sum", "avg", "having")])
    joined = F.concat(F.lit(" "), F.concat_ws(" ", toks), F.lit(" "))
    aggr = F.arrays_overlap(toks, agg_words) | joined.contains(" group by ")
    join = F.array_contains(toks, "join")
    return (F.when(conj, "conjunction").when(~join & aggr, "aggr")
             .when(join & ~aggr, "join").otherwise("easy"))


# --- R7 vectors ------------------------------------------------------------------------

TARGET_BLOCK, POOL_BLOCK, TILE = 4096, 8192, 256


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; zero rows stay."""
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=np.float64) if len(vectors) else np.zeros((0, 0))


def _topk_tiles(tids, tmat, pids, pmat, k):
    """Per target the k best of one block, a tile of targets at a time (ties: smaller pool id first)."""
    order = np.argsort(pids, kind="stable")
    pids, pmat, kk = pids[order], pmat[order], min(k, len(pids))
    for lo in range(0, len(tids), TILE):
        scores = tmat[lo:lo + TILE] @ pmat.T
        edge = np.partition(scores, len(pids) - kk, axis=1)[:, len(pids) - kk]
        for i, row in enumerate(scores):
            at = np.flatnonzero(row >= edge[i])
            at = at[np.argsort(-row[at], kind="stable")][:kk]
            yield tids[lo + i], pids[at], row[at]


def dot_topk(targets: DataFrame, pool: DataFrame, k: int, target_id: str = "id",
             target_vec: str = "vec", pool_id: str = "id", pool_vec: str = "vec",
             normalize: bool = False, exclude_self: bool = False) -> DataFrame:
    """Top-k pool rows by dot product (or cosine when ``normalize``) per target.

    Targets and pool meet in blocks of bounded size; a block returns at most k rows
    (k+1 when excluding self) per target, picked by partial selection, so no task
    and no driver holds more than a block of either side.
    """
    validate_k(k)
    kk = k + (1 if exclude_self else 0)
    t = targets.select(F.col(target_id).cast("bigint").alias("tid"), F.col(target_vec).cast("array<double>").alias("tv"))
    p = pool.select(F.col(pool_id).cast("bigint").alias("pid"), F.col(pool_vec).cast("array<double>").alias("pv"))

    def score_block(tp: pd.DataFrame, pp: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(tp) and len(pp) and kk:
            tm, pm = matrix(tp["tv"]), matrix(pp["pv"])
            if normalize:
                tm, pm = unit_rows(tm), unit_rows(pm)
            rows = list(_topk_tiles(tp["tid"].to_numpy(np.int64), tm, pp["pid"].to_numpy(np.int64), pm, kk))
        return pd.DataFrame({
            "target_id": np.repeat([r[0] for r in rows], [len(r[1]) for r in rows]).astype(np.int64),
            "demo_id": np.concatenate([r[1] for r in rows] or [np.zeros(0, np.int64)]),
            "score": np.concatenate([r[2] for r in rows] or [np.zeros(0)])})

    left, right = block_pairs(t, p, "tid", "pid", TARGET_BLOCK, POOL_BLOCK)
    local = left.cogroup(right).applyInPandas(score_block, "target_id bigint, demo_id bigint, score double")
    if exclude_self:
        local = local.filter(F.col("target_id") != F.col("demo_id"))
    out = top_k(local, ["target_id"], [F.col("score").desc(), F.col("demo_id").asc()], k)
    return out.select("target_id", "demo_id", F.round("score", 5).alias("score"), "rank")


# --- R6 structure-aware retrieval ---------------------------------------------------------

# Bonuses when target and demonstration agree on a clause being present.
STRUCT_BONUS = {"g": 0.02, "h": 0.01, "o": 0.01, "l": 0.01}


def agreement(t: str = "t", d: str = "d") -> Column:
    """Bonus of a target and a demo signature from their flags, columns ``<t>g`` .. ``<d>l``."""
    return sum((F.when(F.col(t + x) == F.col(d + x), F.lit(v)).otherwise(F.lit(0.0)) for x, v in STRUCT_BONUS.items()), F.lit(0.0))


#: Rows of a broadcast: signatures and tokens grow with the log, and a driver holds a row of them in some 200 bytes, twice while it sends it.
STRUCT_ROWS = 100_000


def _struct_side(big: DataFrame, small: DataFrame, on: list[str], salt_of: Column, how: str = "inner") -> DataFrame:
    return join_small_side(big, small, on, salt_of, how, min(STRUCT_ROWS, conf_int(big.sparkSession, CONF_BROADCAST_ROWS, STRUCT_ROWS)))


def _struct_scores(pairs: DataFrame, tsig: DataFrame, dsig: DataFrame) -> DataFrame:
    """(tsig, sig, bucket, min_id, score, bonus) of the given signature pairs, from whole token sets and flags."""
    both = _struct_side(pairs.select("tsig", "sig", "bucket"), tsig, ["tsig", "bucket"], F.col("sig"))
    both = _struct_side(both, dsig, ["sig", "bucket"], F.col("tsig"))
    inter = F.size(F.array_intersect("ttoks", "toks"))
    union = F.size("ttoks") + F.size("toks") - inter
    jac = F.when(union == 0, F.lit(0.0)).otherwise(inter.cast("double") / union.cast("double"))
    return both.select("tsig", "sig", "bucket", "min_id", (jac + agreement()).alias("score"), agreement().alias("bonus"))


#: Places of a posting list's first level; a level is twice as long as the one before.
FIRST_LEVEL = 64


def struct_pairs(tpost: DataFrame, dpost: DataFrame, floor: DataFrame) -> DataFrame:
    """(tsig, sig, bucket) that can come before a target's ``floor``, its k-th best known (score, id).

    A demo does so with a higher score, or with the same score and an id below the
    floor's (``lim``). Its flags give its bonus and so the Jaccard it must pass (or reach),
    this and its size the tokens it must share, and one of all but that many less one of
    the target's tokens brings it: the most frequent ones are left out. Posting lists
    are kept by token, flags and size and cut into levels of ascending ids, so a
    list of equal scores is read only up to ``lim``. Scores of another bonus are compared
    with a margin for rounding. ``tpost`` has a target's tokens with their place by rarity.
    """
    pattern = F.concat(*[F.coalesce(F.col("d" + x).cast("string"), F.lit("-")) for x in "ghol"])
    group = ["bucket", "tok", "pattern", "nb"]
    listed = ordered_prefix(dpost.withColumn("pattern", pattern), group, ["sig"])
    listed = stored(listed.withColumn("level", F.floor(F.log2(F.floor(F.col("_pos") / FIRST_LEVEL) + 1)).cast("int")).drop("_pos"), "struct-lists")
    levels = listed.groupBy(*group, "level").agg(F.min("sig").alias("least"), *[F.first("d" + x).alias("d" + x) for x in "ghol"])
    met = _struct_side(tpost.join(shuffled(floor), "tsig", "left"), levels, ["bucket", "tok"], F.col("tsig"))
    own = F.greatest(F.coalesce("floor", F.lit(0.0)) - agreement(), F.lit(0.0))
    share = F.col("own") / (1 + F.col("own")) * (F.col("na") + F.col("nb"))
    reach = F.greatest(F.ceil(share - 1e-9), F.lit(1))
    passing = F.when(F.col("tied") == agreement(), F.greatest(F.floor(share + 1e-9) + 1, F.lit(1))).otherwise(reach)

    def last(least: Column) -> Column:
        return F.when(least <= F.least("na", "nb"), F.col("na") - least + 1).otherwise(0)

    met = met.withColumn("own", own).withColumn("to_reach", last(reach)).withColumn("to_pass", last(passing))
    keys = [*group, "level"]
    met = stored(met.filter((F.col("place") <= F.col("to_pass")) | (F.col("place") <= F.col("to_reach")) & (F.col("least") < F.col("lim")))
                 .select("tsig", *keys, (F.col("place") <= F.col("to_pass")).alias("passes"), "lim"), "struct-met")
    asked = listed.join(shuffled(met.select(*keys).distinct()), keys, "left_semi").select(*keys, "sig")
    hits = _struct_side(met, stored(asked, "struct-asked"), keys, salt_of=F.col("tsig"))
    return hits.filter(F.col("passes") | (F.col("sig") < F.col("lim"))).select("tsig", "sig", "bucket").distinct()


def struct_retrieve(items: DataFrame, k: int, id_col: str = "qid") -> DataFrame:
    """Top-k by question-token Jaccard plus clause-agreement bonuses, within a structure bucket.

    ``items`` carries (id, toks, setop, jc, g, h, o, l): distinct question
    tokens, set-operation flag, join count and presence of GROUP BY / HAVING /
    ORDER BY / LIMIT (X3: presence = non-empty). Targets with a set operation
    (tested on the target, X2) draw from set-operation demos; otherwise from
    demos with the same join count (1, 2, >2), or from all demos when the
    target has no join. Every item is both target and demo (itself excluded).

    Exact and without per-pair work on duplicates: items with identical
    (tokens, features) form a signature whose k+1 smallest ids are the only
    members that can ever be picked; per target signature only the top k+1 demo
    signatures by (score desc, smallest id) can hold the answer, and demo
    signatures that share no token compete through the k+1 smallest-id
    signatures of every (bucket, flag pattern).
    """
    kk = k + 1
    f = items.select(F.col(id_col).alias("id"), F.array_sort(F.array_distinct("toks")).alias("toks"),
                     F.col("setop").cast("boolean").alias("setop"),
                     F.least(F.col("jc"), F.lit(3)).cast("int").alias("jcb"),
                     *[F.col(x).cast("boolean").alias(x) for x in "ghol"])
    feats = ["toks", "setop", "jcb", "g", "h", "o", "l"]
    # A signature is named by its smallest id. Group and join on the canonical JSON of the feature tuple (an exact string key;
    # array-typed join keys fall out of whole-stage codegen). Written once: the join's null check on the key would otherwise
    # go below the spread of a small input and compute all features again in the scan's few tasks.
    f = stored(f.withColumn("fkey", F.to_json(F.struct(*feats))), "struct-items")
    sigs = stored(f.groupBy("fkey").agg(F.min("id").alias("min_id"), *[F.first(c).alias(c) for c in feats])
                  .withColumn("sig", F.col("min_id")), "signatures")
    f = stored(f.join(shuffled(sigs.select("fkey", "sig")), "fkey").drop("fkey"), "signed")
    members = top_k(f.select("sig", "id"), ["sig"], [F.col("id").asc()], kk, rank_col="m")
    # Demo-side bucket memberships and target-side bucket choice.
    bucket_of = F.when(F.col("jcb") == 1, "j1").when(F.col("jcb") == 2, "j2").when(F.col("jcb") >= 3, "j3")
    dsig = sigs.select("sig", "toks", "min_id", *[F.col(x).alias("d" + x) for x in "ghol"],
                       F.explode(F.array(F.lit("all"), F.when(F.col("setop"), F.lit("conj")), bucket_of))
                       .alias("bucket")).filter(F.col("bucket").isNotNull())
    tsig = sigs.select(F.col("sig").alias("tsig"), F.col("toks").alias("ttoks"),
                       *[F.col(x).alias("t" + x) for x in "ghol"],
                       F.when(F.col("setop"), "conj").when(F.col("jcb") >= 1, bucket_of).otherwise("all").alias("bucket"))
    tsig, dsig = stored(tsig, "struct-targets"), stored(dsig, "struct-demos")
    tpost = tsig.select("tsig", "bucket", *["t" + x for x in "ghol"], F.size("ttoks").alias("na"),
                        F.explode_outer("ttoks").alias("tok")).filter(F.col("tok").isNotNull())
    dpost = stored(dsig.select("sig", "bucket", *["d" + x for x in "ghol"], F.size("toks").alias("nb"),
                               F.explode_outer("toks").alias("tok")).filter(F.col("tok").isNotNull()), "struct-postings")
    freq = dpost.groupBy("bucket", "tok").agg(F.count("*").alias("f"))
    rarest = Window.partitionBy("tsig").orderBy("f", "tok")
    tpost = stored(_struct_side(tpost, freq, ["bucket", "tok"], F.col("tsig"), how="left")
                   .withColumn("f", F.coalesce("f", F.lit(0))).withColumn("place", F.row_number().over(rarest)), "struct-tokens")
    # Zero-overlap competitors: k+1 smallest-id signatures per (bucket, pattern), size bounded.
    pattern_first = top_k(dsig, ["bucket", "dg", "dh", "do", "dl"], [F.col("min_id").asc()], kk, rank_col="_r")
    fill = _struct_side(tsig.select("tsig", "bucket"), pattern_first.select("bucket", "sig"), ["bucket"],
                           F.col("tsig")).select("tsig", "sig", "bucket")
    # A few demos that share rare tokens raise the floor: each target's postings are cut at the rarest.
    met = tpost.filter("f > 0").withColumn("met", F.row_number().over(rarest)).filter(F.col("met") <= SEED_TOKENS)
    few = dpost.withColumn("nth", F.row_number().over(Window.partitionBy("bucket", "tok").orderBy("sig"))).filter(
        F.col("nth") <= SEED_CANDIDATES * kk)
    seeds = _struct_side(few.select("bucket", "tok", "sig"), met.select("tsig", "bucket", "tok"), ["bucket", "tok"], F.col("sig"))
    known = stored(_struct_scores(fill.unionByName(seeds.select("tsig", "sig", "bucket")).distinct(), tsig, dsig), "struct-known")
    floor = (top_k(known, ["tsig"], [F.col("score").desc(), F.col("min_id").asc()], kk, rank_col="_r")
             .filter(F.col("_r") == kk).select("tsig", F.col("score").alias("floor"), F.col("min_id").alias("lim"), F.col("bonus").alias("tied")))
    pairs = struct_pairs(tpost, dpost, floor)
    cand = known.unionByName(_struct_scores(pairs.join(shuffled(known), ["tsig", "sig", "bucket"], "left_anti"), tsig, dsig))
    best_sigs = top_k(cand, ["tsig"], [F.col("score").desc(), F.col("min_id").asc()], kk, rank_col="_r")
    picks = best_sigs.select("tsig", "sig", "score").join(shuffled(members), "sig")
    picks = top_k(picks, ["tsig"], [F.col("score").desc(), F.col("id").asc()], kk, rank_col="_r")
    out = f.select(F.col("id").alias("target_id"), F.col("sig").alias("tsig")).join(shuffled(picks), "tsig")
    out = out.filter(F.col("target_id") != F.col("id"))
    out = top_k(out, ["target_id"], [F.col("score").desc(), F.col("id").asc()], k)
    return out.select("target_id", F.col("id").alias("demo_id"), F.round("score", 6).alias("score"), "rank")
