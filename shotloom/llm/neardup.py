"""Op 8, MinHash near-dedup: an inverted join over signature coordinates.

Documents with the same shingle set are one class. Each class posts the rarest
``COORDS - need + 1`` of its (coordinate, value) pairs; two classes that agree in
at least ``need`` coordinates share one of those postings, whatever the data.
Postings are merged hub-first: every class is compared with the best-connected
class of each of its lists, and only lists that still span several groups are
merged further, in blocks (the skip). Groups above the match threshold are
confirmed on full shingle sets, again in blocks that return a spanning forest
and never all pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotloom.llm.base import WordHash, as_bytes, mix64, slices, small_batches, stored
from shotloom.llm.components import components
from shotloom.operators.common import join_small_side

#: Coordinates of a signature, and how likely a true link may miss the match threshold.
COORDS, MISS = 32, 1e-6
LIST_BLOCK, SET_BLOCK, STEP_BYTES = 1024, 256, 1 << 20
_SEEDS = np.random.default_rng(20240229).integers(0, 2**63, (2, COORDS, 4), dtype=np.uint64)
_MUL = _SEEDS[0, :, 0] * np.uint64(2) + np.uint64(1)
_XOR = _SEEDS[1, :, 0]


def matches_needed(percent: int) -> int:
    """Largest threshold that a pair at the similarity misses with probability MISS at most (16 for 85)."""
    p, tail, need = percent / 100, 0.0, 0
    while need < COORDS and (tail := tail + math.comb(COORDS, need) * p**need * (1 - p)**(COORDS - need)) <= MISS:
        need += 1
    return max(1, need)


def shingle_set(text: bytes | None, hashes: WordHash, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    words = (text or b"").lower().split()  # bytes: lowers A-Z, splits at ASCII white space
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    h = hashes.array(words)
    if n < width:
        acc = np.array([n], np.uint64)
        for k in range(n):
            acc = mix64(acc * np.uint64(31) + h[k])
        return acc
    acc = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        acc = mix64(acc + h[k:n - width + 1 + k])
    return np.unique(acc)


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """Signatures (len(sets) x COORDS, int32) of non-empty shingle sets."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), COORDS), np.int32)
    for j in range(COORDS):
        low = np.minimum.reduceat((flat ^ _XOR[j]) * _MUL[j], starts)
        out[:, j] = (low >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def digest() -> Column:
    """Tells the texts of rows that share a doc_id apart."""
    return F.xxhash64("text")


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """``(doc_id, digest, n_shingles, key, sig)`` of every document; key and sig are null without words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            for at, rows in slices(batch.column("text"), STEP_BYTES):
                sets = [shingle_set(t, hashes, width) for t in texts[at:at + rows]]
                full = [s for s in sets if len(s)]
                sig = iter(minhash(full).tolist() if full else [])
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id")[at:at + rows],
                    batch.column("digest")[at:at + rows],
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                              for s in sets], pa.binary()),
                    pa.array([next(sig) if len(s) else None for s in sets], pa.list_(pa.int32())),
                ], ["doc_id", "digest", "n_shingles", "key", "sig"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), digest().alias("digest"), "text").mapInArrow(
        run, "doc_id long, digest long, n_shingles long, key binary, sig array<int>")


def spanning(adjacent, n: int) -> list[tuple[int, int]]:
    """Forest edges of a graph on 0..n-1; ``adjacent(i)`` gives the neighbours of i."""
    label, out = np.arange(n), []
    for i in range(n):
        near = adjacent(i)
        near = near[label[near] != label[i]]
        if len(near):
            names, first = np.unique(label[near], return_index=True)
            out += [(i, int(j)) for j in near[first]]
            names = np.append(names, label[i])
            label[np.isin(label, names)] = names.min()
    return out


def matching(sig_a: np.ndarray, sig_b: np.ndarray) -> np.ndarray:
    """Agreeing coordinates of every row of a with every row of b."""
    out = np.zeros((len(sig_a), len(sig_b)), np.int16)
    for j in range(sig_a.shape[1]):
        out += sig_a[:, j, None] == sig_b[None, :, j]
    return out


def shared_counts(rows: list[np.ndarray], cols: list[np.ndarray] | None = None, step: int = 4096) -> np.ndarray:
    """Intersection sizes of row sets with column sets (or one another), a slice of the elements at a time."""
    sets = rows + (cols or [])
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
    _, at, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = seen[at] > 1
    _, at = np.unique(at[keep], return_inverse=True)
    owner = owner[keep]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    n = len(rows)
    out = np.zeros((n, len(cols) if cols else n), np.float32)
    width = int(at[-1]) + 1 if len(at) else 0
    for lo in range(0, width, step):
        a, b = np.searchsorted(at, [lo, lo + step])
        m = np.zeros((len(sets), min(step, width - lo)), np.float32)
        m[owner[a:b], at[a:b] - lo] = 1
        out += m[:n] @ (m[n:] if cols else m).T
    if not cols:
        np.fill_diagonal(out, [len(s) for s in sets])
    return out


def postings(classes: DataFrame, need: int) -> DataFrame:
    """``(j, v, key, weight)``: the rarest coordinates of each class that another class has too."""
    tokens = classes.select("key", F.posexplode("sig").alias("j", "v"))
    often = tokens.groupBy("j", "v").agg(F.count("*").alias("c")).filter("c > 1")
    own = (tokens.join(often, ["j", "v"]).groupBy("key")
           .agg(F.sort_array(F.collect_list(F.struct("c", "j", "v"))).alias("t")))
    # coordinates that no other class has come first in the order and take places of the prefix
    return (own.withColumn("weight", F.aggregate("t", F.lit(0).cast("long"), lambda s, x: s + x["c"]))
            .withColumn("t", F.slice("t", 1, F.greatest(F.lit(0), F.size("t") - F.lit(need - 1))))
            .select("key", "weight", F.explode_outer("t").alias("t")).filter("t is not null")
            .select("t.j", "t.v", "key", "weight"))


def block_of(n: Column, size: int) -> tuple[Column, Column]:
    """(number of blocks of ``size``, the block of this row's key)."""
    blocks = F.ceil(n / size).cast("int")
    return blocks, F.pmod(F.xxhash64("key"), blocks).cast("int")


def _list_links(need: int):
    """Forest of the pairs in one block pair of a posting list that agree in ``need`` coordinates."""
    return lambda pdf: _block_links(pdf, need)


def _block_links(pdf: pd.DataFrame, need: int) -> pd.DataFrame:
    first = (pdf["blk"] == pdf["bi"]).to_numpy()
    a, b = pdf[first], pdf if pdf["bi"].iloc[0] == pdf["bj"].iloc[0] else pdf[~first]
    if not len(a) or not len(b):
        return pd.DataFrame({"a": [], "b": []}, dtype=object)
    keys = np.concatenate([a["key"].to_numpy(), b["key"].to_numpy()])
    sig_b, ka = np.stack(b["sig"].to_numpy()), len(a)
    sig_a, grp_a, grp_b = np.stack(a["sig"].to_numpy()), a["grp"].to_numpy(), b["grp"].to_numpy()

    near: dict[int, np.ndarray] = {}
    for lo in range(0, ka, 128):
        hit = matching(sig_a[lo:lo + 128], sig_b) >= need
        hit &= grp_a[lo:lo + 128, None] != grp_b[None, :]
        near |= {lo + i: np.flatnonzero(row) + ka for i, row in enumerate(hit)}
    none = np.empty(0, np.int64)
    links = spanning(lambda i: near.get(i, none), len(keys))
    return pd.DataFrame({"a": [keys[i] for i, _ in links], "b": [keys[j] for _, j in links]}, dtype=object)


def _set_links(width: int, percent: int, cross: bool):
    """Forest of the true links in a block: all rows with each other, or role 0 with role 1."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        hashes = WordHash()
        if cross:
            a, b = pdf[pdf["role"] == 0], pdf[pdf["role"] == 1]
        else:
            a = b = pdf.drop_duplicates("key")
        if not len(a) or not len(b):
            return pd.DataFrame({"a": [], "b": []}, dtype=object)
        rows = [shingle_set(t.encode(), hashes, width) for t in a["text"]]
        cols = [shingle_set(t.encode(), hashes, width) for t in b["text"]] if cross else None
        na, nb = (np.array([len(s) for s in x], np.int64) for x in (rows, cols or rows))
        both = shared_counts(rows, cols).astype(np.int64)
        hit = 100 * both >= percent * (na[:, None] + nb[None, :] - both)
        if cross:
            hit &= a["grp"].to_numpy()[:, None] != b["grp"].to_numpy()[None, :]
        keys = np.concatenate([a["key"].to_numpy(), b["key"].to_numpy()])
        none = np.empty(0, np.int64)
        links = spanning(lambda i: np.flatnonzero(hit[i]) + len(a) if i < len(a) else none, len(keys))
        out = pd.DataFrame({"a": [keys[i] for i, _ in links], "b": [keys[j] for _, j in links]}, dtype=object)
        return out[out["a"] != out["b"]]

    return run


def _with_label(df: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """The component root of ``key`` (its own key where it has no edge)."""
    return (df.join(labels.select(F.col("id").alias("key"), F.col("root").alias(name)), "key", "left")
            .withColumn(name, F.coalesce(name, "key")))


def candidate_groups(classes: DataFrame, posts: DataFrame, need: int) -> DataFrame:
    """``(id, root)``: groups of classes chained by pairs that agree in ``need`` coordinates."""
    hubs = posts.groupBy("j", "v").agg(F.max_by("key", F.struct("weight", "key")).alias("hub"))
    sig = classes.select("key", "sig")
    star = (posts.join(hubs, ["j", "v"]).filter("key <> hub").select("key", "hub").distinct()
            .join(sig, "key")
            .join(sig.select(F.col("key").alias("hub"), F.col("sig").alias("hub_sig")), "hub")
            .filter(F.size(F.filter(F.arrays_zip("sig", "hub_sig"), lambda z: z["sig"] == z["hub_sig"])) >= need)
            .select(F.col("key").alias("a"), F.col("hub").alias("b")))
    star = stored(star, "nd-star")
    labelled = stored(_with_label(posts, components(star), "grp"), "nd-lists")
    mixed = (labelled.groupBy("j", "v").agg(F.count("*").alias("n"), F.min("grp").alias("lo"),
                                            F.max("grp").alias("hi")).filter("lo <> hi").select("j", "v", "n"))
    blocks, blk = block_of(F.col("n"), LIST_BLOCK)
    rows = (labelled.join(mixed, ["j", "v"]).withColumn("blk", blk)
            .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            .select("j", "v", "key", "grp", "blk", F.least("blk", "other").alias("bi"),
                    F.greatest("blk", "other").alias("bj"))
            .join(sig, "key"))
    more = rows.groupBy("j", "v", "bi", "bj").applyInPandas(_list_links(need), "a binary, b binary")
    return components(star.union(more))


def confirmed_links(docs: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """``(a, b)`` links that join exactly what true links join; ``members(key, grp, doc_id, digest, weight)``."""
    size = members.groupBy("grp").agg(F.count("*").alias("n"),
                                      F.max_by("key", F.struct("weight", "key")).alias("hub")).filter("n > 1")
    members = join_small_side(members, size, ["grp"], F.col("key"))
    # of the texts that share a doc_id, the one that the class was made from
    text = docs.filter("text is not null").select(F.col("doc_id").cast("long"), digest().alias("digest"), "text")
    full = join_small_side(text, members, ["doc_id", "digest"], F.col("doc_id")).dropDuplicates(["key"])
    full = stored(full, "nd-texts")
    blocks, blk = block_of(F.col("n"), SET_BLOCK)
    # the hub sits in every block, so most of a group is joined here
    blks = F.when(F.col("key") == F.col("hub"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(blk))
    first = (full.withColumn("blk", F.explode(blks)).groupBy("grp", "blk")
             .applyInPandas(_set_links(width, percent, cross=False), "a binary, b binary"))
    first = stored(first, "nd-links")
    left = (_with_label(full.filter(F.col("n") > SET_BLOCK).withColumnRenamed("grp", "sg"), components(first), "grp"))
    counts = left.groupBy("sg", "grp").agg(F.count("*").alias("m"))
    shape = (counts.groupBy("sg").agg(F.max_by("grp", F.struct("m", "grp")).alias("main"),
                                      F.max("m").alias("top"), F.sum("m").alias("total"))
             .filter("top < total"))
    left = left.join(shape, "sg").withColumn("rest", F.col("total") - F.col("top"))
    nb_rest, in_rest = block_of(F.col("rest"), SET_BLOCK)
    nb_all, in_all = block_of(F.col("total"), SET_BLOCK)
    outside = (left.filter("grp <> main").withColumn("bu", in_rest)
               .withColumn("bm", F.explode(F.sequence(F.lit(0), nb_all - 1))).withColumn("role", F.lit(0)))
    everyone = (left.withColumn("bm", in_all)
                .withColumn("bu", F.explode(F.sequence(F.lit(0), nb_rest - 1))).withColumn("role", F.lit(1)))
    cols = ["sg", "bu", "bm", "role", "key", "grp", "text"]
    second = (outside.select(*cols).union(everyone.select(*cols)).groupBy("sg", "bu", "bm")
              .applyInPandas(_set_links(width, percent, cross=True), "a binary, b binary"))
    return stored(first.union(second), "nd-links")


def _linked(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures of all rows, classes ``(key, doc_id, digest, sig)`` by their first row, and links between classes."""
    base = stored(signatures(docs, width), "nd-sig")
    named = base.filter("key is not null and doc_id is not null")
    classes = stored(named.groupBy("key").agg(F.min(F.struct("doc_id", "digest")).alias("first"), F.first("sig").alias("sig"))
                     .select("key", "first.*", "sig"), "nd-classes")
    need = matches_needed(percent)
    posts = stored(postings(classes, need), "nd-posts")
    groups = candidate_groups(classes, posts, need)
    weights = posts.groupBy("key").agg(F.max("weight").alias("weight"))
    members = (groups.select(F.col("id").alias("key"), F.col("root").alias("grp"))
               .join(classes.select("key", "doc_id", "digest"), "key").join(weights, "key"))
    return base, classes, confirmed_links(docs, members, width, percent)


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85) -> DataFrame:
    """Per document ``(doc_id, n_shingles, component_id, kept)``.

    Links join documents with ``100 * |A & B| >= percent * |A | B|`` over distinct
    ``width``-word shingles; ``component_id`` is the smallest doc_id reachable and
    ``kept`` marks it. Null or wordless texts have no shingles and stand alone.
    Rows that repeat a doc_id are one document. A row without doc_id is linked with
    nothing: its component_id is null and it is kept.
    """
    base, classes, links = _linked(docs, width, percent)
    named = base.filter("key is not null and doc_id is not null")
    twice = (named.groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("b")).filter("a <> b")
             .join(named.select("doc_id", F.col("key").alias("c")), "doc_id").select("a", F.col("c").alias("b")))
    roots = components(links.union(twice))
    placed = _with_label(named.select("doc_id", "key"), roots, "root")
    smallest = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_key = (_with_label(classes.select("key"), roots, "root").join(smallest, "root").select("key", "component_id"))
    out = base.select("doc_id", "n_shingles", "key").join(by_key, "key", "left")
    return out.select("doc_id", "n_shingles",
                      F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def kept_rows(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Per row ``(doc_id, digest, kept)``: the first row, by doc_id and digest, of each linked group is kept.

    As :func:`near_duplicates`, but rows that share a doc_id are linked by their texts only.
    """
    base, classes, links = _linked(docs, width, percent)
    placed = _with_label(classes.select("key", F.struct("doc_id", "digest").alias("own")), components(links), "root")
    smallest = placed.groupBy("root").agg(F.min("own").alias("first"))
    by_key = placed.join(smallest, "root").select("key", "first")
    out = base.select("doc_id", "digest", "key").join(by_key, "key", "left")
    alone = F.col("doc_id").isNull() | F.col("first").isNull()
    return out.select("doc_id", "digest", (alone | (F.struct("doc_id", "digest") == F.col("first"))).alias("kept"))
