"""Op 13, spelling variant grouping: words one edit apart, found by dense prefix-suffix tiles.

Two words are near if one inserted, deleted or replaced code point turns one into
the other: their common prefix and common suffix together reach the longer length
less one. Words are laid in padded code-point matrices, once from the left and once
from the right, and tiles of such rows are compared densely.

Which rows meet in a tile: the longer word's places are cut into ``PIECES`` pieces.
The edit falls into one of them, so a near pair agrees on everything before and
after that piece. Every word is posted under this rest for each piece and for both
lengths that the longer word can have. A pair is counted under the first piece that
allows it. Each tile sends a word's number of near words and best form on, not the
pairs. A rest with more than ``BLOCK`` words is dealt into blocks, and every pair
of blocks becomes a tile of its own, so no task holds a whole crowded group.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotloom.llm.base import as_bytes, discard, join_small_side, stored

MIN_LENGTH, MIN_COUNT = 5, 3
PIECES, BLOCK = 4, 1024
#: Bytes of posted words that a task holds, matrix cells of one comparison, entries of a task's word counter.
BUCKET_BYTES, TILE_CELLS, COUNTER_WORDS = 2 << 20, 1 << 22, 200_000

#: [A-Za-zÀ-ÿ] in lower-cased UTF-8.
_LETTERS = rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}"
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def word_counts(docs: DataFrame, drop_every: int | None = None, min_length: int = MIN_LENGTH,
                min_count: int = MIN_COUNT) -> DataFrame:
    """``(word, n)`` of the lower-cased letter runs of all texts with ``min_length`` letters and ``min_count`` uses.

    With ``drop_every``, a run loses one code point if the crc32 of ``<doc_id>:<run>``
    is divisible by it (a made typing error, the same in every run of the job).
    Null texts count as empty; without doc_id nothing is dropped; repeated rows count
    each time. Tasks add up their own counts before the shuffle, so a hot word sends
    one row a task.
    """
    runs = re.compile(_LETTERS % min_length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = defaultdict(int)

        def flush() -> pa.RecordBatch:
            words, counts = pa.array(list(total), pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64())
            total.clear()
            return pa.RecordBatch.from_arrays([words, counts], ["word", "n"])

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), as_bytes(b.column("text")), strict=True):
                if not text:
                    continue
                found = Counter(runs.findall(text.translate(_LOWER)))
                if doc_id is None or not drop_every:
                    for w, n in found.items():
                        total[w] += n
                else:
                    crc, head = zlib.crc32, zlib.crc32(b"%d:" % doc_id)
                    for w, n in found.items():
                        h = crc(w, head)
                        if h % drop_every:
                            total[w] += n
                        else:
                            chars = w.decode()
                            at = h % len(chars)
                            if len(chars) > min_length:
                                total[(chars[:at] + chars[at + 1:]).encode()] += n
                if len(total) > COUNTER_WORDS:
                    yield flush()
        if total:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def postings(words: DataFrame) -> DataFrame:
    """``words`` under the rest of each piece: ``m`` (length of the longer word), ``piece``, ``key``."""
    size = F.length("word")
    places = F.explode(F.array(*[
        F.struct((size + more).alias("m"), F.lit(k).alias("piece"),
                 F.floor((size + more) * k / PIECES).cast("int").alias("begin"),
                 F.floor((size + more) * (k + 1) / PIECES).cast("int").alias("end"))
        for more in (0, 1) for k in range(PIECES)]))
    placed = words.select("word", "n", places.alias("p")).select("word", "n", "p.*").filter("begin < end")
    tail = F.col("m") - F.col("end")
    rest = [F.substring("word", F.lit(1), F.col("begin")), F.substring("word", F.length("word") - tail + 1, tail)]
    return placed.select("word", "n", "m", "piece", F.xxhash64("m", "piece", *rest).alias("key"))


def _matrices(words: list[str], m: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words of length m or m - 1, laid from the left and (backwards) from the right."""
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(flat) or flat.max() < 256:
        flat = flat.astype(np.uint8)
    size = np.fromiter(map(len, words), np.int64, len(words))
    used = np.arange(m) < size[:, None]
    left = np.zeros((len(words), m), flat.dtype)
    left[used] = flat
    right = np.zeros_like(left)
    start = np.cumsum(size) - size
    right[used] = flat[((start + size - 1)[:, None] - np.arange(m))[used]]
    return left, right


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common beginning of each pair of rows."""
    differs = a != b
    return np.where(differs.any(1), differs.argmax(1), a.shape[1])


def _pairs(starts: np.ndarray, sizes: np.ndarray, cells: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of every group, groups of one size together, about ``cells`` pairs at a time."""
    for s in np.unique(sizes[sizes > 1]).tolist():
        of = starts[sizes == s]
        i, j = np.triu_indices(s, 1)
        for lo in range(0, len(i), cells):
            x, y = i[lo:lo + cells], j[lo:lo + cells]
            step = max(1, cells // len(x))
            for g in range(0, len(of), step):
                base = of[g:g + step, None]
                yield (base + x).ravel(), (base + y).ravel()


def near_in_tiles(table: pa.Table) -> pa.Table:
    """``(word, n_near, form, form_n)`` of the words of a bucket of posted rows, over its tiles."""
    words = np.array(table.column("word").to_pylist(), object)
    m, piece, key, n, tile, block = (table.column(c).to_numpy() for c in ("m", "piece", "key", "n", "tile", "block"))
    order = np.lexsort((tile, key, piece, m))
    names, rank = np.unique(words, return_inverse=True)  # code-point order
    owners, others, weights = [], [], []
    for size in np.unique(m).tolist():
        rows = order[m[order] == size]
        left, right = _matrices(words[rows].tolist(), size)
        fresh = np.ones(len(rows), bool)
        for c in (piece, key, tile):
            fresh[1:] &= c[rows][1:] == c[rows][:-1]
        fresh[1:] = ~fresh[1:]
        starts = np.flatnonzero(fresh)
        long = np.fromiter((len(w) == size for w in words[rows]), bool, len(rows))
        begin = [size * k // PIECES for k in range(PIECES + 1)]
        for x, y in _pairs(starts, np.diff(np.append(starts, len(rows))), max(1, TILE_CELLS // max(1, size))):
            ok = (long[x] | long[y]) & ((tile[rows[x]] < 1) | (block[rows[x]] != block[rows[y]]))
            x, y = x[ok], y[ok]
            head, tail = _common(left[x], left[y]), _common(right[x], right[y])
            first = np.full(len(x), PIECES)
            for k in reversed(range(PIECES)):
                fits = (head >= begin[k]) & (tail >= size - begin[k + 1]) & (begin[k] < begin[k + 1])
                first[fits] = k
            near = (head + tail >= size - 1) & (first == piece[rows[x]]) & (rank[rows[x]] != rank[rows[y]])
            a, b = rows[x[near]], rows[y[near]]
            owners += [rank[a], rank[b]]
            others += [rank[b], rank[a]]
            weights += [n[b], n[a]]
    owner, other, weight = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (owners, others, weights))
    best = np.lexsort((other, -weight, owner))
    owner, other, weight = owner[best], other[best], weight[best]
    own, at, count = np.unique(owner, return_index=True, return_counts=True)
    return pa.table({"word": pa.array(names[own].tolist(), pa.string()), "n_near": pa.array(count, pa.int64()),
                     "form": pa.array(names[other[at]].tolist(), pa.string()), "form_n": pa.array(weight[at], pa.int64())})


def near_words(words: DataFrame) -> DataFrame:
    """Partial ``(word, n_near, form, form_n)`` rows of all tiles; a word may have several."""
    posted = postings(words)
    size = words.agg(F.count("*").alias("rows"), F.sum(F.octet_length("word") + 32).alias("bytes")).first()
    buckets = max(1, -(-(size.bytes or 0) * 2 * PIECES // BUCKET_BYTES))

    def dealt(rows: DataFrame, *by: Column) -> DataFrame:
        bucket = F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int").alias("bucket")
        return (rows.select("word", "n", "m", "piece", "key", "tile", "block", bucket).groupBy("bucket")
                .applyInArrow(near_in_tiles, "word string, n_near long, form string, form_n long"))

    crowd = stored(posted.groupBy("key").count().filter(F.col("count") > BLOCK), "crowded")
    if crowd.isEmpty():
        return dealt(posted.withColumn("tile", F.lit(0).cast("long")).withColumn("block", F.lit(0)), F.col("key"))
    marked = join_small_side(posted, crowd, ["key"], F.col("word"), how="left")
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    plain = marked.filter("count is null").withColumn("tile", F.lit(0).cast("long")).withColumn("block", F.lit(0))
    split = (marked.filter("count is not null").withColumn("blocks", blocks)
             .withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("low", F.least("block", "other").cast("long"))
             .withColumn("high", F.greatest("block", "other").cast("long")))
    # tiles of one block with itself are numbered 0 and below, those of two blocks above 0
    place = F.col("low") * F.col("blocks") + F.col("high")
    split = split.withColumn("tile", F.when(F.col("low") < F.col("high"), place).otherwise(-F.col("low")))
    return dealt(plain, F.col("key")).union(dealt(split, F.col("key"), F.col("tile")))


def follow(links: DataFrame) -> DataFrame:
    """``(word, root)`` from ``(word, form)`` links without a circle, by path doubling.

    A form is met at least twice as often as its word, so paths are no longer than
    the logarithm of the largest count and few rounds end them.
    """
    paths = stored(links.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = paths.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(join_small_side(paths, ahead, ["root"], F.col("word"), how="left"), "forms")
        if moved.filter("next is not null").isEmpty():
            discard(moved)
            return paths
        discard(paths)
        paths = moved.select("word", F.coalesce("next", "root").alias("root"))


def spelling_variants(words: DataFrame) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of a table ``(word, n)``.

    ``form`` is the near word of largest n (ties: the smallest in code-point order) if
    that is at least twice the word's n, else null; ``root`` is the end of the forms
    that lead on from a word, itself without one. Rows without word or n are left out,
    the counts of a repeated word add up, other columns are ignored, and an empty
    table gives none. Words of any length and script take part whole.
    """
    words = stored(words.filter("word is not null and n is not null").groupBy("word")
                   .agg(F.sum(F.col("n").cast("long")).alias("n")), "words")
    none = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("string").alias("form"),
                        F.lit(None).cast("long").alias("form_n"))
    part = near_words(words).select("word", F.lit(None).cast("long").alias("n"), "n_near", "form", "form_n")
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("minus"), "form"))).alias("best")
    known = none.union(part).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best)
    firm = -F.col("best.minus") >= 2 * F.col("n")
    known = stored(known.select("word", F.when(firm, F.col("best.form")).alias("form"), "n", "n_near",
                                F.when(firm, -F.col("best.minus")).alias("form_n")), "variants")
    roots = follow(known.filter("form is not null").select("word", "form"))
    return (known.join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def document_variants(docs: DataFrame) -> DataFrame:
    """Spelling variants of the words of all texts, after the contract's made typing errors (one run in 97)."""
    return spelling_variants(word_counts(docs, drop_every=97))
