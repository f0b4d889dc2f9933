"""Op 7, token-ID output: Parquet list columns in ascending doc_id order, for selective reads.

A file set has one shard per range of doc_ids. Row: ``shard, doc_id, start`` (ids
before it in its shard), ``n_tokens, ids``. Ids are dictionary-encoded, the number
columns delta-encoded; row groups and pages are small and have page indexes, so a
read by doc_id opens a few pages and a read of the number columns no ids at all.
"""

from __future__ import annotations

import functools
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotloom.llm.base import slices
from shotloom.session import checkpoint_dir

END_ID = 2
SCHEMA = "shard int, doc_id long, start long, n_tokens long, ids array<int>"
WRITER = {
    "compression": "zstd", "parquet.writer.version": "v2", "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(128 << 10), "parquet.page.row.count.limit": "512",
    "parquet.enable.dictionary": "true", "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#start": "false", "parquet.enable.dictionary#n_tokens": "false",
}


#: Text of one step, so that memory doesn't depend on the lengths of documents.
STEP_BYTES = 16 << 20
#: ASCII marks that the library always separates from a letter or digit before them (not the apostrophe).
_MARK, _ALNUM, _LOWER = np.zeros(256, bool), np.zeros(256, bool), np.arange(256, dtype=np.uint8)
for _c in range(33, 127):
    (_ALNUM if chr(_c).isalnum() else _MARK)[_c] = True
_MARK[ord("'")] = False
_LOWER[65:91] += 32


def parted(texts: pa.Array) -> pa.Array:
    """Texts in ASCII lower case, with a space between a letter or digit and a mark after it.

    A text with ``<`` stays as it is: special tokens are case-sensitive and span marks.
    So does one with a combining mark of U+0300 to U+036F: the library composes it with the
    letter before it, and only then lower-cases, so the letter's case decides what comes out.
    """
    raw = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    touch = np.repeat(~pc.match_substring(raw, "<").to_numpy(zero_copy_only=False), np.diff(offsets))
    joins = np.flatnonzero((data == 0xCC) | (data == 0xCD))  # first bytes of the combining marks in UTF-8
    if len(joins):
        whole = np.unique(np.searchsorted(offsets, joins, side="right") - 1)
        for start, end in zip(offsets[whole].tolist(), offsets[whole + 1].tolist(), strict=True):
            touch[start:end] = False
    space = np.flatnonzero(_ALNUM[data[:-1]] & _MARK[data[1:]] & touch[1:]) + 1
    spaced = np.insert(np.where(touch, _LOWER[data], data), space, 32)
    ends = (offsets + np.searchsorted(space, offsets, side="right")).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(raw), [None, pa.py_buffer(ends), pa.py_buffer(spaced)])


class WordEncoder:
    """Ids of texts by the tokenizers library, which encodes each distinct piece once.

    The library's rules never join or split across ASCII white space, nor between a
    letter or digit and the marks after it, and lower-case everything, so the ids of
    a text are those of its pieces (see :func:`parted`). Pieces met lately are kept:
    two generations of about ``limit`` entries.
    """

    def __init__(self, path: str, limit: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _encode(self, pieces: list[bytes]) -> None:
        """Add the ids of new pieces, many in one call.

        A piece of letters is one word of the library (at least: lower case can add
        marks), and a word's last id is marked as such in the vocabulary. So a call with
        as many words as pieces has one for each; other pieces go one by one.
        """
        texts = [p.decode() for p in pieces]
        single = [i for i, t in enumerate(texts) if t.isalpha()]
        other = [i for i, t in enumerate(texts) if not t.isalpha()]
        for at in range(0, len(single), 2000):
            part = single[at:at + 2000]
            text = " ".join([texts[i] for i in part])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(part):
                other += part
                continue
            raw, start = ids.tobytes(), 0
            for i, end in zip(part, (4 * ends).tolist(), strict=True):
                self.known[pieces[i]] = raw[start:end]
                start = end
        found = self.tokenizer.encode_batch_fast([texts[i] for i in other], add_special_tokens=False)
        for i, e in zip(other, found, strict=True):
            self.known[pieces[i]] = np.array(e.ids, np.int32).tobytes()

    def pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of distinct pieces as bytes."""
        if len(self.known) > self.limit:
            self.older, self.known = self.known, {}
        found = list(map(self.known.get, pieces))
        lost = [i for i, x in enumerate(found) if x is None]
        kept = {pieces[i]: self.older[pieces[i]] for i in lost if pieces[i] in self.older}
        self.known |= kept
        self._encode([pieces[i] for i in lost if pieces[i] not in kept])
        for i in lost:
            found[i] = self.known[pieces[i]]
        return found

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, offsets)`` of all texts one after another, each with ``end_id`` at its end."""
        pieces = pc.ascii_split_whitespace(parted(texts))
        coded = pieces.flatten().dictionary_encode()
        names = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        ids = self.pieces(names) + [np.int32(end_id).tobytes()]
        flat = np.frombuffer(b"".join(ids), np.int32)
        size = np.array([len(x) // 4 for x in ids], np.int64)
        first = np.cumsum(size) - size
        ends = np.cumsum(pc.list_value_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64))
        word = np.insert(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), ends, len(ids) - 1)
        n = size[word]
        upto = np.cumsum(n)
        out = flat[np.repeat(first[word] - (upto - n), n) + np.arange(upto[-1] if len(upto) else 0)]
        return out, np.concatenate([[0], upto[ends + np.arange(len(ends))]]) if len(ends) else np.zeros(1, np.int64)


@functools.lru_cache(maxsize=1)
def _encoder(path: str) -> WordEncoder:
    """One encoder for all tasks of a worker process."""
    return WordEncoder(path)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encode every text (null: empty), append ``end_id`` and write the file set to ``path``.

    Rows go in doc_id order, null first; rows with the same doc_id by their text.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text") \
        .withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = ["doc_id", "tie", "row"]  # row only deals equal rows out to several ranges
    ranged = (key.repartitionByRange(n, *order).sortWithinPartitions(*order)
              .select(F.spark_partition_id().alias("shard"), "doc_id", "text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, start = _encoder(tokenizer), 0
        for batch in batches:
            for at, rows in slices(batch.column("text"), STEP_BYTES):
                part = batch.slice(at, rows)
                ids, ends = words(part.column("text"), end_id)
                yield pa.RecordBatch.from_arrays([
                    part.column("shard"), part.column("doc_id"), pa.array(start + ends[:-1]), pa.array(np.diff(ends)),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)),
                ], ["shard", "doc_id", "start", "n_tokens", "ids"])
                start += int(ends[-1])

    ranged.mapInArrow(encode, SCHEMA).write.options(**WRITER).parquet(path)


def _shard_bases(rows: DataFrame) -> DataFrame:
    """``(shard, base)``: the ids of all earlier shards; one row for each shard."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return (rows.groupBy("shard").agg(F.sum("n_tokens").alias("s"))
            .select("shard", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base")))


def _from_corpus_start(rows: DataFrame, shards: DataFrame) -> DataFrame:
    return (rows.join(F.broadcast(_shard_bases(shards)), "shard")
            .withColumn("start", F.col("start") + F.col("base")).drop("base", "shard"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens)`` with corpus-wide starts; reads no ids."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    return _from_corpus_start(rows.select("shard", "doc_id", "start", "n_tokens"), rows)


def read_ids(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids)``, of some documents only by the page indexes if ``doc_ids`` is given."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    return (rows if doc_ids is None else rows.filter(F.col("doc_id").isin(doc_ids))).select("doc_id", "n_tokens", "ids")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` read back from a file set."""
    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            at, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            sums = [zlib.crc32(flat[i:j].tobytes()) for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in ("shard", "doc_id", "start", "n_tokens")] + [pa.array(sums, pa.int64())],
                ["shard", "doc_id", "start", "n_tokens", "ids_crc32"])

    rows = spark.read.schema(SCHEMA).parquet(path)
    digests = rows.mapInArrow(crc, "shard int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return _from_corpus_start(digests, rows)


def encode_and_read_back(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the file set into the shared folder and return what its files say."""
    spark = docs.sparkSession
    path = f"{checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer)
    return token_digests(spark, path)
