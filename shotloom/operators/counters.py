"""Token counters (T1): the built-in column expression, or a caller's function.

A caller's counter is built once per task and sees each distinct text once, however
many rows carry it; the counts come back by a join on the text's digest. Whether its
counts add up over parts that white space separates decides how prompts are counted:
an additive counter's parts are counted and summed, any other counts whole sections
and whole prompts again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotloom.functions import text as T
from shotloom.operators.common import join_small_side, stored

Count = Callable[[list[str]], list[int]]


@dataclass(frozen=True)
class TokenCounter:
    """``build`` makes a function from texts to counts (None: words and marks, by Spark); null counts as empty."""

    build: Callable[[], Count] | None = None
    additive: bool = True

    def constant(self, text: str | None) -> Column:
        """The count of a fixed text, 0 for none."""
        if text is None:
            return F.lit(0).cast("bigint")
        if self.build is None:
            return T.token_count(F.lit(text))
        return F.lit(int(self.build()([text])[0])).cast("bigint")

    def add(self, df: DataFrame, **texts: Column) -> DataFrame:
        """``df`` with a bigint column of counts for each named text."""
        for name, text in texts.items():
            df = df.withColumn(name, T.token_count(text)) if self.build is None else self._join(df, name, text)
        return df

    def _join(self, df: DataFrame, name: str, text: Column) -> DataFrame:
        key, build = f"_text_{uuid.uuid4().hex[:8]}", self.build
        text = F.coalesce(text, F.lit(""))
        df = df.withColumn(key, F.sha2(text, 256))
        distinct = df.groupBy(key).agg(F.first(text).alias("text"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count = None
            for b in batches:
                count = count or build()
                counts = count(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(int, counts), pa.int64())], [key, name])

        counted = stored(distinct.mapInArrow(run, f"`{key}` string, `{name}` bigint"), "token-counts")
        # the row itself varies within a hot text
        salt = F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if f.dataType.typeName() != "map"])
        return join_small_side(df.drop(name), counted, [key], salt).drop(key)


WORDS_AND_MARKS = TokenCounter()
