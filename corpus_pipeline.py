"""Corpus pipeline: language ID, near-dedup, PII surrogates, source mixing, packing.

``STAGES`` are applied in order to ``documents``; each stage's rows are written as
Parquet in the shared checkpoint folder and read back as the next one's input.
All stages but the last return the columns of their input.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotloom.llm.base import crc_mod, stored, table
from shotloom.llm.langid import UNKNOWN, label_languages, train
from shotloom.llm.mixing import mixed_documents
from shotloom.llm.neardup import digest, kept_rows
from shotloom.llm.packing import pack
from shotloom.llm.pii import replace_entities
from shotloom.operators.common import join_small_side


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a recognisable language (null or letterless); name missing languages.

    Without labelled documents to learn from, only the text decides and ``lang`` stays.
    """
    model = train(docs, F.coalesce(crc_mod(F.col("doc_id"), 4) != 2, F.lit(False)))
    if model is None:
        return docs.filter(F.regexp_like("text", F.lit(r"\p{L}")))
    known = label_languages(docs, model).filter(F.col("lang_pred") != UNKNOWN)
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group linked by 0.8 similarity of five-word shingles.

    Rows are judged by their texts, whether they share a doc_id or not. Rows without
    doc_id stay; of rows with the same doc_id and text, one stays.
    """
    same = ["doc_id", "digest"]
    judged = stored(kept_rows(docs, width=5, percent=80), "kept")
    gone = judged.filter(~F.col("kept")).select(*same).distinct()
    twice = judged.filter("kept and doc_id is not null").groupBy(*same).count().filter("count > 1").select(*same)
    tag = f"_digest_{uuid.uuid4().hex[:8]}"
    marked, other = docs.withColumn(tag, digest()), gone.union(twice).withColumnRenamed("digest", tag)
    once = join_small_side(marked, other, ["doc_id", tag], F.col("doc_id"), how="left_anti")
    if not twice.isEmpty():
        number = f"_number_{uuid.uuid4().hex[:8]}"
        order = Window.partitionBy("doc_id", tag).orderBy(*[c for c in ("source", "lang") if c in docs.columns], tag)
        first = (marked.join(twice.withColumnRenamed("digest", tag), ["doc_id", tag], "left_semi")
                 .withColumn(number, F.row_number().over(order)).filter(F.col(number) == 1).drop(number))
        once = once.unionByName(first)
    return once.select(*docs.columns)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data and secrets by surrogates; n_chars follows a changed text."""
    out = replace_entities(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("entities") > 0, F.length("text").cast("long"))
                             .otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the source mix takes it."""
    return mixed_documents(docs).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its bin."""
    return pack(docs)


STAGES = [("language", language), ("near_dedup", near_dedup), ("pii", private), ("mixing", mixture),
          ("packing", packing)]

#: The language model and the signatures are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
