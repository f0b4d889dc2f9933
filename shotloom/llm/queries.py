"""Registered queries of the training-data operators and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers

from shotloom.llm import oracles
from shotloom.llm.ann import nearest
from shotloom.llm.base import table
from shotloom.llm.langid import detect
from shotloom.llm.mixing import mix
from shotloom.llm.neardup import near_duplicates
from shotloom.llm.packing import pack
from shotloom.llm.pii import replace_entities
from shotloom.llm.quality import judge_quality
from shotloom.llm.runs import run_digests
from shotloom.llm.tokens import encode_and_read_back
from shotloom.llm.topk import quantised_top_k
from shotloom.llm.toxicity import judge_toxicity
from shotloom.llm.urls import judge_urls
from shotloom.llm.variants import document_variants


def op1_crf_langid(spark, sf_dir):
    return detect(table(spark, sf_dir, "documents"))


def op2_segment_topk(spark, sf_dir):
    return quantised_top_k(table(spark, sf_dir, "embeddings"))


def op3_source_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))


def op4_pairwise_quality(spark, sf_dir):
    return judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_url_templates(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages"))


def op6_cross_polytope(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"))


def op7_token_parquet(spark, sf_dir):
    return encode_and_read_back(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_minhash_neardup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_pii_surrogates(spark, sf_dir):
    return replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_best_fit_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


def op11_repair_runs(spark, sf_dir):
    return run_digests(table(spark, sf_dir, "documents"))


def op12_cnn_toxicity(spark, sf_dir):
    return judge_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_spelling_tiles(spark, sf_dir):
    return document_variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_crf_langid, op2_segment_topk, op3_source_mixing, op4_pairwise_quality, op5_url_templates,
    op6_cross_polytope, op7_token_parquet, op8_minhash_neardup, op9_pii_surrogates, op10_best_fit_packing,
    op11_repair_runs, op12_cnn_toxicity, op13_spelling_tiles)}

ORACLE = {"op2_segment_topk": oracles.OP2, "op3_source_mixing": oracles.OP3, "op5_url_templates": oracles.OP5,
          "op8_minhash_neardup": oracles.OP8, "op11_repair_runs": oracles.OP11,
          "op13_spelling_tiles": oracles.OP13}
