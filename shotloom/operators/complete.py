"""Batch completion (B1-B3): prompts -> responses with an injected completer, per partition.

The completer is any picklable callable ``prompt -> (text, total_tokens)``; it is
created once per partition through ``completer_factory``, so a network client is
built per task, never per row. Failed rows keep ``ok = false`` and a null text,
aligned by id (not by position).
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotloom.functions import text as T
from shotloom.operators.common import stored

Completer = Callable[[str], tuple[str, int]]


def batch_complete(prompts: DataFrame, completer_factory: Callable[[], Completer], id_col: str = "idx",
                   prompt_col: str = "prompt", attempts: int = 5, backoff_s: float = 1.0) -> DataFrame:
    """B1 + B2: (id, raw, sql, ok, attempts, total_tokens); ``sql`` is post-processed (C4)."""

    def run(it):
        complete = completer_factory()
        for pdf in it:
            raws, oks, tries, toks = [], [], [], []
            for p in pdf[prompt_col]:
                raw, ok, used, ntok = None, False, 0, None
                for a in range(1, attempts + 1):
                    used = a
                    try:
                        raw, ntok = complete(p)
                        ok = True
                        break
                    except Exception:  # noqa: BLE001 - any client failure is retried, then recorded
                        if a < attempts and backoff_s > 0:
                            time.sleep(backoff_s)
                raws.append(raw)
                oks.append(ok)
                tries.append(used)
                toks.append(ntok)
            yield pd.DataFrame({"id": pdf["id"], "raw": raws, "ok": oks,
                                "attempts": pd.Series(tries, dtype="int64"),
                                "total_tokens": pd.Series(toks, dtype="float64")})

    src = prompts.select(F.col(id_col).alias("id"), F.col(prompt_col))
    out = src.mapInPandas(run, "id bigint, raw string, ok boolean, attempts bigint, total_tokens double")
    out = out.withColumn("sql", F.when(F.col("ok"), T.postprocess_sql(F.coalesce(F.col("raw"), F.lit("")))))
    return out.select(F.col("id").alias(id_col), "raw", "sql", "ok", "attempts",
                      F.col("total_tokens").cast("bigint").alias("total_tokens"))


def completion_stats(responses: DataFrame) -> DataFrame:
    """Number of questions, failures, total tokens and mean tokens per question."""
    return responses.agg(F.count("*").cast("bigint").alias("n_questions"),
                         F.sum((~F.col("ok")).cast("int")).cast("bigint").alias("n_failed"),
                         F.sum("total_tokens").cast("bigint").alias("total_tokens"),
                         F.round(F.avg("total_tokens"), 6).alias("mean_tokens"))


#: Fixed headings around the query that a correction prompt asks about.
QUERY_MARK, FIXED_MARK = "#### SQLite SQL QUERY\n", "\n#### SQLite FIXED SQL QUERY"


def unchanged_responses(prompts: DataFrame, id_col: str = "idx", prompt_col: str = "prompt",
                        tokens_col: str | None = None) -> DataFrame:
    """B2 over prompts that need no model: each is answered by the query that it asks about.

    Columns as :func:`batch_complete`, by column expressions alone: the text between the
    headings (the whole prompt without them), cleaned as any response, and the tokens of
    prompt and answer. It is the floor that a model's corrections are compared with.
    ``tokens_col`` names the prompts' token counts where they are known already.
    """
    prompt = F.col(prompt_col)
    at = F.instr(prompt, QUERY_MARK)
    body = F.when(at > 0, F.substr(prompt, at + len(QUERY_MARK), F.length(prompt))).otherwise(prompt)
    raw = F.substring_index(body, FIXED_MARK, 1)
    known = F.col(tokens_col) if tokens_col else T.token_count(prompt)
    return (prompts.select(F.col(id_col), known.alias("_tokens"), raw.alias("raw"))
            .select(id_col, "raw", T.postprocess_sql(F.coalesce("raw", F.lit(""))).alias("sql"), F.lit(True).alias("ok"),
                    F.lit(1).cast("bigint").alias("attempts"),
                    (F.col("_tokens") + T.token_count("raw")).alias("total_tokens")))


def execute_candidates(candidates: DataFrame, sql_col: str = "sql", id_col: str = "idx",
                       batch: int = 1000) -> DataFrame:
    """B4 + B5: run each distinct candidate statement with ``spark.sql`` on the registered views.

    Returns (id, status 'result'/'exception', valid 0/1, n_rows, columns, error).
    Statements are submitted by the driver (Spark's SQL entry point), once per
    distinct text; they reach it a partition at a time, and their outcomes are
    written every ``batch`` statements, so it holds neither all of them nor results.
    """
    spark = candidates.sparkSession
    schema = "sql string, status string, valid int, n_rows bigint, columns string, error string"
    done, rows = spark.createDataFrame([], schema), []
    for r in candidates.select(F.col(sql_col).alias("sql")).distinct().toLocalIterator():
        try:
            df = spark.sql(r.sql)
            rows.append((r.sql, "result", 1, df.count(), ",".join(df.columns), None))
        except Exception as ex:  # noqa: BLE001 - any analysis or runtime failure is a result
            rows.append((r.sql, "exception", 0, None, None, str(ex).splitlines()[0][:500]))
        if len(rows) == batch:
            done, rows = done.union(stored(spark.createDataFrame(rows, schema), "executed")), []
    res = done.union(spark.createDataFrame(rows, schema))
    return candidates.select(F.col(id_col), F.col(sql_col).alias("sql")).join(res, "sql", "left")
