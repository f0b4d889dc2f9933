"""Error-correction prompts (E2-E9) as joins of a query log with rendered catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotloom.functions import text as T
from shotloom.functions.constants import (CORRECTION_HEAD, CORRECTION_HEAD_CUSTOM,
                                          CORRECTION_RULES_LINE, RULE_GROUPS)
from shotloom.operators.common import join_small_side, stored
from shotloom.sources import catalog as C


def rule_block(groups: list[int] | int) -> str:
    """E5: instruction block from rule groups, numbered in request order; unknown ids ignored."""
    if isinstance(groups, int):
        groups = [groups]
    rules = [r for g in groups for r in RULE_GROUPS.get(g, [])]
    body = "".join(f"{i}) {r}\n" for i, r in enumerate(rules, start=1))
    return CORRECTION_HEAD + CORRECTION_RULES_LINE + body + "\n"


def rule_block_custom(rules_text: str) -> str:
    """Instruction block from caller-supplied rule text."""
    return CORRECTION_HEAD_CUSTOM + CORRECTION_RULES_LINE + rules_text + "\n"


def render_catalog(cols: DataFrame) -> DataFrame:
    """Per db the fields block, foreign-key list and primary-key list."""
    flat = C.flatten(cols)
    per_table = (flat.groupBy("db_id", "table_name")
                     .agg(F.sort_array(F.collect_list(F.struct("col_idx", "column_name"))).alias("cs"))
                     .withColumn("line", F.concat(F.lit("Table "), F.col("table_name"), F.lit(", columns = ["),
                                                  F.array_join(F.transform("cs", lambda x: x["column_name"]), ","),
                                                  F.lit("]\n"))))
    fields = (per_table.groupBy("db_id")
                       .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("table_name", "line"))),
                                                     lambda x: x["line"]), "").alias("fields")))
    fk = (C.foreign_keys(cols)
           .withColumn("e", F.concat_ws("", "table_name", F.lit("."), "column_name", F.lit(" = "),
                                        "ref_table", F.lit("."), "ref_column"))
           .groupBy("db_id")
           .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col_idx", "e"))),
                                         lambda x: x["e"]), ",").alias("fk")))
    pk = (C.primary_keys(cols)
           .withColumn("e", F.concat_ws("", "table_name", F.lit("."), "column_name"))
           .groupBy("db_id")
           .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col_idx", "e"))),
                                         lambda x: x["e"]), ",").alias("pk")))
    dbs = cols.select("db_id").distinct()
    out = dbs.join(fields, "db_id", "left").join(fk, "db_id", "left").join(pk, "db_id", "left")
    return out.select("db_id", F.coalesce("fields", F.lit("")).alias("fields"),
                      F.concat(F.lit("["), F.coalesce("fk", F.lit("")), F.lit("]")).alias("fk_list"),
                      F.concat(F.lit("["), F.coalesce("pk", F.lit("")), F.lit("]")).alias("pk_list"))


def catalog_prompt(rows: DataFrame, rendered: DataFrame, rules: list[int] | int = (1, 2, 3),
                   question: str = "question", sql: str = "sql", db: str = "db_id") -> DataFrame:
    """E7 + E9: correction prompt from the catalog for every row (join on db), with its ``prompt_tokens``.

    The text of a database is joined and counted once for all its rows; it ends with
    a line end, so no token spans it and the row's own part.
    """
    instr = rule_block(list(rules) if not isinstance(rules, int) else rules)
    head = F.concat(F.lit(instr), F.col("fields"), F.lit("Foreign_keys = "), F.col("fk_list"), F.lit("\n"),
                    F.lit("Primary_keys = "), F.col("pk_list"), F.lit("\n"))
    heads = stored(rendered.select(F.col("db_id").alias(db), head.alias("_head"))
                   .withColumn("_head_tokens", T.token_count("_head")), "prompt-heads")
    j = join_small_side(rows, heads, [db], salt_of=F.col(question))
    tail = F.concat(F.lit("#### Question: "), F.col(question), F.lit("\n#### SQLite SQL QUERY\n"),
                    F.col(sql), F.lit("\n#### SQLite FIXED SQL QUERY\nSELECT"))
    prompt = F.concat("_head", tail)
    return (j.withColumn("prompt", prompt)
            .withColumn("prompt_tokens", F.when(prompt.isNull(), 0).otherwise(F.col("_head_tokens") + T.token_count(tail)))
            .drop("_head", "_head_tokens"))


def schema_prompt(rows: DataFrame, schemas: DataFrame, rules: list[int] | int | str = (1, 2, 3),
                  question: str = "question", sql: str = "sql", db: str = "db_id",
                  evidence: Column | None = None) -> DataFrame:
    """E8 + E9: correction prompt from schema text and optional evidence (concat, X15)."""
    instr = rule_block_custom(rules) if isinstance(rules, str) else rule_block(
        list(rules) if not isinstance(rules, int) else rules)
    j = join_small_side(rows, schemas.withColumnRenamed("db_id", db), [db], salt_of=F.col(question))
    ev = evidence if evidence is not None else F.lit(None).cast("string")
    schema_part = F.when(F.coalesce(F.length("schema_text"), F.lit(0)) > 0,
                         F.concat(F.lit("#### Table Schema:\n"), F.col("schema_text"), F.lit("\n\n"))).otherwise("")
    ev_part = F.when(F.coalesce(F.length(ev), F.lit(0)) > 0,
                     F.concat(F.lit("#### Additional Evidence:\n"), ev, F.lit("\n\n"))).otherwise("")
    prompt = F.concat(F.lit(instr), schema_part, ev_part, F.lit("#### Question:\n"), F.col(question),
                      F.lit("\n#### SQLite SQL QUERY:\n"), F.col(sql),
                      F.lit("\n\n#### SQLite FIXED SQL QUERY\nSELECT"))
    return j.withColumn("prompt", prompt).drop("schema_text")
