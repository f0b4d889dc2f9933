"""Prompt assembly (T1-T13): token counting, costs, budgeted demo packing, templates.

Packing is greedy and stops at the first demonstration that overflows; because
costs are non-negative this equals keeping the ranks whose running cost sum
fits, a window ``sum`` over at most k rows per target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotloom.functions.constants import PRICE_PER_1K, TEMPLATES
from shotloom.operators.common import join_small_side, ordered_prefix, stored
from shotloom.operators.counters import WORDS_AND_MARKS, TokenCounter


def chat_tokens(messages: DataFrame, conv: str = "conv_id", role: str = "role",
                content: str = "text", name: str | None = None, counter: TokenCounter = WORDS_AND_MARKS) -> DataFrame:
    """4 per message + tokens of every field (-1 when a name is given) + 2 per conversation."""
    fields = {"_role_tokens": F.col(role), "_text_tokens": F.col(content)} | ({"_name_tokens": F.col(name)} if name else {})
    messages = counter.add(messages, **fields)
    per = F.lit(4) + F.col("_role_tokens") + F.col("_text_tokens")
    if name:
        per = per + F.when(F.col(name).isNotNull(), F.col("_name_tokens") - 1).otherwise(0)
    return (messages.groupBy(conv)
                    .agg(F.count("*").alias("n_messages"), (F.sum(per) + 2).cast("bigint").alias("n_tokens")))


def price_rows(models: list[str] | None = None) -> Column:
    """Literal array of (model, price_per_1k); a model without a price gets null."""
    names = models or list(PRICE_PER_1K)
    return F.array(*[F.struct(F.lit(m).alias("model"),
                              F.lit(PRICE_PER_1K.get(m)).cast("double").alias("price_per_1k"))
                     for m in names])


def cost_report(token_rows: DataFrame, models: list[str] | None = None,
                tokens: str = "n_tokens") -> DataFrame:
    """T3 + T4: total tokens and cost per model over a whole corpus (null for an unknown model).

    One global aggregate (partial sums per task), then one row per model from a
    literal price list; cost is linear, so it is applied to the exact integer total.
    """
    tot = token_rows.agg(F.count("*").alias("n_prompts"), F.sum(tokens).cast("bigint").alias("total_tokens"))
    out = tot.select("n_prompts", "total_tokens", F.explode(price_rows(models)).alias("p"))
    return out.select(F.col("p.model").alias("model"), "n_prompts", "total_tokens",
                      F.round(F.col("total_tokens") * F.col("p.price_per_1k") / 1000.0, 6).alias("total_cost"))


def fill_question_section(tpl: dict, question: Column, schema: Column,
                          evidence: Column | None = None) -> Column:
    """Prefix, schema, evidence (if the template has it and the row has one), body, suffix."""
    parts = []
    if tpl["q_prefix"]:
        parts.append(F.lit(tpl["q_prefix"]))
    parts.append(schema)
    if tpl.get("q_evidence") and evidence is not None:
        pre, post = tpl["q_evidence"].split("{evidence}")
        parts.append(F.when(F.length(evidence) > 0, F.concat(F.lit(pre), evidence, F.lit(post))))
    if tpl["q_body"]:
        pre, post = tpl["q_body"].split("{question}")
        parts.append(F.concat(F.lit(pre), question, F.lit(post)))
    if tpl["q_suffix"]:
        parts.append(F.lit(tpl["q_suffix"]))
    return F.concat_ws(tpl["q_sep"], *parts)


def format_demo(fmt: str, question: Column, query: Column) -> Column:
    """One demonstration text."""
    a, rest = fmt.split("{question}")
    b, c = rest.split("{query}")
    return F.concat(F.lit(a), F.coalesce(question, F.lit("")), F.lit(b), F.coalesce(query, F.lit("")), F.lit(c))


def packed_cost(mode: str, pos: Column, cum: Column, sep: Column, fixed: Column) -> Column:
    """Tokens used after taking demos 0..pos, for the three packing forms.

    'section' (T8): fixed + demos + a separator before every demo but the first;
    'sep_each' (T9): fixed + demos + a separator on every demo;
    'flat' (T10): demos + separators between them, no fixed part.
    """
    if mode == "section":
        return fixed + cum + pos * sep
    if mode == "sep_each":
        return fixed + cum + (pos + 1) * sep
    if mode == "flat":
        return cum + pos * sep
    raise ValueError(mode)


def pack(demos: DataFrame, budget: Column, cost: Column, mode: str = "section",
         sep_tokens: Column | None = None, fixed: Column | None = None,
         part: str = "target_id", order: str = "rank", bounded: bool = False) -> DataFrame:
    """Flag ``kept`` on the longest prefix (by ``order``) whose cost fits ``budget``.

    Greedy with a stop at the first overflow equals this prefix because costs are
    non-negative. With ``bounded`` (at most k candidates per key, e.g. top-k
    picks) a plain window does it; otherwise positions and running sums come
    from :func:`ordered_prefix`, so even one huge candidate list spans many tasks.
    """
    sep = sep_tokens if sep_tokens is not None else F.lit(0)
    fx = fixed if fixed is not None else F.lit(0)
    if bounded:
        w = Window.partitionBy(part).orderBy(order)
        d = (demos.withColumn("_cost", cost)
                  .withColumn("_pos", F.row_number().over(w) - 1)
                  .withColumn("_cum", F.sum("_cost").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    else:
        d = ordered_prefix(demos.withColumn("_cost", cost), [part], [order], value=F.col("_cost"))
    used = packed_cost(mode, F.col("_pos"), F.col("_cum"), sep, fx)
    return d.withColumn("kept", used <= budget).drop("_cost", "_pos", "_cum")


def build_prompts(targets: DataFrame, picks: DataFrame, pool: DataFrame, schemas: DataFrame,
                  template: str = "template_option_1", evidence: str | None = None,
                  counter: TokenCounter = WORDS_AND_MARKS) -> DataFrame:
    """T5-T13 + P7: the end-to-end prompt per target.

    targets (idx, question, db_id[, evidence]); picks (target_id, demo_id, rank);
    pool (idx, question, query); schemas (db_id, schema_text).
    Instruction and question are charged first, demonstrations get the rest;
    a prompt over ``max_tokens`` is kept with ``status = 'over_budget'`` (X27).
    ``counter`` counts everything; one that does not add up over parts counts the
    question section and the finished prompt whole.
    """
    tpl = TEMPLATES[template]
    sec_sep, demo_sep = tpl["section_sep"], tpl["demo_sep"]
    n_sec_sep = counter.constant(sec_sep)
    instr = tpl["instruction"]
    n_instr = counter.constant(instr)

    # With whitespace separators no token spans two parts, so a text's count is
    # the sum of its parts' counts: the schema is counted once per database and
    # the final prompt is never re-tokenised.
    additive = counter.additive and all(tpl[k].strip() == "" for k in ("q_sep", "demo_sep", "section_sep"))
    if additive:
        schemas = stored(counter.add(schemas, schema_tokens=F.col("schema_text")), "schemas")
    ev = F.col(evidence) if evidence else None
    if additive:
        # Only the schema's token count travels through the shuffles; its text
        # (identical for every row of a database) is attached once at the end.
        t = join_small_side(targets, schemas.select("db_id", "schema_tokens"), ["db_id"],
                            salt_of=F.col("idx"), how="left")
    else:
        t = join_small_side(targets, schemas, ["db_id"], salt_of=F.col("idx"), how="left")
        t = t.withColumn("q_section", fill_question_section(tpl, F.col("question"), F.col("schema_text"), ev))
    if additive:
        row_part = fill_question_section({**tpl, "q_prefix": None, "q_suffix": None}, F.col("question"),
                                         F.lit(None).cast("string"), ev)
        t = counter.add(t, row_tokens=row_part)
        q_tokens = (counter.constant(tpl["q_prefix"] or "") + F.coalesce(F.col("schema_tokens"), F.lit(0))
                    + counter.constant(tpl["q_suffix"] or "") + F.col("row_tokens"))
        t = t.withColumn("q_tokens", q_tokens).drop("row_tokens")
    else:
        t = counter.add(t, q_tokens=F.col("q_section"))
    n_valid = F.lit(2 if instr is not None else 1)
    t = t.withColumn("balance", F.lit(tpl["max_tokens"]) - n_instr - F.col("q_tokens")
                     - (n_valid - 1) * n_sec_sep - n_sec_sep)

    prefix, suffix = tpl["demo_prefix"], tpl["demo_suffix"]
    n_demo_sep = counter.constant(demo_sep)
    ends = F.lit(int(prefix is not None) + int(suffix is not None))
    fixed = counter.constant(prefix) + counter.constant(suffix) + ends * n_demo_sep

    # Each demonstration is formatted and counted once; only ids and costs are joined and
    # packed, and the texts follow for the kept picks alone.
    p = pool.select(F.col("idx").alias("demo_id"),
                    format_demo(tpl["demo_format"], F.col("question"), F.col("query")).alias("dtext"))
    p = stored(counter.add(p, cost=F.col("dtext")), "demos")
    d = picks.join(p.select("demo_id", "cost"), "demo_id")
    d = d.join(t.select(F.col("idx").alias("target_id"), "balance"), "target_id")
    d = stored(pack(d, F.col("balance"), F.col("cost"), mode="section", sep_tokens=n_demo_sep,
                    fixed=fixed, bounded=True).select("target_id", "demo_id", "rank", "cost", "kept"), "picks")
    ids = (d.groupBy("target_id")
            .agg(F.sort_array(F.collect_list(F.struct("rank", "demo_id"))).alias("ds"),
                 F.sum(F.when(F.col("kept"), F.col("cost")).otherwise(0)).alias("kept_tokens"))
            .select("target_id", "kept_tokens", F.transform("ds", lambda x: x["demo_id"]).alias("demonstrations_idxs"),
                    F.size("ds").cast("bigint").alias("num_demonstrations")))
    texts = (d.filter("kept").join(p.select("demo_id", "dtext"), "demo_id").groupBy("target_id")
              .agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "demo_id", "dtext"))),
                               lambda x: x["dtext"]).alias("kept_texts")))
    agg = ids.join(texts, "target_id", "left")
    out = t.join(agg, t["idx"] == agg["target_id"], "left").drop("target_id")
    if additive:
        out = join_small_side(out, schemas.select("db_id", "schema_text"), ["db_id"],
                              salt_of=F.col("idx"), how="left")
        out = out.withColumn("q_section", fill_question_section(tpl, F.col("question"), F.col("schema_text"), ev))
    kept = F.coalesce(F.col("kept_texts"), F.array().cast("array<string>"))
    demo_parts = [F.lit(prefix)] if prefix is not None else []
    demo_parts.append(F.array_join(kept, demo_sep))
    if suffix is not None:
        demo_parts.append(F.lit(suffix))
    demo_section = F.concat_ws(demo_sep, *demo_parts)
    sections = ([F.lit(instr)] if instr is not None else []) + [demo_section, F.col("q_section")]
    out = out.withColumn("prompt", F.concat_ws(sec_sep, *sections))
    if additive:
        demo_tokens = fixed - ends * n_demo_sep + F.coalesce(F.col("kept_tokens"), F.lit(0))
        out = out.withColumn("num_tokens", (n_instr + demo_tokens + F.col("q_tokens")).cast("bigint"))
    else:
        out = counter.add(out, num_tokens=F.col("prompt"))
    out = out.withColumn("num_packed", F.size(kept).cast("bigint"))
    out = out.withColumn("status", F.when(F.col("num_tokens") > tpl["max_tokens"], "over_budget")
                                    .when(F.length("prompt") == 0, "empty").otherwise("ok"))
    return out.drop("kept_texts", "kept_tokens", "q_section", "q_tokens", "balance", "schema_text",
                    "schema_tokens")


def build_flat_prompts(targets: DataFrame, picks: DataFrame, pool: DataFrame, schemas: DataFrame,
                       option: str = "option_1", max_tokens: int = 4096,
                       counter: TokenCounter = WORDS_AND_MARKS) -> DataFrame:
    """T6 + T10: the flat string template filled with flat-packed demonstrations.

    Demonstrations ("### Answer the following question: q\\nsql") are packed in
    rank order while demos + separators fit the budget left after the template's
    other parts; missing demos or schema drop their header entirely.
    """
    from shotloom.functions.constants import FLAT_DEMO_FORMAT, FLAT_TEMPLATES
    tpl = FLAT_TEMPLATES[option]
    sep = "\n\n"
    schemas = stored(counter.add(schemas, schema_tokens=F.col("schema_text")), "schemas")
    t = join_small_side(targets, schemas.select("db_id", "schema_tokens"), ["db_id"], salt_of=F.col("idx"), how="left")
    qa, qb = tpl["question"].split("{question}")
    q_part = F.concat(F.lit(qa), F.col("question"), F.lit(qb))
    fixed = (counter.constant(tpl["head"]) + counter.constant(tpl["demo_header"]) + counter.constant(tpl["schema_header"])
             + F.coalesce(F.col("schema_tokens"), F.lit(0)) + F.col("q_tokens"))
    t = counter.add(t, q_tokens=q_part).withColumn("balance", F.lit(max_tokens) - fixed)
    # Each demonstration is formatted and counted once; ids and costs are packed, kept texts follow.
    p = pool.select(F.col("idx").alias("demo_id"), format_demo(FLAT_DEMO_FORMAT, F.col("question"), F.col("query")).alias("dtext"))
    p = stored(counter.add(p, cost=F.col("dtext")), "demos")
    d = picks.join(p.select("demo_id", "cost"), "demo_id")
    d = d.join(t.select(F.col("idx").alias("target_id"), "balance"), "target_id")
    d = pack(d, F.col("balance"), F.col("cost"), mode="flat", sep_tokens=counter.constant(sep), bounded=True).filter("kept")
    agg = (d.select("target_id", "demo_id", "rank", "cost").join(p.select("demo_id", "dtext"), "demo_id").groupBy("target_id")
            .agg(F.sort_array(F.collect_list(F.struct("rank", "dtext"))).alias("ds"), F.sum("cost").alias("kept_tokens"))
            .select("target_id", "kept_tokens", F.transform("ds", lambda x: x["dtext"]).alias("kept")))
    out = t.join(agg, t["idx"] == agg["target_id"], "left").drop("target_id")
    out = join_small_side(out, schemas.select("db_id", "schema_text"), ["db_id"], salt_of=F.col("idx"), how="left")
    kept = F.coalesce(F.col("kept"), F.array().cast("array<string>"))
    demo_text = F.array_join(kept, sep)
    demo_part = F.when(F.size(kept) > 0, F.concat(F.lit(tpl["demo_header"]), demo_text, F.lit(sep))).otherwise("")
    has_schema = F.coalesce(F.length("schema_text"), F.lit(0)) > 0
    schema_part = F.when(has_schema, F.concat(F.lit(tpl["schema_header"]), F.col("schema_text"), F.lit(sep))).otherwise("")
    prompt = F.concat(F.lit(tpl["head"]), demo_part, schema_part, q_part)
    out = out.withColumn("num_packed", F.size(kept).cast("bigint")).withColumn("prompt", prompt)
    if counter.additive:  # headers end and separators consist of white space, so the parts add up
        demos = F.when(F.size(kept) > 0, counter.constant(tpl["demo_header"]) + F.col("kept_tokens")).otherwise(0)
        schema = F.when(has_schema, counter.constant(tpl["schema_header"]) + F.col("schema_tokens")).otherwise(0)
        total = counter.constant(tpl["head"]) + demos + schema + F.col("q_tokens")
        out = out.withColumn("num_tokens", F.when(F.col("prompt").isNull(), 0).otherwise(total).cast("bigint"))
    else:
        out = counter.add(out, num_tokens=F.col("prompt"))
    return out.select("idx", "num_packed", "prompt", "num_tokens")
