"""Pluggable token counters: built once per task, each text once, additive or not."""

import math
import re

import pytest
from pyspark.sql import functions as F

from shotloom.functions.constants import FLAT_DEMO_FORMAT, FLAT_TEMPLATES, TEMPLATES
from shotloom.operators import prompt as PR
from shotloom.operators.counters import TokenCounter

def counters():
    """The counters under test, as closures: workers cannot import this module."""
    def words_once():
        # the built-in rule in Python; a text that comes twice in a task is an error
        words, seen = re.compile(r"[^\W]+|[^\w\s]"), set()

        def count(texts):
            assert not seen & set(texts) and len(set(texts)) == len(texts)
            seen.update(texts)
            return [len(words.findall(t)) for t in texts]

        return count

    def quarters():
        # not additive: every text rounds up for itself
        return lambda texts: [math.ceil(len(t) / 4) for t in texts]

    return TokenCounter(words_once), TokenCounter(quarters, additive=False)


ADDITIVE, ROUNDED = counters()


@pytest.fixture(scope="module")
def inputs(spark):
    targets = [(i, f"How many of number {i % 7}?" + " really" * (i % 5), f"db{i % 3}", "some hint" if i % 2 else None) for i in range(40)]
    pool = [(100 + j, f"question {j} " + "word " * (j * 3 % 50), f"SELECT {j}") for j in range(30)]
    picks = [(i, 100 + (i * 7 + r) % 30, r) for i in range(40) for r in range(1, 6)]
    schemas = [("db0", "CREATE TABLE t (\n  a INTEGER\n)" * 3), ("db1", "CREATE TABLE u (b TEXT)")]
    return (spark.createDataFrame(targets, "idx long, question string, db_id string, evidence string"),
            spark.createDataFrame(picks, "target_id long, demo_id long, rank long"),
            spark.createDataFrame(pool, "idx long, question string, query string"),
            spark.createDataFrame(schemas, "db_id string, schema_text string"), targets, pool, picks, dict(schemas))


def rows(df):
    return {r.idx: (r.prompt, r.num_tokens, r.num_packed) for r in df.collect()}


def test_additive_counter_equals_the_built_in(spark, inputs):
    t, picks, pool, schemas = inputs[:4]
    for template in ("template_option_1", "template_option_4"):
        assert rows(PR.build_prompts(t, picks, pool, schemas, template, "evidence")) == \
            rows(PR.build_prompts(t, picks, pool, schemas, template, "evidence", ADDITIVE))
    assert rows(PR.build_flat_prompts(t, picks, pool, schemas)) == rows(PR.build_flat_prompts(t, picks, pool, schemas, counter=ADDITIVE))


def test_other_counters_count_sections_and_prompts_whole(spark, inputs, monkeypatch):
    t, picks, pool, schemas, target_rows, pool_rows, pick_rows, ddl = inputs
    tpl = {**TEMPLATES["template_option_1"], "max_tokens": 260}
    monkeypatch.setitem(PR.TEMPLATES, "template_option_1", tpl)
    got = PR.build_prompts(t, picks, pool, schemas, "template_option_1", counter=ROUNDED).collect()
    count = lambda x: 0 if x is None else math.ceil(len(x) / 4)
    demos = {j: tpl["demo_format"].format(question=q, query=s) for j, q, s in pool_rows}
    tight = set()
    for r in got:
        _, question, db, _ = target_rows[r.idx]
        parts = [tpl["q_prefix"], ddl.get(db), tpl["q_body"].format(question=question), tpl["q_suffix"]]
        section = tpl["q_sep"].join(p for p in parts if p)
        left = tpl["max_tokens"] - count(tpl["instruction"]) - count(section) - \
            (2 if tpl["instruction"] is not None else 1) * count(tpl["section_sep"])
        ends = [x for x in (tpl["demo_prefix"], tpl["demo_suffix"]) if x is not None]
        used, kept = sum(map(count, ends)) + len(ends) * count(tpl["demo_sep"]), []
        for place, demo in enumerate(d for i, d, _ in pick_rows if i == r.idx):
            used += count(demos[demo]) + (count(tpl["demo_sep"]) if place else 0)
            if used > left:
                tight.add(place)
                break
            kept.append(demos[demo])
        inner = [tpl["demo_prefix"], *kept, tpl["demo_suffix"]]
        texts = [tpl["instruction"], tpl["demo_sep"].join(x for x in inner if x is not None), section]
        prompt = tpl["section_sep"].join(x for x in texts if x is not None)
        assert r.num_packed == len(kept) and r.num_tokens == count(prompt) == count(r.prompt)
    assert len(tight) > 1  # the budget did cut, at different places


def test_flat_prompts_with_a_rounding_counter(spark, inputs):
    t, picks, pool, schemas, target_rows, pool_rows, pick_rows, ddl = inputs
    count = lambda x: math.ceil(len(x) / 4)
    tpl = FLAT_TEMPLATES["option_2"]
    demos = {j: FLAT_DEMO_FORMAT.format(question=q, query=s) for j, q, s in pool_rows}
    for r in PR.build_flat_prompts(t, picks, pool, schemas, "option_2", 220, ROUNDED).collect():
        _, question, db, _ = target_rows[r.idx]
        body = tpl["question"].format(question=question)
        left = 220 - sum(map(count, (tpl["head"], tpl["demo_header"], tpl["schema_header"], body))) - (count(ddl[db]) if db in ddl else 0)
        used, kept = 0, 0
        for place, demo in enumerate(d for i, d, _ in pick_rows if i == r.idx):
            used += count(demos[demo]) + (count("\n\n") if place else 0)
            if used > left:
                break
            kept += 1
        assert r.num_packed == kept and r.num_tokens == count(r.prompt)


def test_counts_come_back_to_every_row(spark):
    hot = [(i, "the same text" if i % 3 else None, {"k": i}) for i in range(900)]
    df = spark.createDataFrame(hot, "id long, text string, m map<string,long>").repartition(7)
    got = ADDITIVE.add(df, n=F.col("text")).collect()
    assert len(got) == 900 and all(r.n == (3 if r.id % 3 else 0) and r.m["k"] == r.id for r in got)
    chats = spark.createDataFrame([(1, "user", "hello there"), (1, "user", "hello there"), (2, "bot", None)], "conv_id long, role string, text string")
    assert {tuple(r) for r in PR.chat_tokens(chats, counter=ADDITIVE).collect()} == {tuple(r) for r in PR.chat_tokens(chats).collect()}
