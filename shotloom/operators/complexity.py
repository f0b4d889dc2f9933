"""SQL structure features and the easy/medium/hard/extra label.

Features come from the lower-cased token stream of cleaned SQL (no parser):
clause keywords, joins, connectives, nested SELECTs and set operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotloom.functions import text as T
from shotloom.functions.constants import LITERAL_RE

AGG_FUNCS = ("max", "min", "count", "sum", "avg")
SET_OPS = ("intersect", "union", "except")


def _n_tok(spaced: Column, word: str) -> Column:
    """Occurrences of token ``word`` in the token stream joined by two spaces.

    With two-space separators the matches of ``' word '`` cannot overlap, so the
    count is exact; one ``replace`` is far cheaper than filtering the array.
    """
    return _n_sub(spaced, f" {word} ")


def _spaced(toks: Column) -> Column:
    return F.concat(F.lit("  "), F.concat_ws("  ", toks), F.lit("  "))


def _n_sub(s: Column, pat: str) -> Column:
    """Occurrences of literal ``pat`` in ``s``."""
    return ((F.length(s) - F.length(F.replace(s, F.lit(pat), F.lit("")))) / F.lit(len(pat))).cast("bigint")


def _clause(s: Column, start: str, stops: tuple[str, ...]) -> Column:
    """Text after the first ``start`` up to the first of ``stops`` (space-padded tokens)."""
    at = F.locate(start, s)
    after = F.when(at > 0, F.substr(s, at + F.lit(len(start)))).otherwise(F.lit(""))
    for st in stops:
        after = F.substring_index(after, st, 1)
    return after


def outer_query(toks: Column) -> Column:
    """struct(out, setop): the tokens of the first outermost query, two spaces apart.

    A parenthesised query inside it is one token ``subquery``; what follows a set
    operation belongs to another query and only sets ``setop``.
    """
    start = F.struct(F.lit(0).alias("skip"), F.lit(0).alias("setop"), F.lit("").alias("out"))
    pairs = F.zip_with(toks, F.slice(toks, 2, F.greatest(F.size(toks), F.lit(1))),
                       lambda t, n: F.struct(t.alias("t"), n.alias("n")))

    def state(skip, setop, out) -> Column:
        return F.struct(skip.alias("skip"), setop.alias("setop"), out.alias("out"))

    def step(s: Column, x: Column) -> Column:
        t, out = x["t"], s["out"]
        depth = s["skip"] + F.when(t == "(", 1).when(t == ")", -1).otherwise(0)
        opens = (t == "(") & F.coalesce(x["n"] == "select", F.lit(False))
        return (F.when(s["setop"] == 1, s)
                .when(s["skip"] > 0, state(depth, s["setop"], out))
                .when(opens, state(F.lit(1), s["setop"], F.concat(out, F.lit("  subquery"))))
                .when(t.isin(*SET_OPS), state(F.lit(0), F.lit(1), out))
                .otherwise(state(F.lit(0), s["setop"], F.concat(out, F.lit("  "), t))))

    return F.aggregate(pairs, start, step, lambda s: F.struct(F.concat(s["out"], F.lit("  ")).alias("out"),
                                                              s["setop"].cast("bigint").alias("setop")))


def _commas(s: Column) -> Column:
    """Commas of a clause outside all parentheses, however deep these are."""
    marks = F.split(F.regexp_replace(s, "[^(),]", ""), "")

    def step(a: Column, c: Column) -> Column:
        depth = F.greatest(F.lit(0), a["depth"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0))
        return F.struct(depth.alias("depth"), (a["n"] + ((c == ",") & (a["depth"] == 0)).cast("bigint")).alias("n"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("n"))
    return F.aggregate(marks, start, step, lambda a: a["n"])


def sql_shape(df: DataFrame, query: str = "query") -> DataFrame:
    """M3b structure counts of the outermost query of each row, from cleaned lower-case tokens.

    String literals count as one token. Nested queries and the second side of a set
    operation add to ``n_nested`` and ``n_setop`` only; joins are tables less one;
    the AND of a BETWEEN joins no conditions; aggregates are those of the select
    list, grouping and ordering, and negated conditions count with them.
    """
    clean = F.regexp_replace(T.join_split_ops(T.postprocess_sql(F.col(query))), LITERAL_RE, " value ")
    d = df.withColumn("_tk", T.sql_tokens(clean)).withColumn("_o", outer_query(F.col("_tk")))
    d = d.withColumn("_s", F.concat(F.lit(" "), F.regexp_replace(F.trim(F.col("_o.out")), " +", " "), F.lit(" ")))
    stops = (" from ", " where ", " group by ", " having ", " order by ", " limit ")
    s = F.col("_s")
    starts = {"_sel": (" select ", stops), "_frm": (" from ", stops[1:]), "_whr": (" where ", stops[2:]),
              "_grp": (" group by ", stops[3:]), "_hav": (" having ", stops[4:]), "_ord": (" order by ", stops[5:])}
    d = d.select("*", *[F.concat(F.lit(" "), F.trim(_clause(s, a, z)), F.lit(" ")).alias(n)
                        for n, (a, z) in starts.items()])
    spaced = {n: F.replace(F.col(n), F.lit(" "), F.lit("  ")) for n in starts}
    conds = F.concat(spaced["_frm"], spaced["_whr"], spaced["_hav"])
    tested = F.concat(spaced["_whr"], spaced["_hav"])
    listed = F.concat(spaced["_sel"], spaced["_grp"], spaced["_ord"])

    def has(n: str) -> Column:
        return F.length(F.trim(F.col(n))) > 0

    out = d.select(
        "*",
        has("_whr").cast("bigint").alias("n_where"), has("_grp").cast("bigint").alias("n_group"),
        has("_ord").cast("bigint").alias("n_order"),
        F.contains(s, F.lit(" limit ")).cast("bigint").alias("n_limit"),
        (_n_tok(spaced["_frm"], "join") + _commas(F.col("_frm"))).alias("n_join"),
        _n_tok(conds, "or").alias("n_or"), _n_tok(conds, "like").alias("n_like"),
        _n_tok(tested, "subquery").alias("n_nested"), F.col("_o.setop").alias("n_setop"),
        (sum((_n_sub(listed, f" {w}  (") for w in AGG_FUNCS[1:]), _n_sub(listed, f" {AGG_FUNCS[0]}  ("))
         + _n_tok(tested, "not")).alias("n_agg"),
        _n_tok(_spaced(F.col("_tk")), "select").alias("n_select"),
        (_commas(F.col("_sel")) + 1).alias("n_select_cols"),
        F.when(has("_whr"), _n_tok(spaced["_whr"], "and") + _n_tok(spaced["_whr"], "or") + 1
               - _n_tok(spaced["_whr"], "between")).otherwise(0).cast("bigint").alias("n_where_conds"),
        F.when(has("_grp"), _commas(F.col("_grp")) + 1).otherwise(0).cast("bigint").alias("n_group_cols"),
    )
    return out.drop("_tk", "_o", "_s", *starts)


def complexity(shape: DataFrame) -> DataFrame:
    """H1-H4: component counts and the four-level label over :func:`sql_shape` output."""
    c1 = ((F.col("n_where") > 0).cast("int") + (F.col("n_group") > 0).cast("int")
          + (F.col("n_order") > 0).cast("int") + (F.col("n_limit") > 0).cast("int")
          + F.col("n_join") + F.col("n_or") + F.col("n_like")).cast("bigint")
    c2 = (F.col("n_nested") + F.col("n_setop")).cast("bigint")
    oth = ((F.col("n_agg") > 1).cast("int") + (F.col("n_select_cols") > 1).cast("int")
           + (F.col("n_where_conds") > 1).cast("int") + (F.col("n_group_cols") > 1).cast("int")).cast("bigint")
    # fixed rule: the four levels of the published difficulty definition
    d = shape.withColumn("comp1", c1).withColumn("comp2", c2).withColumn("others", oth)
    a, b, o = F.col("comp1"), F.col("comp2"), F.col("others")
    label = (F.when((a <= 1) & (o == 0) & (b == 0), "easy")
              .when(((o <= 2) & (a <= 1) & (b == 0)) | ((a <= 2) & (o < 2) & (b == 0)), "medium")
              .when(((o > 2) & (a <= 2) & (b == 0)) | ((a > 2) & (a <= 3) & (o <= 2) & (b == 0))
                    | ((a <= 1) & (o == 0) & (b <= 1)), "hard")
              .otherwise("extra"))
    return d.withColumn("hardness", label)

