"""Op 5, URL filter: a path-template tree per host, judged by smoothed labelled purity.

Fixed rules decide what they fit and label it. All other URLs go down their host's
tree: segments that vary (numbers, hashes, or many rare children of one parent)
become wildcards, sibling branches whose label shares do not differ significantly
are merged, and a template is rejected if its share of blocked pages, smoothed
towards the same template on all hosts and the corpus, reaches one half.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotloom.llm.base import stored

#: (verdict, host, path) of the fixed rules.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))
DEPTH, MANY, FEW, STRENGTH, Z = 8, 16, 4.0, 4.0, 2.0
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UP, _LOW)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


#: Fixed patterns: identifiers that vary from page to page.
UUID = "[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
HASH = "^[0-9]*[a-fA-F][0-9a-fA-F]*([.][A-Za-z]+)?$"


def lexical(segment: Column) -> Column:
    """A segment with its numbers, hashes and identifiers as wildcards; the extension stays."""
    out = F.regexp_replace(segment, UUID, "{u}")
    hashed = (F.regexp_like(out, F.lit(HASH)) & F.regexp_like(out, F.lit("[0-9]"))
              & F.regexp_like(out, F.lit("^[0-9a-fA-F]{12,}")))
    out = F.when(hashed, F.regexp_replace(out, "^[0-9a-fA-F]{12,}", "{h}")).otherwise(out)
    return F.regexp_replace(out, "[0-9]+", "{n}")


def segments(path: Column) -> Column:
    """Lexically generalised segments; what lies below DEPTH becomes one ``**``."""
    parts = F.transform(F.split(F.substr(path, F.lit(2), F.length(path)), "/"), lexical)
    return F.when(F.size(parts) > DEPTH, F.concat(F.slice(parts, 1, DEPTH), F.array(F.lit("**")))).otherwise(parts)


def _prefix(level: int) -> Column:
    return F.array_join(F.slice("segs", 1, level), "/") if level else F.lit("")


def generalise(nodes: DataFrame) -> DataFrame:
    """Replace the rare children of a parent with many of them by ``*``, level by level from the root."""
    depth = nodes.agg(F.max(F.size("segs"))).first()[0] or 0  # DEPTH + 1 at most
    for level in range(min(DEPTH, depth)):
        nodes = stored(nodes, "url-nodes")
        keyed = nodes.withColumn("pre", _prefix(level)).withColumn("seg", F.try_element_at("segs", F.lit(level + 1)))
        children = keyed.filter("seg is not null").groupBy("host", "pre", "seg").agg(F.sum("n").alias("c"))
        rare = children.filter(F.col("c") < FEW)
        wild = (rare.groupBy("host", "pre").agg(F.count("*").alias("many")).filter(F.col("many") >= MANY)
                .select("host", "pre"))
        swap = rare.join(wild, ["host", "pre"], "left_semi").select("host", "pre", "seg", F.lit(True).alias("swap"))
        head, tail = F.slice("segs", 1, level), F.slice("segs", level + 2, DEPTH + 2)
        nodes = (keyed.join(swap, ["host", "pre", "seg"], "left")
                 .withColumn("segs", F.when(F.col("swap"), F.concat(head, F.array(F.lit("*")), tail))
                             .otherwise(F.col("segs"))).drop("pre", "seg", "swap"))
    return nodes


def judge_templates(nodes: DataFrame) -> DataFrame:
    """``(host, raw, template, purity)`` for every raw template of ``nodes(host, segs, n, block, labelled)``."""
    wide = generalise(nodes.withColumn("raw", F.array_join("segs", "/")))
    wide = wide.withColumn("parent", F.array_join(F.slice("segs", 1, F.size("segs") - 1), "/")) \
        .withColumn("leaf", F.element_at("segs", -1))
    wide = stored(wide, "url-tree")
    leaf = wide.groupBy("host", "parent", "leaf").agg(F.sum("block").alias("k"), F.sum("labelled").alias("m"))
    pool = leaf.groupBy("host", "parent").agg(F.sum("k").alias("pk"), F.sum("m").alias("pm"))
    share = (F.col("pk") + 0.5) / (F.col("pm") + 1)
    z = (F.col("k") - F.col("m") * share) / F.sqrt(F.greatest(F.col("m"), F.lit(1)) * share * (1 - share))
    # siblings whose labels agree with all of their parent's are one branch
    branch = (leaf.join(pool, ["host", "parent"])
              .withColumn("branch", F.when(F.abs(z) < Z, F.lit("+")).otherwise(F.col("leaf"))))
    merged = branch.groupBy("host", "parent", "branch").agg(F.sum("k").alias("k"), F.sum("m").alias("m"))
    everywhere = merged.groupBy("parent").agg(F.sum("k").alias("gk"), F.sum("m").alias("gm"))
    total = nodes.agg(F.sum("block").alias("k"), F.sum("labelled").alias("m")).first()
    prior = F.lit(((total.k or 0) + 0.5) / ((total.m or 0) + 1))
    same = (F.col("gk") + STRENGTH * prior) / (F.col("gm") + STRENGTH)
    purity = (F.col("k") + STRENGTH * F.col("same")) / (F.col("m") + STRENGTH)
    judged = (merged.join(everywhere, "parent").withColumn("same", same)
              .select("host", "parent", "branch", purity.alias("purity")))
    return (wide.select("host", "raw", "parent", "leaf").distinct()
            .join(branch.select("host", "parent", "leaf", "branch"), ["host", "parent", "leaf"])
            .join(judged, ["host", "parent", "branch"])
            .groupBy("host", "raw").agg(F.max(F.struct("purity", F.concat_ws("/", "parent", "branch").alias("t"))).alias("b"))
            .select("host", "raw", F.col("b.t").alias("template"), F.col("b.purity").alias("purity")))


def judge_urls(pages: DataFrame) -> DataFrame:
    """Per page ``page_id, host, path, rule, verdict, template, purity``.

    Null URLs and those without ``://`` have an empty host and path and are judged as
    the empty template of the empty host. Repeated rows are judged alike.
    """
    host, path = host_and_path(F.col("url"))
    rows = (pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
            .withColumn("fit", fitting_rule(F.col("host"), F.col("path"))).withColumn("segs", segments(F.col("path")))
            .withColumn("raw", F.array_join("segs", "/")))
    verdict = F.col("fit.verdict")
    nodes = stored(rows.groupBy("host", "segs").agg(
        F.count("*").alias("n"), F.count_if(verdict == "block").alias("block"),
        F.count(verdict).alias("labelled")), "url-nodes")
    judged = judge_templates(nodes)
    return (rows.join(judged, ["host", "raw"], "left")
            .select("page_id", "host", "path", F.col("fit.rule").alias("rule"),
                    F.coalesce(verdict, F.when(F.col("purity") >= 0.5, "block").otherwise("allow")).alias("verdict"),
                    "template", "purity"))
