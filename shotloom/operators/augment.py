"""Graph augmentation over node/edge tables (A2-A11), hash-seeded and set-at-a-time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotloom.functions import hashing
from shotloom.functions.constants import CRITICAL_KEYWORDS, KEYWORD_REPLACEMENTS, MASK_TOKEN
from shotloom.operators.common import dense_index, join_small_side, stored, top_k

# Default operator weights of the augmenter.
OPERATOR_WEIGHTS = {
    "feature_masking": 0.7,
    "value_replacement": 0.3,
    "keyword_replacement": 0.3,
    "predicate_modification": 0.3,
    "join_node_removal": 0.2,
    "table_column_replacement": 0.2,
}


def sample_augmenters(graphs: DataFrame, n: int, seed: int, weights: dict[str, float] | None = None,
                      qid: str = "qid") -> DataFrame:
    """A2 (X26 fixed: weights are used): n distinct operators per graph, weighted, without replacement.

    Efraimidis-Spirakis: the n smallest keys ``-ln(u) / w`` with ``u = uniform(seed, qid, op)``.
    """
    w = weights or OPERATOR_WEIGHTS
    if n > len(w):
        raise ValueError("cannot sample more operators than exist")
    ops = F.array(*[F.struct(F.lit(k).alias("op"), F.lit(float(v)).alias("w")) for k, v in w.items()])
    g = graphs.select(qid).distinct().select(qid, F.explode(ops).alias("o"))
    g = g.select(qid, F.col("o.op").alias("op"),
                 F.round(-F.log(hashing.uniform(seed, F.col(qid), F.col("o.op"))) / F.col("o.w"), 9).alias("key"))
    return top_k(g, [qid], [F.col("key").asc(), F.col("op").asc()], n, rank_col="pick").select(qid, "op", "pick")


def node_text(node_id: Column, aug_text: Column | None = None) -> Column:
    """Masked text if present; keyword labels lose their counter; '_' becomes a space."""
    ident = F.coalesce(aug_text, node_id) if aug_text is not None else node_id
    kw = ident.startswith("SQL_KEYWORD")
    no_counter = F.regexp_replace(ident, "_[0-9]+$", "")
    return F.when(kw, F.regexp_replace(no_counter, "_", " ")).otherwise(F.regexp_replace(ident, "_", " "))


def mask_nodes(nodes: DataFrame, prob: float, seed: int) -> DataFrame:
    """A5: mask nodes with probability ``prob``; ROOT and critical keywords are never masked."""
    critical = (F.col("type") == "SQL_KEYWORD") & F.upper(F.col("val")).isin(*CRITICAL_KEYWORDS)
    u = hashing.uniform(seed, "mask", F.col("qid"), F.col("node_id"))
    masked = (F.col("type") != "ROOT") & ~critical & (u < prob)
    return nodes.withColumn("aug_text", F.when(masked, F.lit(MASK_TOKEN)))


def per_graph(rows: DataFrame, name: str, *cols: str) -> DataFrame:
    """``(qid, <name>)``: the rows of every graph as one array of structs, bounded by the text of its query.

    Joined on ``qid`` alone it replaces joins on (qid, id): rows are spread by qid once
    and stay there, however many of their ids are looked up.
    """
    return rows.groupBy("qid").agg(F.collect_list(F.struct(*cols)).alias(name))


def relabel(rows: DataFrame, names: DataFrame, *ids: str, **also: str) -> DataFrame:
    """``rows`` with the ids of the columns ``ids`` renamed by ``names`` (qid, old_id, new_id): a left join for each of them.

    ``also`` names columns that take a further column of ``names`` where the last id is renamed.
    """
    more = list(also.values())
    out = rows.join(per_graph(names, "_names", "old_id", "new_id", *more), "qid", "left")
    for c in ids:
        hits = F.filter("_names", lambda n: n["old_id"] == F.col(c))
        out = out.withColumn("_new", F.explode_outer(hits)).withColumn(c, F.coalesce("_new.new_id", c))
    for c, new in also.items():
        out = out.withColumn(c, F.coalesce(f"_new.{new}", c))
    return out.select(*rows.columns)


def replace_keywords(nodes: DataFrame, edges: DataFrame, prob: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Each keyword node with a replacement list is replaced with probability ``prob``.

    The new keyword is a hash-chosen alternative; its label takes the next free
    index of that keyword in the graph (existing maximum + position among the
    graph's new nodes of the same keyword, by old label). Edges are relabelled.
    """
    kws = F.create_map(*[x for k, v in KEYWORD_REPLACEMENTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    from pyspark.sql import Window
    word, idx = F.upper(F.col("val")), F.regexp_extract(F.col("node_id"), r"_([0-9]+)$", 1).try_cast("bigint")
    kw = nodes.filter(F.col("type") == "SQL_KEYWORD")
    # what a graph has of each keyword, beside each of its keyword nodes: all windows are within a graph
    kw = kw.withColumn("used", F.collect_list(F.struct(word.alias("kw"), idx.alias("idx"))).over(Window.partitionBy("qid")))
    kw = kw.withColumn("alts", kws[word])
    chosen = kw.filter(F.col("alts").isNotNull()
                       & (hashing.uniform(seed, "kw", F.col("qid"), F.col("node_id")) <= prob))
    chosen = chosen.withColumn("new_kw", F.element_at(
        "alts", (F.floor(hashing.uniform(seed, "kwc", F.col("qid"), F.col("node_id")) * F.size("alts")) + 1).cast("int")))
    chosen = chosen.select("qid", "node_id", "new_kw", F.array_max(F.transform(
        F.filter("used", lambda u: u["kw"] == F.col("new_kw")), lambda u: u["idx"])).alias("max_idx"))
    w = Window.partitionBy("qid", "new_kw").orderBy("node_id")
    names = chosen.select("qid", F.col("node_id").alias("old_id"), F.concat(
        F.lit("SQL_KEYWORD_"), F.col("new_kw"), F.lit("_"),
        (F.coalesce(F.col("max_idx"), F.lit(-1)) + F.row_number().over(w)).cast("string")).alias("new_id"), "new_kw")
    n2 = relabel(nodes.select("qid", "node_id", "val", "type"), names, "node_id", val="new_kw")
    return n2, relabel(edges.select("qid", "src", "dst", "label"), names, "src", "dst")


def _reach(front: str, edges: str) -> Column:
    """The ids that the array ``front`` reaches along the array ``edges`` of (src, dst), itself included.

    A step follows all edges from the ids reached last; there are no more steps than
    edges, and those after the last new id do nothing.
    """
    return F.expr(f"""aggregate({edges}, named_struct('front', {front}, 'seen', {front}),
        (a, _) -> CASE WHEN size(a.front) = 0 THEN a ELSE transform(
            array(array_except(transform(filter({edges}, e -> array_contains(a.front, e.src)), e -> e.dst), a.seen)),
            f -> named_struct('front', f, 'seen', concat(a.seen, f)))[0] END,
        a -> a.seen)""")


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(qid, node) reachable from ``roots`` (qid, node) along ``edges`` (qid, src, dst), without a depth limit.

    A graph is bounded by its query's text, so its edges meet in one row and are
    followed there: the edges are spread by qid once, whatever the depth.
    """
    front = roots.groupBy("qid").agg(F.collect_set("node").alias("front"))
    own = front.join(per_graph(edges, "es", "src", "dst"), "qid", "left")
    own = own.withColumn("es", F.coalesce("es", F.expr("CAST(array() AS array<struct<src:string,dst:string>>)")))
    return own.select("qid", F.explode(_reach("front", "es")).alias("node"))


def by_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(qid, ns, es)``: every graph as one row, with the arrays of its nodes and of its edges; both meet in one shuffle."""
    def tagged(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("qid", F.struct(*[c for c in rows.columns if c != "qid"]).alias(name))

    both = tagged(nodes, "n").unionByName(tagged(edges, "e"), allowMissingColumns=True)
    return both.groupBy("qid").agg(F.collect_list("n").alias("ns"), F.collect_list("e").alias("es"))


def subgraph_delete(nodes: DataFrame, edges: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A9 (X21 fixed): delete target nodes (qid, node_id) and what only they reach.

    A node survives when ROOT still reaches it with the edges into the target
    removed, so nodes shared with the rest of the graph keep their descendants.
    Only graphs with a target are searched; the others pass unchanged. Nodes and
    edges are spread by qid once, and a graph is searched in its row.
    """
    gone = targets.groupBy("qid").agg(F.collect_set("node_id").alias("gone"))
    g = by_graph(nodes, edges).join(gone, "qid", "left")
    g = g.withColumn("es", F.expr("CASE WHEN gone IS NULL THEN es ELSE filter(es, e -> NOT array_contains(gone, e.dst)) END"))
    g = g.withColumn("roots", F.expr("array_distinct(transform(filter(ns, n -> n.type = 'ROOT'), n -> n.node_id))"))
    g = g.withColumn("alive", F.when(F.col("gone").isNotNull(), _reach("roots", "es")))
    kept = g.select("qid", F.expr("CASE WHEN alive IS NULL THEN ns ELSE filter(ns, n -> array_contains(alive, n.node_id)) END").alias("ns"),
                    F.expr("CASE WHEN alive IS NULL THEN es ELSE filter(es, e -> array_contains(alive, e.src) "
                           "AND array_contains(alive, e.dst)) END").alias("es"))
    # an outer explode: a plain one would filter on the arrays' sizes and search every graph twice
    return tuple(kept.select("qid", F.explode_outer(c).alias("x")).filter("x IS NOT NULL").select("qid", "x.*") for c in ("ns", "es"))


class Graph:
    """One graph's lists as the per-graph steps see them: ``nodes`` (node_id, val, type) and ``edges`` (src, dst, label) by place.

    ``kept`` and ``links`` are the places left of them; edges may be added at the end.
    """

    def __init__(self, qid: str, seed: int, nodes: list[tuple], edges: list[tuple]):
        self.qid, self.seed, self.nodes, self.edges = qid, seed, nodes, edges
        self.kept, self.links = list(range(len(nodes))), list(range(len(edges)))

    def uniform(self, *parts: str) -> float:
        """:func:`hashing.uniform` of the seed and ``parts``."""
        key = "|".join(str(p) for p in (self.seed, *parts) if p is not None)
        return (int(hashlib.md5(key.encode()).hexdigest()[:8], 16) + 0.5) / 4294967296.0

    def first(self, ids, tag: str):
        return min(ids, key=lambda x: (self.uniform(tag, self.qid, x), x), default=None)

    def words(self, *words: str, upper: bool = True) -> set:
        rows = (self.nodes[i] for i in self.kept)
        return {i for i, v, t in rows if t == "SQL_KEYWORD" and v is not None and (v.upper() if upper else v) in words}

    def reach(self, front) -> set:
        out: dict = {}
        for i in self.links:
            out.setdefault(self.edges[i][0], []).append(self.edges[i][1])
        seen, todo = set(front), list(front)
        while todo:
            for x in out.get(todo.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return seen

    def delete(self, target) -> None:
        """As :func:`subgraph_delete` of one node."""
        self.links = [i for i in self.links if self.edges[i][1] != target]
        alive = self.reach({self.nodes[i][0] for i in self.kept if self.nodes[i][2] == "ROOT"})
        self.kept = [i for i in self.kept if self.nodes[i][0] in alive]
        self.links = [i for i in self.links if self.edges[i][0] in alive and self.edges[i][1] in alive]

    def drop(self, word: str, prob: float) -> None:
        """As :func:`subgraph_delete` of the :func:`predicate_targets` of one word."""
        target = self.first(self.words(word, upper=False), "predpick")
        if target is not None and self.uniform("pred", self.qid, word) < prob:
            self.delete(target)

    def simplify(self, prob: float) -> None:
        """A10, see :func:`simplify_conditions`."""
        joints = self.words("AND", "OR")
        where = self.first(self.words("WHERE"), "simwhere") if joints and self.uniform("simplify", self.qid) < prob else None
        chosen = self.first(self.reach([where]) & joints, "simnode") if where is not None else None
        if chosen is None:
            return
        above = [self.edges[i] for i in self.links if self.edges[i][1] == chosen]
        below = {self.edges[i][1] for i in self.links if self.edges[i][0] == chosen}
        if len({src for src, _, _ in above}) != 1 or len(below) != 2:
            return
        keep = min(below, key=lambda x: (x not in joints, self.uniform("simkeep", self.qid, x), x))
        have = {self.edges[i] for i in self.links}
        for moved in dict.fromkeys((src, keep, label) for src, _, label in above):
            if moved not in have:
                self.links.append(len(self.edges))
                self.edges.append(moved)
        self.delete(chosen)


def _edit(part: pa.RecordBatch, seed: int, steps: list[tuple]) -> pa.RecordBatch:
    """A batch of graphs ``(qid, name, ns, es)`` after ``steps`` (method of :class:`Graph`, arguments) on each of them."""
    flat, ends, rows = {}, {}, {}
    for c, fields in (("ns", ("node_id", "val", "type")), ("es", ("src", "dst", "label"))):
        lists = part.column(c)
        flat[c] = lists.flatten()
        ends[c] = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
        rows[c] = list(zip(*[pc.struct_field(flat[c], f).to_pylist() for f in fields], strict=True))
    names = part.column("name").to_pylist()
    places, starts, added = {"ns": [], "es": []}, {"ns": [0], "es": [0]}, []
    n_edges = len(rows["es"])
    for i, name in enumerate(names):
        n0, n1, e0, e1 = *ends["ns"][i:i + 2].tolist(), *ends["es"][i:i + 2].tolist()
        kept, links = range(n0, n1), range(e0, e1)
        # a graph without qid meets no target
        if name is not None:
            g = Graph(name, seed, rows["ns"][n0:n1], rows["es"][e0:e1])
            for step, *args in steps:
                getattr(g, step)(*args)
            kept = [n0 + k for k in g.kept]
            links = [e0 + k if k < e1 - e0 else n_edges + len(added) + k - (e1 - e0) for k in g.links]
            added.extend(g.edges[e1 - e0:])
        for c, left in (("ns", kept), ("es", links)):
            places[c].extend(left)
            starts[c].append(len(places[c]))
    more = pa.StructArray.from_arrays([pa.array(x, pa.string()) for x in (zip(*added, strict=True) if added else ((),) * 3)],
                                      ["src", "dst", "label"])
    flat["es"] = pa.concat_arrays([flat["es"], more.cast(flat["es"].type)])
    made = [pa.ListArray.from_arrays(pa.array(starts[c], pa.int32()), flat[c].take(pa.array(places[c], pa.int64()))) for c in ("ns", "es")]
    return pa.RecordBatch.from_arrays([part.column("qid"), *made], ["qid", "ns", "es"])


def edit_graphs(nodes: DataFrame, edges: DataFrame, seed: int, steps: list[tuple]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after ``steps`` on every graph: both are spread by qid once, edited in the graph's row and written once."""
    g = by_graph(nodes, edges.select("qid", "src", "dst", "label"))
    g = g.select("qid", F.col("qid").cast("string").alias("name"), "ns", F.array_distinct("es").alias("es"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                yield _edit(b.slice(at, 1024), seed, steps)

    done = stored(g.mapInArrow(run, g.drop("name").schema), "edited")
    return tuple(done.select("qid", F.explode(c).alias("x")).select("qid", "x.*") for c in ("ns", "es"))


def simplify_conditions(nodes: DataFrame, edges: DataFrame, seed: int, prob: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """A10: with probability ``prob`` a graph loses one hash-chosen AND or OR under a hash-chosen WHERE.

    The connective must have one parent and two operands. An operand that is itself
    AND or OR is kept, else a hash-chosen one; it takes the connective's place under
    the parent (and its edge label), and the rest goes as in :func:`subgraph_delete`.
    """
    return edit_graphs(nodes, edges, seed, [("simplify", prob)])


def predicate_modification(nodes: DataFrame, edges: DataFrame, seed: int, drop_where: float = 0.3, simplify: float = 0.5,
                           drop_having: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Drop one WHERE, simplify one AND / OR, drop one HAVING, each with its probability, one after the other."""
    return edit_graphs(nodes, edges, seed, [("drop", "WHERE", drop_where), ("simplify", simplify), ("drop", "HAVING", drop_having)])


def graph_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and edges as one table ``(qid, part, src, dst, label)``: a node's type is its label."""
    n = nodes.select("qid", F.lit("node").alias("part"), F.col("node_id").alias("src"),
                     F.lit(None).cast("string").alias("dst"), F.col("type").alias("label"))
    return n.unionByName(edges.select("qid", F.lit("edge").alias("part"), "src", "dst", "label"))


def predicate_targets(nodes: DataFrame, seed: int, drop_where: float = 0.3, drop_having: float = 0.2,
                      words: tuple[str, ...] = ("WHERE", "HAVING")) -> DataFrame:
    """A11 (drop parts): one hash-chosen WHERE with probability ``drop_where``, one HAVING with ``drop_having``."""
    own = nodes.filter((F.col("type") == "SQL_KEYWORD") & F.col("val").isin(*words))
    own = own.withColumn("key", hashing.uniform(seed, "predpick", F.col("qid"), F.col("node_id")))
    first = top_k(own, ["qid", "val"], [F.col("key").asc(), F.col("node_id").asc()], 1)
    gate = F.when(F.col("val") == "WHERE", drop_where).otherwise(drop_having)
    return first.filter(hashing.uniform(seed, "pred", F.col("qid"), F.col("val")) < gate).select("qid", "node_id")


def join_targets(nodes: DataFrame, edges: DataFrame, seed: int, prob: float = 0.8) -> DataFrame:
    """When a SELECT owns at least two JOINs, drop one hash-chosen JOIN with probability ``prob``."""
    joins = (edges.filter(F.col("dst").startswith("SQL_KEYWORD_JOIN_"))
                  .select("qid", F.col("src").alias("sel"), F.col("dst").alias("node_id")))
    from pyspark.sql import Window
    w = Window.partitionBy("qid", "sel")
    joins = joins.withColumn("n", F.count("*").over(w)).filter(F.col("n") >= 2)
    joins = joins.withColumn("key", hashing.uniform(seed, "join", F.col("qid"), F.col("node_id")))
    first = top_k(joins, ["qid", "sel"], [F.col("key").asc(), F.col("node_id").asc()], 1)
    gate = hashing.uniform(seed, "joingate", F.col("qid"), F.col("sel")) < prob
    return first.filter(gate).select("qid", "node_id")




def toggle_not(nodes: DataFrame, edges: DataFrame, prob: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Toggle NOT above chosen IN / LIKE nodes (chosen with probability ``prob``).

    A chosen node under a NOT node loses that NOT (its parent adopts the node);
    otherwise a new ``SQL_KEYWORD_NOT_<next>`` node is inserted between the node
    and each of its parents.
    """
    from pyspark.sql import Window
    word = F.upper(F.col("val"))
    idx = F.regexp_extract(F.col("node_id"), r"_([0-9]+)$", 1).try_cast("bigint")
    picked = word.isin("IN", "LIKE") & (hashing.uniform(seed, "not", F.col("qid"), F.col("node_id")) <= prob)
    # each graph's chosen nodes and NOT nodes go to its edges; whatever follows is within a graph
    own = (nodes.filter(word.isin("IN", "LIKE", "NOT")).groupBy("qid")
           .agg(F.collect_list(F.when(picked, F.col("node_id"))).alias("chosen"),
                F.collect_list(F.when(word == "NOT", F.col("node_id"))).alias("nots"),
                F.max(F.when(word == "NOT", idx)).alias("max_not")))
    e = edges.select("qid", "src", "dst", "label").join(own, "qid", "left")
    parents = F.filter("chosen", lambda x: x == F.col("dst"))
    e = e.withColumn("times", F.coalesce(F.size(parents), F.lit(0)))
    e = e.withColumn("times", F.greatest("times", F.lit(0)))
    e = e.withColumn("under", F.coalesce(F.array_contains("nots", F.col("src")), F.lit(False)) & (F.col("times") > 0))
    whole = Window.partitionBy("qid")
    # Remove: NOT -> X becomes grand-parent -> X, and the NOT node goes away.
    e = e.withColumn("dropped", F.collect_set(F.when(F.col("under"), F.struct(F.col("src").alias("not_id"), F.col("dst").alias("x")))).over(whole))
    # Add: P -> X becomes P -> NOT_new -> X.
    e = e.withColumn("adds", (F.col("times") > 0) & ~F.col("under") & F.col("qid").isNotNull())
    before = whole.orderBy("dst", "src", "label").rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("first", F.coalesce(F.col("max_not"), F.lit(-1)) + F.coalesce(
        F.sum(F.when(F.col("adds"), F.col("times")).otherwise(0)).over(before), F.lit(0)))
    edge = "named_struct('src', {}, 'dst', {}, 'label', {})"
    new = "concat('SQL_KEYWORD_NOT_', CAST(first + k AS STRING))"
    out = f"""concat(
        CASE WHEN adds OR exists(dropped, d -> d.not_id = src OR d.not_id = dst) THEN array() ELSE array({edge.format("src", "dst", "label")}) END,
        transform(filter(dropped, d -> d.not_id = dst), d -> {edge.format("src", "d.x", "label")}),
        CASE WHEN adds THEN flatten(transform(sequence(1, times), k -> array(
            {edge.format("src", new, "label")}, {edge.format(new, "dst", "'this'")}))) ELSE array() END)"""
    e2 = (e.select("qid", F.explode_outer(F.expr(out)).alias("e")).filter("e IS NOT NULL").select("qid", "e.*").distinct())
    gone = e.select("qid", F.explode("dropped").alias("d")).select("qid", F.col("d.not_id").alias("node_id"))
    added = e.filter("adds").select("qid", F.explode(F.expr(f"transform(sequence(1, times), k -> {new})")).alias("node_id"),
                                    F.lit("NOT").alias("val"), F.lit("SQL_KEYWORD").alias("type")).distinct()
    n2 = nodes.join(gone, ["qid", "node_id"], "left_anti").unionByName(added)
    return n2, e2


def word_list(texts: DataFrame, text_col: str = "text", min_len: int = 3) -> DataFrame:
    """Replacement vocabulary: distinct lower-case words of ``texts`` (length >= min_len), densely numbered."""
    from shotloom.functions import text as T
    w = (texts.select(F.explode_outer(T.words(F.lower(F.col(text_col)))).alias("word"))
              .filter(F.col("word").isNotNull() & (F.length("word") >= min_len)).distinct())
    return dense_index(w, [], ["word"], out="widx")


def replace_values(nodes: DataFrame, edges: DataFrame, words: DataFrame, prob: float,
                   seed: int) -> tuple[DataFrame, DataFrame]:
    """A6 (X20 fixed: the ``VALUE_`` prefix is removed, not a character set).

    A VALUE node is replaced with probability ``prob``: an integer by a hash-drawn
    integer with the same number of digits; a LIKE pattern by the same pattern
    with every non-blank part between ``%`` replaced by a word; any other string
    by a word. Floats are kept. A new value that already exists in the graph is
    merged with it (relabel, then distinct).
    """
    n_words = words.agg(F.count("*")).scalar()
    v = nodes.filter(F.col("type") == "VALUE")
    chosen = v.filter(hashing.uniform(seed, "val", F.col("qid"), F.col("node_id")) <= prob)
    is_int = F.col("val").rlike("^[0-9]+$")
    is_float = F.col("val").rlike("^[0-9]*[.][0-9]+$")
    d = F.length("val")
    lo = F.pow(F.lit(10.0), d - 1)
    new_int = (lo + F.floor(hashing.uniform(seed, "valn", F.col("qid"), F.col("node_id")) * (lo * 9))).cast("bigint")
    # spread by graph, so that neither the values nor their graphs' names move again
    parts = chosen.filter(~is_float).repartition("qid").select(
        "qid", "node_id", is_int.alias("is_int"), new_int.cast("string").alias("new_int"), F.posexplode_outer(
            F.when(F.col("val").contains("%"), F.split(F.col("val"), "%", -1)).otherwise(F.array(F.col("val"))))
        .alias("pos", "part"))
    blank = F.length(F.trim(F.coalesce(F.col("part"), F.lit("")))) == 0
    parts = parts.withColumn("widx", F.when(~blank & ~F.col("is_int"), F.floor(
        hashing.uniform(seed, "valw", F.col("qid"), F.col("node_id"), F.col("pos")) * n_words).cast("bigint")))
    parts = join_small_side(parts, words.select("widx", "word"), ["widx"], F.col("qid"), how="left")
    parts = parts.withColumn("np", F.when(blank, F.lit("")).otherwise(F.col("word")))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "np"))), lambda x: x["np"]), "%")
    names = (parts.groupBy("qid", "node_id")
                  .agg(F.when(F.first("is_int"), F.first("new_int")).otherwise(joined).alias("new_val"))
                  .select("qid", F.col("node_id").alias("old_id"), "new_val", F.concat(F.lit("VALUE_"), F.col("new_val")).alias("new_id")))
    n2 = relabel(nodes.select("qid", "node_id", "val", "type"), names, "node_id", val="new_val").distinct()
    return n2, relabel(edges.select("qid", "src", "dst", "label"), names, "src", "dst").distinct()


def choose_databases(tables: DataFrame, aug_cols: DataFrame, seed: int) -> DataFrame:
    """``(qid, db2)``: for every graph a seeded database with at least as many tables as the graph.

    ``tables`` holds (qid, t). Databases are ranked by table count, largest first, so the
    eligible ones are the first E of that order, and E is looked up by the graph's count;
    the pick is the rank floor(u * E). Graphs that no database fits have no row.
    """
    sizes = stored(aug_cols.groupBy("db_id").agg(F.count_distinct("table_name").alias("n")), "catalog-sizes")
    ranked = dense_index(sizes.withColumn("minus", -F.col("n")), [], ["minus", "db_id"], out="p").select("p", F.col("db_id").alias("db2"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    # one row for each table count that occurs among the databases or below: how many have at least that many
    eligible = (sizes.select(F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("m")).groupBy("m").agg(F.count("*").alias("e")))
    own = tables.groupBy("qid").agg(F.count_distinct("t").alias("m")).filter(F.col("m") <= most)
    picked = join_small_side(own, eligible, ["m"], F.col("qid")).withColumn(
        "p", F.floor(hashing.uniform(seed, "db", F.col("qid")) * F.col("e")).cast("bigint"))
    return join_small_side(picked, ranked, ["p"], F.col("qid")).select("qid", "db2")


def replace_schema(nodes: DataFrame, edges: DataFrame, src_cols: DataFrame, aug_cols: DataFrame,
                   seed: int) -> tuple[DataFrame, DataFrame]:
    """A13 (X19 fixed: the graph's own database types are used): table/column replacement.

    ``src_cols``: catalog columns (table_name, column_name, column_type) of the graphs'
    database; ``aug_cols``: those of all replacement databases, with db_id. Every graph
    takes one database (:func:`choose_databases`); its tables map one-to-one to
    consecutive tables of it, in a seeded order and from a seeded start. The columns of a
    table map one-to-one to columns of its new table: first within their type, then the
    rest to the columns left over, both in seeded orders; a column beyond the new table's
    own ones keeps its name there. A graph that no database fits stays as it is.
    """
    from pyspark.sql import Window
    qt = nodes.filter(F.col("type") == "TABLE").select("qid", F.col("val").alias("t")).repartition("qid").distinct()
    place = Window.partitionBy("db2").orderBy("_h", "t2")  # a catalog's tables
    aug_tables = aug_cols.select(F.col("db_id").alias("db2"), F.col("table_name").alias("t2")).distinct()
    order = (aug_tables.withColumn("_h", hashing.uniform(seed, "tbl", F.col("db2"), F.col("t2")))
             .select("db2", "t2", (F.row_number().over(place) - 1).cast("bigint").alias("p"),
                     F.count("*").over(Window.partitionBy("db2")).alias("n")))
    chosen = choose_databases(qt, aug_cols, seed)
    start = F.floor(hashing.uniform(seed, "tbloff", F.col("qid")) * F.col("n")).cast("bigint")
    nth = (F.row_number().over(Window.partitionBy("qid").orderBy("t")) - 1).cast("bigint")
    qt = qt.join(chosen, "qid").withColumn("i", nth)
    qt = join_small_side(qt, order.select("db2", "n").distinct(), ["db2"], F.col("qid")).withColumn("p", (start + F.col("i")) % F.col("n"))
    tmap = join_small_side(qt, order.select("db2", "p", "t2"), ["db2", "p"], F.col("qid"))
    tables = per_graph(tmap, "tables", "t", "db2", "t2")
    cols = nodes.filter(F.col("type") == "COLUMN").select(
        "qid", "node_id", F.col("val").alias("c"),
        F.regexp_extract(F.col("node_id"), r"^COLUMN_([^.]*)\.", 1).alias("t"))
    st = src_cols.select(F.col("table_name").alias("t"), F.col("column_name").alias("c"), F.col("column_type").alias("kind"))
    cols = (join_small_side(cols, st, ["t", "c"], F.col("qid"), how="left")
            .withColumn("h", hashing.uniform(seed, "colorder", F.col("qid"), F.col("node_id"))))
    cols = cols.join(tables, "qid").withColumn("m", F.explode_outer(F.filter("tables", lambda m: m["t"] == F.col("t")))).filter("m IS NOT NULL")
    cols = (cols.groupBy("qid", "t", F.col("m.db2").alias("db2"), F.col("m.t2").alias("t2"))
            .agg(F.sort_array(F.collect_list(F.struct("h", "node_id", "c", "kind"))).alias("cols")))
    opts = per_table(aug_cols)
    cols = join_small_side(cols, opts, ["db2", "t2"], F.col("qid"))
    cols = cols.withColumn("opts", F.sort_array(F.transform("opts", lambda o: F.struct(
        hashing.uniform(seed, "col", F.col("qid"), F.col("t2"), o["c2"]).alias("h"), o["c2"].alias("c2"), o["kind"].alias("kind")))))
    # in both orders: the n-th column of a type takes the n-th of that type, then the n-th without takes the n-th left
    cols = cols.withColumn("typed", F.expr("""transform(cols, (x, i) -> get(filter(opts, o -> o.kind = x.kind),
        size(filter(slice(cols, 1, i), y -> y.kind = x.kind))).c2)"""))
    cols = cols.withColumn("free", F.expr("filter(opts, o -> NOT exists(typed, c -> c <=> o.c2))"))
    cols = cols.withColumn("c2s", F.expr("""transform(cols, (x, i) -> coalesce(typed[i],
        get(free, size(filter(slice(typed, 1, i), c -> c IS NULL))).c2, x.c))"""))
    cnames = (cols.select("qid", "t2", F.explode(F.arrays_zip("cols", "c2s")).alias("x"))
              .select("qid", F.col("x.cols.node_id").alias("old_id"),
                      F.concat(F.lit("COLUMN_"), F.col("t2"), F.lit("."), F.col("x.c2s")).alias("new_id"), F.col("x.c2s").alias("new_val")))
    all_names = tables.join(per_graph(cnames, "cnames", "old_id", "new_id", "new_val"), "qid", "left").select("qid", F.explode(F.concat(
        F.transform("tables", lambda m: F.struct(F.concat(F.lit("TABLE_"), m["t"]).alias("old_id"),
                                                 F.concat(F.lit("TABLE_"), m["t2"]).alias("new_id"), m["t2"].alias("new_val"))),
        F.coalesce("cnames", F.expr("CAST(array() AS array<struct<old_id:string,new_id:string,new_val:string>>)")))).alias("n"))
    names = all_names.select("qid", "n.*")
    n2 = relabel(nodes.select("qid", "node_id", "val", "type"), names, "node_id", val="new_val").distinct()
    return n2, relabel(edges.select("qid", "src", "dst", "label"), names, "src", "dst").distinct()


def per_table(aug_cols: DataFrame) -> DataFrame:
    """``(db2, t2, opts)``: the columns (c2, kind) of every catalog table."""
    ac = aug_cols.select(F.col("db_id").alias("db2"), F.col("table_name").alias("t2"), F.col("column_name").alias("c2"),
                         F.col("column_type").alias("kind"))
    return ac.groupBy("db2", "t2").agg(F.collect_list(F.struct("c2", "kind")).alias("opts"))


def choose_augmenters(graphs: DataFrame, times: int, seed: int, weights: dict[str, float] | None = None,
                      qid: str = "qid") -> DataFrame:
    """A3: one weighted choice per graph and repetition, with replacement: (qid, op, pick).

    The choice is the bucket of the cumulative weights that ``uniform(seed, qid, pick)`` falls in.
    """
    w = weights or OPERATOR_WEIGHTS
    total, upto, op = float(sum(w.values())), 0.0, F.lit(list(w)[-1])
    bounds = []
    for name, weight in w.items():
        upto += weight / total
        bounds.append((name, upto))
    u = hashing.uniform(seed, "op", F.col(qid), F.col("pick"))
    for name, bound in reversed(bounds[:-1]):
        op = F.when(u < F.lit(bound), F.lit(name)).otherwise(op)
    return (graphs.select(qid).distinct()
            .select(qid, F.explode(F.sequence(F.lit(1), F.lit(times))).alias("pick"))
            .select(qid, op.alias("op"), F.col("pick").cast("bigint").alias("pick")))


def augment_positives(nodes: DataFrame, edges: DataFrame, assigned: DataFrame, operators: dict) -> tuple[DataFrame, DataFrame]:
    """A4: apply each graph's assigned operators in order to a copy of it.

    ``assigned`` is (qid, op, pick) as from :func:`sample_augmenters` (distinct
    operators) or :func:`choose_augmenters` (repeated choices); ``operators`` maps
    a name to a function (nodes, edges) -> (nodes, edges). At each pick the graphs
    split by operator, every operator runs once over all of its graphs, and the
    result is written before the next pick. A masked node keeps its mask
    (``aug_text``) unless a later operator renames or removes it.
    """
    assigned = stored(assigned.select("qid", "op", "pick"), "assigned")
    last = assigned.agg(F.max("pick")).first()[0] or 0
    nodes = stored(nodes.select("qid", "node_id", "val", "type", F.lit(None).cast("string").alias("aug_text")), "aug-nodes")
    edges = stored(edges.select("qid", "src", "dst", "label"), "aug-edges")
    for pick in range(1, last + 1):
        now = assigned.filter(F.col("pick") == pick)
        rest = now.filter(F.col("op").isin(*operators)).select("qid")
        all_nodes = nodes.join(rest, "qid", "left_anti")
        all_edges = edges.join(rest, "qid", "left_anti")
        for name, operator in operators.items():
            own = now.filter(F.col("op") == name).select("qid")
            masked = nodes.join(own, "qid", "left_semi")
            n2, e2 = operator(masked.drop("aug_text"), edges.join(own, "qid", "left_semi"))
            if "aug_text" in n2.columns:
                n2 = n2.withColumnRenamed("aug_text", "_new")
            else:
                n2 = n2.withColumn("_new", F.lit(None).cast("string"))
            n2 = (n2.join(masked.select("qid", "node_id", "aug_text"), ["qid", "node_id"], "left")
                    .withColumn("aug_text", F.coalesce("_new", "aug_text")))
            all_nodes = all_nodes.unionByName(n2.select("qid", "node_id", "val", "type", "aug_text"))
            all_edges = all_edges.unionByName(e2.select("qid", "src", "dst", "label"))
        nodes, edges = stored(all_nodes, "aug-nodes"), stored(all_edges, "aug-edges")
    return nodes, edges


def default_operators(seed: int, words: DataFrame, src_cols: DataFrame, aug_cols: DataFrame) -> dict:
    """The six named operators of :data:`OPERATOR_WEIGHTS` with their default probabilities."""
    def delete(targets):
        return lambda n, e: subgraph_delete(n, e, targets(n, e))

    return {
        "feature_masking": lambda n, e: (mask_nodes(n, 0.5, seed), e),
        "value_replacement": lambda n, e: replace_values(n, e, words, 0.8, seed),
        "keyword_replacement": lambda n, e: replace_keywords(n, e, 0.7, seed),
        "predicate_modification": lambda n, e: predicate_modification(n, e, seed),
        "join_node_removal": delete(lambda n, e: join_targets(n, e, seed)),
        "table_column_replacement": lambda n, e: replace_schema(n, e, src_cols, aug_cols, seed),
    }


def _hops(part: pa.RecordBatch, hops: int) -> pa.RecordBatch:
    """:func:`propagate` of a batch of graphs ``(qid, ns, es)`` by sparse sums over all their vertices at once."""
    rows, ids = [], []
    for name, ends in (("ns", ("node_id",)), ("es", ("src", "dst"))):
        lists = part.column(name)
        at = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
        for c in ends:
            rows.append(at)
            ids.append(pc.struct_field(lists.flatten(), c))
    n_nodes, n_edges = len(ids[0]), len(ids[1])
    words = pa.concat_arrays(ids).dictionary_encode()
    code = words.indices.to_numpy()
    keys, vertex = np.unique(np.concatenate(rows) * (len(words.dictionary) + 1) + code, return_inverse=True)
    own, src, dst = np.split(vertex, [n_nodes, n_nodes + n_edges])
    n = len(keys)
    # both ways and self; a pair met twice is one
    u, v = np.divmod(np.unique(np.concatenate([src * n + dst, dst * n + src, own * n + own])), max(n, 1))
    deg = np.bincount(v, minlength=n)
    w = 1 / np.sqrt(deg[u] * deg[v])
    h = np.array(pc.struct_field(part.column("ns").flatten(), "h").flatten(), float).reshape(n_nodes, -1)
    known = np.bincount(own, minlength=n) > 0
    h = np.stack([np.bincount(own, x, minlength=n) for x in h.T], axis=1)
    for _ in range(hops):
        here = known[u]
        h = np.stack([np.bincount(v[here], x[u[here]] * w[here], minlength=n) for x in h.T], axis=1)
        known = np.bincount(v[here], minlength=n) > 0
    at, word = np.divmod(keys[known], len(words.dictionary) + 1)
    values = pa.array(h[known].ravel())
    lists = pa.ListArray.from_arrays(pa.array(np.arange(known.sum() + 1) * h.shape[1], pa.int32()), values)
    return pa.RecordBatch.from_arrays([part.column("qid").take(pa.array(at)), words.dictionary.take(pa.array(word)), lists],
                                      ["qid", "node_id", "h"])


def propagate(nodes: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """(qid, node_id, h) after ``hops`` rounds of symmetric-normalised sums over both edge directions and self.

    ``nodes`` carries (qid, node_id, h) with ``h array<double>`` of one size; there are no
    weights. Nodes and edges are spread by qid once, and all hops of a graph are made there.
    """
    h = nodes.select("qid", "node_id", "h")
    if not hops:
        return h
    g = by_graph(h.filter("qid IS NOT NULL AND node_id IS NOT NULL"),
                 edges.select("qid", "src", "dst").filter("qid IS NOT NULL AND src IS NOT NULL AND dst IS NOT NULL")).filter("size(ns) > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                yield _hops(b.slice(at, 1024), hops)

    return g.mapInArrow(run, f"qid {nodes.schema['qid'].dataType.simpleString()}, node_id string, h array<double>")


def readout(h: DataFrame, dims: int, how: str = "concat") -> DataFrame:
    """One vector per graph: ``mean``, ``max`` or ``sum`` over its nodes, or the three after one another."""
    kinds = {"mean": F.avg, "max": F.max, "sum": F.sum}
    if how != "concat":
        kinds = {how: kinds[how]}
    return h.groupBy("qid").agg(*[fn(F.col("h")[i]).alias(f"{kind}{i}") for kind, fn in kinds.items() for i in range(dims)])
