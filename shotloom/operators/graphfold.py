"""The labelled graph of one query's text, built in a few passes over its tokens (see :mod:`sqlgraph` for its definition).

What the token statement of :mod:`sqlgraph` says with windows within a query is said here token by token: a
partition of texts is lexed and folded in Arrow batches, so no token is ever a row that is sorted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import itemgetter

import pyarrow as pa

# Fixed pattern: :data:`sqlgraph.LEX_RE` with the white space of the engines' expressions spelt out.
_LEX = re.compile(r"'[^']*'|[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)?|[0-9]+(?:\.[0-9]+)?|>=|<=|!=|<>"
                  r"|[^ \t\n\x0b\f\rA-Za-z0-9_]").findall

# Fixed words, as in sqlgraph.token_ctes.
LEAF = 1000000
_PARTS = frozenset(("select", "from", "join", "on", "where", "group", "having", "order", "limit", "union", "except", "intersect"))
_PLAIN = frozenset(("from", "by", "as", "on", "asc", "desc", "is", "null", "exists", "left", "right", "inner", "outer", "full",
                    "cross", "natural", "using", "case", "when", "then", "else", "end", "all"))
_NO_OPERAND = _PLAIN | {"select", "where", "having", "limit", "offset", "distinct", "and", "or", "not", "in", "between", "like",
                        "=", "!=", "<>", ">", ">=", "<", "<=", "+", "-", "*", "/", "(", ",", "."}
_PAREN_AFTER = _NO_OPERAND - {"in", "from", "using", "exists", "all"}
_SETOPS = frozenset(("except", "intersect", "union"))
_CLAUSES = frozenset(("select", "where", "having", "limit", "offset", "join", "distinct"))
_AGGS = frozenset(("count", "sum", "avg", "min", "max"))
_OPS = {"and": "AND", "or": "OR", "not": "NOT", "in": "IN", "between": "BETWEEN", "like": "LIKE", "=": "EQ", "!=": "NEQ",
        "<>": "NEQ", ">": "GT", ">=": "GTE", "<": "LT", "<=": "LTE", "+": "ADD", "-": "SUB", "/": "DIV"}
_BARS = frozenset((",", "on", "as", "from", "by", "asc", "desc", "case", "when", "then", "else", "end", "using"))
_BINDS = {"OR": 1, "AND": 2, "ADD": 6, "SUB": 6, "MUL": 7, "DIV": 7, "NEG": 8}
_NEGATED = ("in", "like", "between")
_END = (1 << 60, -1, "clause", None, None, None, None)


def _side(p: tuple, k: tuple) -> str:
    """Label of the edge from parent entry ``p`` to child ``k``."""
    if k[3] == "sub":
        return "query"
    if k[3] == "column" or p[3] == "clause" or p[3] == "setop":
        return "expressions"
    if p[4] == "IN" and k[1] > p[1]:
        return "expressions"
    return "this" if p[3] in ("agg", "paren") or p[4] in ("NOT", "NEG") or k[1] < p[1] else "expression"


def fold(items: list[tuple], out: list[tuple]) -> None:
    """Adds the tree edges (src, dst, label) of one SELECT's items (pos, prec, take, label, kind, kw, neg), by a stack of open operators.

    A new token closes the open ones that bind at least as firmly; each of these is a
    child of the one below it, and the lowest is the left operand of the new token, if
    it takes one. Bars (commas and the like) are entries without a node: they pass
    their operands on. An entry is (prec, pos, label, kind, kw, kids).
    """
    stack: list[tuple] = []
    for pos, prec, take, label, kind, kw, neg in (*items, _END):
        cut = 0 if take == "clause" else prec if take == "binary" or take == "bar" else LEAF
        carry: list[tuple] = []
        if stack and (stack[-1][0] >= cut or any(s[0] >= cut for s in stack)):
            kept = []
            popped = []
            for s in stack:
                (kept if s[0] < cut else popped).append(s)
            # taken off the stack, the top first, each handing itself to the next
            for s in reversed(popped):
                if s[2] is None:
                    carry = [*s[5], *carry]
                else:
                    for k in carry:
                        out.append((s[2], k[2], _side(s, k)))
                    carry = [s]
        else:
            kept = stack
        entry = (prec, pos, label, kind, kw, ())
        if take == "binary":
            for k in carry:
                out.append((label, k[2], _side(entry, k)))
            if neg is not None:
                kept.append((prec - 1, pos - 1, neg, "op", "NOT", ()))
            kept.append(entry)
        elif take == "bar":
            kept.append((prec, pos, None, kind, kw, carry))
        else:
            # operands that the new token does not take go to the entry below, through it if it is a bar
            if kept and carry:
                below = kept[-1]
                if below[2] is None:
                    kept[-1] = (*below[:5], [*below[5], *carry])
                else:
                    for k in carry:
                        out.append((below[2], k[2], _side(below, k)))
            if take == "clause":
                kept = [entry]
            else:
                kept.append(entry)
        stack = kept


def graph_of(texts: list[str], holders: dict[str, set[str]], known: bool = True, edges: bool = True) -> tuple[dict, dict]:
    """The distinct nodes (node_id, val, type) and edges (src, dst, label) of a query, in the order they are met.

    ``texts`` holds one cleaned text; those of rows that share a qid are read as one, token by
    token at each place. ``holders`` maps a column's name to the tables that have it, in lower
    case. Without a qid (not ``known``) there are no enclosing names.
    """
    if len(texts) == 1:
        toks = _LEX(texts[0])
        places = range(1, len(toks) + 1)
    else:
        both = sorted(((i, t) for q in texts for i, t in enumerate(_LEX(q), 1)), key=itemgetter(0))
        toks, places = [t for _, t in both], [i for i, _ in both]
    n = len(toks)
    if not n:
        return {}, {}
    low = [t.lower() for t in toks]
    nodes, links = {("ROOT", "ROOT", "ROOT"): None}, []
    numbers: dict[str, int] = {}
    conn: dict[int, str] = {}  # the last connective of a parenthesis level
    opened: dict[int, bool] = {}  # whether the last parenthesis of a level holds a query
    selects: dict[int, tuple] = {}  # (place, label) of the last SELECT of a depth
    select_level: dict[int, int] = {}
    froms: dict[int, list] = {}  # tables of a scope
    named: dict[tuple, list] = {}  # names of a depth's scope
    aliases: dict[str, str] = {}
    begins, tops, top_setop = [], [], None
    rows = []
    part = prv = last_any = label = None
    level = depth = 0
    low.append(None)
    for i in range(n):
        tok, lt, pos, nxt, before, prv_label = toks[i], low[i], places[i], low[i + 1], depth, label
        here = level
        kw = label = None
        if lt == "(":
            level += 1
            opened[level] = opens = nxt == "select"
            if opens:
                kind, kw = "sub", "SUBQUERY"
                depth += 1
            elif prv in _PAREN_AFTER:
                kind, kw = "paren", "PAREN"
            else:
                kind = "punct"
        elif lt == ")":
            if opened.get(level):
                depth -= 1
            level -= 1
            here, before, kind = level, depth, "punct"
        elif lt in _OPS:
            kind, kw = "op", _OPS[lt]
            if lt == "and":
                if conn.get(level) == "between":
                    kind, kw = "kw", None
            elif lt == "-" and (prv is None or prv in _NO_OPERAND):
                kw = "NEG"
        elif lt in _SETOPS:
            kind, kw = "setop", lt.upper()
        elif lt in _CLAUSES or nxt == "by" and (lt == "group" or lt == "order"):
            kind, kw = "clause", lt.upper()
        elif lt in _AGGS and nxt == "(":
            kind, kw = "agg", lt.upper()
        elif lt == "*":
            if prv is not None and prv not in _NO_OPERAND:
                kind, kw = "op", "MUL"
            else:
                kind = "star"
        elif lt in _PLAIN:
            kind = "kw"
        else:
            first = tok[0]
            if first == "'" or "0" <= first <= "9":
                kind, kw = "literal", "LITERAL"
            elif "a" <= first.lower() <= "z" or first == "_":
                if nxt == "(":
                    kind = "func"
                elif prv == "from" or prv == "join" or prv == "," and (part == "from" or part == "join"):
                    kind = "table"
                elif prv == "as" or (part == "from" or part == "join") and (
                        prv == ")" or i > 1 and low[i - 2] in ("from", "join", ",")):
                    kind = "alias"
                else:
                    kind = "column"
            else:
                kind = "punct"
        if kw is not None:
            at = numbers.get(kw, 0)
            numbers[kw] = at + 1
            label = f"SQL_KEYWORD_{kw}_{at}"
            nodes[label, kw, "SQL_KEYWORD"] = None
        if lt == "select":
            selects[before] = (pos, label)
            begins.append((pos, before))
            if here - before > select_level.get(pos, -1 << 60):
                select_level[pos] = here - before
            if before == 0:
                tops.append(label)
            elif last_any is not None:
                links.append((last_any, label, "this"))
        scope, scope_select = selects.get(before, (0, None))
        if kind == "clause":
            if lt != "select" and scope_select is not None:
                links.append((scope_select, label, lt))
        elif kind == "setop":
            if before == 0:
                links.append(("ROOT", label, "expression"))
                if top_setop is None or label > top_setop:
                    top_setop = label
        elif kind == "table":
            name = f"TABLE_{tok}"
            nodes[name, tok, "TABLE"] = None
            owner = prv_label if prv == "join" else scope_select
            if owner is not None:
                links.append((owner, name, "FROM"))
            froms.setdefault(scope, []).append((tok, prv == "from"))
            named.setdefault((before, scope), []).append((pos, tok, lt, True))
        elif kind == "alias":
            back = i - 2 if prv == "as" else i - 1
            table = toks[back] if back >= 0 else None
            if table is not None and table != ")":
                named.setdefault((before, scope), []).append((pos, table, lt, False))
                if lt not in aliases or table > aliases[lt]:
                    aliases[lt] = table
        elif kind == "literal":
            value = tok.replace("'", "")
            nodes[f"VALUE_{value}", value, "VALUE"] = None
            links.append((label, f"VALUE_{value}", "VALUE"))
        elif kind == "star":
            nodes["SQL_KEYWORD_STAR", "*", "SQL_KEYWORD"] = None
        rows.append((kind, kw, label, before, scope, here - before, prv, prv_label))
        if kw is not None and kind != "literal" and kind != "paren":
            last_any = label
        if lt in _PARTS:
            part = lt
        if lt == "and" or lt == "or" or lt == "between":
            conn[level] = lt
        prv = lt
    if tops:
        above = top_setop or "ROOT"
        links.extend((above, t, "expression") for t in tops)

    items: dict[int, list] = {}
    enclosing: dict[int, int] = {}  # the last SELECT before a token, of each depth
    begun = 0
    for i in range(n):
        kind, kw, label, depth, scope, lvl, prv, prv_label = rows[i]
        lt, pos = low[i], places[i]
        if kind == "column":
            while begun < len(begins) and begins[begun][0] < pos:
                enclosing[begins[begun][1]] = begins[begun][0]
                begun += 1
            tok = toks[i]
            qual, _, cname = tok.rpartition(".")
            table = None
            if known:
                want, held = (qual.lower(), None) if qual else (None, holders.get(lt))
                if want is not None or held:
                    for d in sorted(enclosing, reverse=True) if len(enclosing) > 1 else enclosing:
                        hits = [x for x in named.get((d, enclosing[d]), ()) if x[2] == want or held and x[3] and x[2] in held] \
                            if d <= depth else ()
                        if hits:
                            table = min(hits)[1]
                            break
            if table is None:
                if qual:
                    table = aliases.get(qual.lower(), qual)
                elif scope in froms:
                    own = froms[scope]
                    table = max((t for t, after_from in own if after_from), default=None)
                    if table is None and min(own)[0] == max(own)[0]:
                        table = own[0][0]
            label = f"COLUMN_{'UNRESOLVED' if table is None else table}.{cname}"
            nodes[label, cname, "COLUMN"] = None
            if table is not None:
                nodes[f"TABLE_{table}", table, "TABLE"] = None
                links.append((label, f"TABLE_{table}", "belongs_to"))
            take, prec = "leaf", LEAF
        elif kind == "clause" or kind == "setop":
            take, prec = "clause", -1
        elif kind == "literal" or kind == "sub":
            take, prec = "leaf", LEAF
        elif kind == "star":
            take, prec, label = "leaf", LEAF, "SQL_KEYWORD_STAR"
        elif kind == "op":
            rel = 10 * (lvl - select_level.get(scope, 0))
            if kw == "NEG":
                take, prec = "prefix", rel + 8
            elif kw == "NOT":
                if low[i + 1] in _NEGATED:
                    continue
                take, prec = ("binary", rel + 4) if prv == "is" else ("prefix", rel + 3)
            else:
                take, prec = "binary", rel + _BINDS.get(kw, 4)
        elif kind == "agg" or kind == "paren":
            take, prec = "prefix", 10 * (lvl - select_level.get(scope, 0)) + 9
        elif lt in _BARS:
            take, prec = "bar", 10 * (lvl - select_level.get(scope, 0))
        elif lt == "and":
            take, prec = "bar", 10 * (lvl - select_level.get(scope, 0)) + 5
        else:
            continue
        neg = prv_label if prv == "not" and (kw == "IN" or kw == "LIKE" or kw == "BETWEEN") else None
        if scope in items:
            items[scope].append((pos, prec, take, label, kind, kw, neg))
        else:
            items[scope] = [(pos, prec, take, label, kind, kw, neg)]
    if edges:
        for own in items.values():
            if len(texts) > 1:
                own.sort(key=lambda x: (x[:3], *((v is not None, v or "") for v in x[3:])))
            fold(own, links)
    return nodes, dict.fromkeys(links)


_NODE = ("node_id", "val", "type")
_LINK = ("src", "dst", "label")


def graph_type(qid: str) -> str:
    """Schema of the graphs of queries whose qid has the type ``qid``."""
    def rows(names):
        return "array<struct<" + ",".join(f"{c}:string" for c in names) + ">>"

    return f"qid {qid}, ns {rows(_NODE)}, es {rows(_LINK)}"


def _lists(graphs: list[dict], names: tuple[str, ...]) -> pa.ListArray:
    """One list of structs for each of ``graphs``."""
    starts, flat = [0], []
    for g in graphs:
        flat.extend(g)
        starts.append(len(flat))
    columns = zip(*flat, strict=True) if flat else ((),) * len(names)
    rows = pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], names)
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), rows)


#: Graphs of an Arrow batch.
BATCH = 2048


def folds(holders: dict[str, set[str]], edges: bool = True):
    """A function of Arrow batches ``(qid, q)``, sorted by qid, or ``(qid, q, held)`` to the graphs ``(qid, ns, es)``.

    ``held`` names the holders (column_name, tables) of a row's columns where ``holders`` would be too large.
    """
    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        qid, texts, held = None, [], {}
        for b in batches:
            rows = [c.to_pylist() for c in b.columns]
            for q, text, *more in zip(*rows, strict=True):
                if texts and q != qid:
                    yield qid, texts, held
                    texts, held = [], {}
                qid = q
                if text is not None:
                    texts.append(text)
                for x in more[0] or () if more else ():
                    held[x["column_name"]] = set(x["tables"])
        if texts:
            yield qid, texts, held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        kind = first.schema.field(0).type

        def chained():
            yield first
            yield from batches

        def made(qids, ns, es):
            return pa.RecordBatch.from_arrays([pa.array(qids, kind), _lists(ns, _NODE), _lists(es, _LINK)], ["qid", "ns", "es"])

        qids, ns, es = [], [], []
        for qid, texts, held in groups(chained()):
            n, e = graph_of(texts, held or holders, qid is not None, edges)
            if n:
                qids.append(qid)
                ns.append(n)
                es.append(e if edges else {})
            if len(qids) >= BATCH:
                yield made(qids, ns, es)
                qids, ns, es = [], [], []
        if qids:
            yield made(qids, ns, es)

    return run
