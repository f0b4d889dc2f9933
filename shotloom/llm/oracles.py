"""DuckDB SQL of the training-data queries that SQL can express, over the same whole tables.

The others (models, hashing searches, tokenizer files, surrogates, packing) are
tested against brute-force versions in ``tests/llm``.
"""

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP2 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

OP3 = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len({_WORDS.format("coalesce(text, '')")}) AS BIGINT) AS size,
         md5(concat_ws('|', 'mix-1', doc_id, md5(text))) AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS DOUBLE) AS w
  FROM d GROUP BY source),
-- sources in the order in which a rising rate meets their caps
r AS (
  SELECT *, (SELECT CAST(sum(source_size) AS DOUBLE) FROM s) AS total,
         coalesce(sum(3.0::DOUBLE * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
         sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w,
         row_number() OVER o AS place
  FROM s WINDOW o AS (ORDER BY 3.0::DOUBLE * source_size / w, source IS NULL, source)),
f AS (
  SELECT (total - used) / open_w AS rate FROM r
  WHERE 3.0::DOUBLE * source_size > w * ((total - used) / open_w) ORDER BY place LIMIT 1),
g AS (
  SELECT source, source_size,
         coalesce(least(3.0::DOUBLE * source_size, w * (SELECT rate FROM f)), 3.0::DOUBLE * source_size) AS target
  FROM s),
b AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS budget, greatest(source_size, 1) AS once FROM g),
c AS (
  SELECT d.*, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM d)
SELECT c.doc_id, c.size, b.source_size, b.target,
       CAST((b.budget // b.once) * c.size + least(greatest(b.budget % b.once - c.before, 0), c.size) AS BIGINT) AS taken
FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source
"""

OP8 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws
  FROM documents),
sh AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS s
  FROM w),
-- documents with equal sets are one class
cls AS (SELECT min(doc_id) AS c, list_sort(s) AS s, any_value(len(s)) AS n FROM sh WHERE len(s) > 0 GROUP BY list_sort(s)),
x AS (SELECT c, n, unnest(s) AS g FROM cls),
p AS (
  SELECT a.c AS a, b.c AS b, count(*) AS i, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM x a JOIN x b ON a.g = b.g AND a.c < b.c AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.c, b.c),
e AS (SELECT a, b FROM p WHERE 100 * i >= 85 * (na + nb - i)),
sym AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
walk(c, to_c) AS (
  SELECT c, c FROM cls UNION SELECT walk.c, sym.b FROM walk JOIN sym ON sym.a = walk.to_c),
low AS (SELECT c, min(to_c) AS component_id FROM walk GROUP BY c)
SELECT sh.doc_id, CAST(len(sh.s) AS BIGINT) AS n_shingles, coalesce(low.component_id, sh.doc_id) AS component_id,
       coalesce(low.component_id, sh.doc_id) = sh.doc_id AS kept
FROM sh LEFT JOIN cls ON len(sh.s) > 0 AND cls.s = list_sort(sh.s) LEFT JOIN low ON low.c = cls.c
"""


def _op5() -> str:
    """The rules and the template tree, one CTE for each level of the tree."""
    from shotloom.llm.urls import DEPTH, FEW, HASH, MANY, RULES, STRENGTH, UUID, Z

    def fits(h: str, p: str) -> str:
        return f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"

    rules = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    cases = {k: " ".join(f"WHEN {fits(h, p)} THEN '{(h + p, v)[k]}'" for v, h, p in rules) for k in (0, 1)}
    unid = f"regexp_replace(g, '{UUID}', '{{u}}', 'g')"
    hashed = (f"CASE WHEN regexp_matches({unid}, '{HASH}') AND regexp_matches({unid}, '[0-9]') "
              f"AND regexp_matches({unid}, '^[0-9a-fA-F]{{12,}}') "
              f"THEN regexp_replace({unid}, '^[0-9a-fA-F]{{12,}}', '{{h}}') ELSE {unid} END")
    levels = []
    for k in range(DEPTH):
        pre, seg = f"array_to_string(segs[1:{k}], '/')" if k else "''", f"segs[{k + 1}]"
        levels.append(f"""
c{k} AS (SELECT host, {pre} AS pre, {seg} AS seg, sum(n) AS c FROM n{k} WHERE len(segs) > {k} GROUP BY ALL),
w{k} AS (SELECT host, pre FROM c{k} WHERE c < {FEW} GROUP BY host, pre HAVING count(*) >= {MANY}),
n{k + 1} AS (
  SELECT t.host, t.raw, t.n, t.block, t.labelled,
         CASE WHEN w.host IS NOT NULL THEN t.segs[1:{k}] || ['*'] || t.segs[{k + 2}:] ELSE t.segs END AS segs
  FROM n{k} t LEFT JOIN c{k} c ON c.host = t.host AND c.pre = {pre.replace("segs", "t.segs")} AND c.seg = t.{seg} AND c.c < {FEW}
  LEFT JOIN w{k} w ON w.host = c.host AND w.pre = c.pre),""")
    return f"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (
  SELECT *, CASE {cases[0]} END AS rule, CASE {cases[1]} END AS fixed,
         list_transform(string_split(substr(path, 2), '/'), lambda g: regexp_replace({hashed}, '[0-9]+', '{{n}}', 'g')) AS parts
  FROM h),
g AS (SELECT * EXCLUDE (parts), CASE WHEN len(parts) > {DEPTH} THEN parts[1:{DEPTH}] || ['**'] ELSE parts END AS segs FROM f),
n0 AS (
  SELECT host, array_to_string(segs, '/') AS raw, segs, count(*) AS n, count(*) FILTER (WHERE fixed = 'block') AS block,
         count(fixed) AS labelled FROM g GROUP BY host, segs),
tot AS (SELECT (coalesce(sum(block), 0) + 0.5::DOUBLE) / (coalesce(sum(labelled), 0) + 1)::DOUBLE AS prior FROM n0),{"".join(levels)}
wide AS (SELECT *, array_to_string(segs[1:len(segs) - 1], '/') AS parent, segs[len(segs)] AS leaf FROM n{DEPTH}),
leaf AS (SELECT host, parent, leaf, sum(block)::DOUBLE AS k, sum(labelled)::DOUBLE AS m FROM wide GROUP BY ALL),
pool AS (SELECT host, parent, (sum(k) + 0.5) / (sum(m) + 1) AS share FROM leaf GROUP BY ALL),
branch AS (
  SELECT leaf.*, CASE WHEN abs((k - m * share) / sqrt(greatest(m, 1) * share * (1 - share))) < {Z} THEN '+' ELSE leaf.leaf END AS branch
  FROM leaf JOIN pool USING (host, parent)),
merged AS (SELECT host, parent, branch, sum(k) AS k, sum(m) AS m FROM branch GROUP BY ALL),
everywhere AS (SELECT parent, sum(k) AS gk, sum(m) AS gm FROM merged GROUP BY parent),
judged AS (
  SELECT host, parent, branch, (k + {STRENGTH}::DOUBLE * ((gk + {STRENGTH}::DOUBLE * prior) / (gm + {STRENGTH}::DOUBLE))) / (m + {STRENGTH}::DOUBLE) AS purity
  FROM merged JOIN everywhere USING (parent), tot),
best AS (
  SELECT w.host, w.raw, max({{'purity': j.purity, 't': w.parent || '/' || b.branch}}) AS b
  FROM (SELECT DISTINCT host, raw, parent, leaf FROM wide) w JOIN branch b USING (host, parent, leaf)
  JOIN judged j ON j.host = w.host AND j.parent = w.parent AND j.branch = b.branch GROUP BY w.host, w.raw)
SELECT g.page_id, g.host, g.path, g.rule,
       coalesce(g.fixed, CASE WHEN best.b.purity >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
       best.b.t AS template, best.b.purity AS purity
FROM g LEFT JOIN best ON best.host = g.host AND best.raw = array_to_string(g.segs, '/')
"""


OP5 = _op5()

#: The 256 remainders of the reflected CRC-32 polynomial, and the CRC-32 of a list of bytes by them.
_CRC_TABLE = """SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k:
    CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END, b)) AS crc_table"""
_CRC = ("xor(list_reduce({bytes}, lambda c, b: xor(crc_table[xor(c, b) % 256 + 1], c // 256), "
        "4294967295::BIGINT), 4294967295::BIGINT)")
_ID_BYTES = "list_transform(string_split({id}, ''), lambda x: ord(x)::BIGINT)"

OP11 = f"""
WITH t AS ({_CRC_TABLE}),
d AS (
  SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format("coalesce(text, '')")} AS ws,
         {_CRC.format(bytes=_ID_BYTES.format(id="CAST(doc_id AS VARCHAR)"))} AS h
  FROM documents, t),
g AS (SELECT *, CAST(len(ws) AS BIGINT) AS n, h // 10 AS g FROM d),
a AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM g),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
e AS (
  SELECT rid, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i:
         ws[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) ELSE ws END AS ws
  FROM p),
w AS (SELECT rid, n, unnest(ws) AS w, unnest(range(n)) AS i FROM e),
-- equal words q apart; their islands of consecutive places are the stretches of period q
m AS (
  SELECT x.rid, y.i - x.i AS q, x.i, x.i - row_number() OVER (PARTITION BY x.rid, y.i - x.i ORDER BY x.i) AS island
  FROM w x JOIN w y ON x.rid = y.rid AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
s AS (
  SELECT rid, q, min(i) AS s, count(*) + q AS length FROM m GROUP BY rid, q, island
  HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (
  SELECT * FROM s WHERE NOT EXISTS (
    SELECT 1 FROM s z WHERE z.rid = s.rid AND z.q < s.q AND s.q % z.q = 0 AND z.s <= s.s AND z.s + z.length >= s.s + s.length)),
c AS (
  SELECT rid, string_agg(w, ' ' ORDER BY i) AS collapsed FROM w
  WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.rid = w.rid AND w.i >= r.s + r.q AND w.i < r.s + r.length) GROUP BY rid),
o AS (
  SELECT rid, count(*) AS n_runs, string_agg(s || ',' || length || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
         first(struct_pack(s, length, q) ORDER BY CAST(length AS DOUBLE) / q DESC, s, q) AS best
  FROM r GROUP BY rid)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.s AS BIGINT) AS start,
       CAST(best.length AS BIGINT) AS length, CAST(best.q AS BIGINT) AS period,
       CAST(1000 * best.length // best.q AS BIGINT) AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM e LEFT JOIN o USING (rid) LEFT JOIN c USING (rid)
"""

_RUN_BYTES = ("list_concat(" + _ID_BYTES.format(id="(doc_id || ':')") + ", flatten(list_transform(string_split(run, ''), "
              "lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [195::BIGINT, ord(x)::BIGINT - 64] END)))")

OP13 = f"""
WITH RECURSIVE t AS ({_CRC_TABLE}),
r AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
  FROM documents),
u AS (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= 5 GROUP BY doc_id, run),
h AS (SELECT run, n, {_CRC.format(bytes=_RUN_BYTES)} AS h FROM u, t),
w AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word,
         CAST(sum(n) AS BIGINT) AS n
  FROM h GROUP BY 1),
v AS (SELECT word, n FROM w WHERE length(word) >= 5 AND n >= 3),
-- every word without its i-th code point
x AS (
  SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
p AS (
  SELECT a.word, b.word AS form, b.n FROM x a JOIN x b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT x.word, v.word, v.n FROM x JOIN v ON x.rest = v.word
  UNION SELECT v.word, x.word, x.n FROM x JOIN v ON x.rest = v.word),
b AS (
  SELECT word, count(*) AS n_near, first(struct_pack(form, n) ORDER BY n DESC, form) AS best FROM p GROUP BY word),
f AS (
  SELECT word, v.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near,
         CASE WHEN best.n >= 2 * v.n THEN best.form END AS form, CASE WHEN best.n >= 2 * v.n THEN best.n END AS form_n
  FROM v LEFT JOIN b USING (word)),
path AS (
  SELECT word, form, word AS root FROM f
  UNION ALL SELECT path.word, f.form, f.word FROM path JOIN f ON path.form = f.word)
SELECT f.word, f.form, path.root, f.n, n_near, CAST(form_n AS BIGINT) AS form_n
FROM f JOIN path ON f.word = path.word AND path.form IS NULL
"""
