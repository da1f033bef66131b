"""The SQL twins of the operators' queries, for those that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANK = r"[^\x20\x09-\x0D]+"
_PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _lower(text: str) -> str:
    return f"translate({text}, '{_UPPER}', '{_LOWER}')"


def _words(name: str, table: str, key: str, text: str, pattern: str) -> str:
    """name: (key, i, w), the words of each row of a table, counted from 1."""
    found = f"regexp_extract_all(coalesce({text}, ''), '{pattern}')"
    return f"{name} AS (SELECT {key}, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM (SELECT {key}, {found} AS ws FROM {table}))"


def _windows(name: str, source: str, key: str, size: int) -> str:
    """name: (key, i, win, n): windows of size words, or the whole of a row with fewer."""
    return (
        f"{name} AS (SELECT {key}, i, win, len(win) AS n FROM (SELECT {key}, i, list(w) OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN CURRENT ROW AND {size - 1} FOLLOWING) AS win, count(*) OVER (PARTITION BY {key}) AS whole FROM {source}) "
        f"WHERE len(win) = {size} OR (i = 1 AND whole < {size}))"
    )


#: Base 32 of SHA-1: five hex digits are four symbols.
_B32 = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
_DIGEST = f"array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr({_B32}, CAST(((CAST('0x' || substr(hex, CAST(g * 5 + 1 AS INT), 5) AS BIGINT) >> s) & 31) + 1 AS INT), 1)), '')), '')"

OP1 = f"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS hex FROM pages), h AS (SELECT hex, max(page_id) AS head FROM p GROUP BY hex)
SELECT page_id, n AS payload_bytes, {_DIGEST} AS payload_digest, CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> head THEN head END AS refers_to FROM p JOIN h USING (hex)"""

#: Bytes as pairs of hex digits; a string of 200 bytes is 400 digits at an even place, read from stretches that overlap.
OP5 = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, c, substr(h, CAST(c * 1024 + 1 AS INT), 1024 + 398) AS h FROM (SELECT doc_id, h, unnest(range(0, (length(h) - 400) // 1024 + 1)) AS c FROM d WHERE length(h) >= 400)),
s AS (SELECT doc_id, c * 512 + i AS i, md5_number(substr(h, CAST(2 * i + 1 AS INT), 400)) AS k FROM (SELECT doc_id, c, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM c)),
r AS (SELECT doc_id, i FROM s JOIN (SELECT k FROM s GROUP BY k HAVING count(*) > 1) USING (k)),
g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM r),
runs AS (SELECT doc_id, min(i) AS lo, max(i) + 200 AS hi FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g) GROUP BY doc_id, run),
kept AS (SELECT doc_id, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS a, lo AS b FROM runs),
parts AS (SELECT doc_id, count(*) AS n_spans, sum(hi - b) AS n_removed, string_agg(substr(h, CAST(2 * a + 1 AS INT), CAST(2 * (b - a) AS INT)), '' ORDER BY a) || substr(any_value(h), CAST(2 * max(hi) + 1 AS INT)) AS rest FROM kept JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256 FROM d LEFT JOIN parts USING (doc_id)"""

OP7 = f"""WITH {_words("dw", "documents", "doc_id", _lower("coalesce(text, '')"), _PLAIN)}, {_words("bw", "benchmark", "item_id", _lower("coalesce(text, '')"), _PLAIN)}, {_windows("items", "bw", "item_id", 10)},
sizes AS (SELECT DISTINCT n FROM items), sized AS (SELECT doc_id, i, list(w) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ten FROM dw),
found AS (SELECT DISTINCT doc_id, i, CAST(n AS INT) AS n, CAST(item_id AS VARCHAR) AS item FROM (SELECT doc_id, i, n, ten[1:n] AS win FROM sized CROSS JOIN sizes WHERE len(ten) >= n) JOIN (SELECT item_id, win, n FROM items) USING (win, n)),
hits AS (SELECT doc_id, count(DISTINCT i + o) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM found) CROSS JOIN range(0, 10) AS k(o) WHERE o < n GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM found GROUP BY doc_id), sums AS (SELECT doc_id, count(*) AS n_words FROM dw GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM documents LEFT JOIN sums USING (doc_id) LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)"""

OP9 = f"""WITH {_words("dw", "documents", "doc_id", "text", _BLANK)}, win AS (SELECT doc_id, i, win FROM (SELECT doc_id, i, list(w) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS win FROM dw) WHERE len(win) = 50),
keyed AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY md5_number(array_to_string(win, ' '))) AS first FROM win), seen AS (SELECT doc_id, i FROM keyed WHERE first < doc_id),
marked AS (SELECT d.doc_id, d.i, w, max(s.i) OVER (PARTITION BY d.doc_id ORDER BY d.i) AS last FROM dw d LEFT JOIN seen s ON s.doc_id = d.doc_id AND s.i = d.i),
sums AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE i - last < 50) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (WHERE last IS NULL OR i - last >= 50) AS kept FROM marked GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN sums USING (doc_id)"""

#: Equal sets are one node; linked nodes meet in a recursion over smaller and smaller least ids.
OP10 = f"""WITH RECURSIVE {_words("dw", "documents", "doc_id", _lower("coalesce(text, '')"), _BLANK)}, {_windows("grams", "dw", "doc_id", 3)},
sh AS (SELECT DISTINCT doc_id, hash(win) AS g FROM grams), sets AS (SELECT doc_id, count(*) AS n, sum(g::HUGEINT) AS s, bit_xor(g) AS x FROM sh GROUP BY doc_id),
node AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY n, s, x) AS rep FROM sets), reps AS (SELECT doc_id, n FROM node WHERE rep = doc_id), rs AS (SELECT sh.doc_id, g, n FROM sh JOIN reps USING (doc_id)),
ord AS (SELECT doc_id, g, n, row_number() OVER (PARTITION BY doc_id ORDER BY f, g) AS k FROM (SELECT *, count(*) OVER (PARTITION BY g) AS f FROM rs)),
pre AS (SELECT doc_id, g, n FROM ord WHERE k <= n - (n * 9 + 9) // 10 + 1),
pairs AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS an, b.n AS bn FROM pre a JOIN pre b ON a.g = b.g AND a.doc_id < b.doc_id AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)),
links AS (SELECT p.a, p.b FROM pairs p JOIN rs x ON x.doc_id = p.a JOIN rs y ON y.doc_id = p.b AND y.g = x.g GROUP BY p.a, p.b, an, bn HAVING 100 * count(*) >= 90 * (an + bn - count(*))),
sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
walk AS (SELECT doc_id, doc_id AS least FROM reps UNION SELECT e.b, w.least FROM walk w JOIN sym e ON e.a = w.doc_id WHERE w.least < e.b),
top AS (SELECT doc_id, min(least) AS c FROM walk GROUP BY doc_id)
SELECT d.doc_id, coalesce(node.n, 0) AS n_shingles, coalesce(top.c, d.doc_id) AS component_id FROM documents d LEFT JOIN node ON node.doc_id = d.doc_id LEFT JOIN top ON top.doc_id = node.rep"""

#: Every order of the letters, every step, from counts of masks.
OP11 = r"""WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t),
lab AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CAST(len(ws) < 50 AS INT) + 2 * CAST(100 * coalesce(list_unique(ws), 0) < 65 * len(ws) AS INT)
+ 4 * CAST(100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) AS INT) + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(w.doc_id > first, false) AS INT) AS mask
FROM w LEFT JOIN lab ON lab.doc_id = w.doc_id),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
l(f) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT filter_order, step, substr(filter_order, CAST(step AS INT), 1) AS f, 1 << (ascii(substr(filter_order, CAST(step AS INT), 1)) - 65) AS bit,
CAST(coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(substr(filter_order, CAST(i AS INT), 1)) - 65))), 0) AS INT) AS before FROM orders, range(1, 6) s(step)),
c AS (SELECT part, filter_order, step, f, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost FROM cells, steps GROUP BY part, filter_order, step, f)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM c"""

#: The checksum by a table of 256 remainders; near words meet on the word less a code point, with its place where one is replaced.
OP12 = f"""WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
r AS (SELECT DISTINCT doc_id, run FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS raw, {_lower("raw")} AS run FROM documents) WHERE length(run) >= 7),
b AS (SELECT doc_id, run, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS h FROM r),
k AS (SELECT doc_id, run, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(h) // 2), lambda j: CAST('0x' || substr(h, CAST(2 * j + 1 AS INT), 2) AS BIGINT))), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM b, tab),
spelt AS (SELECT doc_id, run, CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word FROM k),
occ AS (SELECT doc_id, {_lower("raw")} AS run FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS raw FROM documents)),
v AS (SELECT word, count(*) AS n FROM occ JOIN spelt ON occ.run = spelt.run AND occ.doc_id IS NOT DISTINCT FROM spelt.doc_id WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
cut AS (SELECT word, n, CAST(i AS INT) AS i, substr(word, 1, CAST(i AS INT) - 1) || substr(word, CAST(i AS INT) + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
pairs AS (SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
UNION SELECT c.word, v.word, v.n FROM cut c JOIN v ON v.word = c.less UNION SELECT v.word, c.word, c.n FROM cut c JOIN v ON v.word = c.less),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS top FROM pairs GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * v.n THEN top END AS form_n, CASE WHEN top >= 10 * v.n THEN (SELECT min(near) FROM pairs p WHERE p.word = v.word AND p.near_n = top) END AS form FROM v LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS root FROM f UNION ALL SELECT w.word, f.form FROM walk w JOIN f ON f.word = w.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n FROM f JOIN (SELECT walk.word, walk.root FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NULL) w ON w.word = f.word"""

ORACLE_SQL = {"op1_warc": OP1, "op5_repeats": OP5, "op7_decontamination": OP7, "op9_blocks": OP9, "op10_jaccard": OP10, "op11_filter_audit": OP11, "op12_variants": OP12}
