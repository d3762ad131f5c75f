"""DuckDB SQL of the queries on conversations and on repeated passages."""

from __future__ import annotations

#: 256 entries of the table of the checksum, from its polynomial.
_CRC_TABLE = """SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, b: xor(c >> 1, 3988292384 * (c & 1)))) AS t"""


def _crc32(text: str, table: str = "crc.t") -> str:
    """crc32 of ASCII text."""
    codes = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"""xor(list_reduce(list_concat([4294967295], {codes}), lambda c, b: xor(c >> 8, {table}[CAST((xor(c, b) & 255) + 1 AS INTEGER)])), 4294967295)"""


def _put(letter: str, cost: int | str, rest: str, added: str) -> str:
    """Candidate: six digits of cost and the audit as text `k`, the repaired rows `r`, each with a newline in front."""
    key = f"lpad(CAST(CAST({rest}.k[1:6] AS BIGINT) + {cost} AS VARCHAR), 6, '0') || '{letter}' || {rest}.k[7:]"
    return f"struct_pack(k := {key}, r := {added} || {rest}.r)"


def _least(*options: str) -> str:
    return f"list_reduce([{', '.join(options)}], lambda x, y: CASE WHEN x.k <= y.k THEN x ELSE y END)"


def _inserts(p: str) -> str:
    """The four states (start, s, u, a) of list `p` after up to two inserted rows; dead ends have the key '9'."""
    user = lambda x: f"CASE WHEN {x}.k < '9' THEN {_put('I', 3, x, chr(39) + chr(10) + 'user:' + chr(39))} ELSE {x} END"
    bot = lambda x: f"CASE WHEN {x}.k < '9' THEN {_put('I', 3, x, chr(39) + chr(10) + 'assistant:' + chr(39))} ELSE {x} END"
    start, s, u, a = (f"{p}[{i}]" for i in range(1, 5))
    after_u = _least(u, bot(a), bot(f"({user(u)})"))
    after = [_least(x, user(u), user(f"({bot(a)})")) for x in (start, s, a)]
    return f"[{after[0]}, {after[1]}, {after_u}, {after[2]}]"


def _row_options(state: int) -> str:
    """What may become of row `w` before the list `f` of the states behind it."""
    more = "(CASE WHEN w.fault = 3 THEN 3 ELSE 0 END)"
    free = {1: (3, "user"), 2: (3, "user"), 3: (4, "assistant"), 4: (3, "user")}[state]
    keep = {1: {"s": 2, "u": 3}, 2: {"u": 3}, 3: {"a": 4}, 4: {"u": 3}}[state]
    delete = _put("D", 4, f"f[{state}]", "''")
    rerole = _put("R", f"3 + {more}", f"f[{free[0]}]", f"chr(10) || '{free[1]}:' || w.text")
    kept = [f"CASE WHEN w.role[1:1] = '{i}' THEN {_put('K', more, f'f[{to}]', 'chr(10) || w.role || chr(58) || w.text')} ELSE {rerole} END" for i, to in keep.items()]
    return f"CASE WHEN w.fault IN (1, 2) THEN {delete} ELSE {_least(delete, rerole, *kept)} END"


REPAIR_SQL = rf"""
WITH RECURSIVE crc AS ({_CRC_TABLE}),
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS fault FROM conversations, crc),
d AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
             unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy FROM c WHERE fault <> 0),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
             row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM d),
g AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN seen > 1 THEN 2
             WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault,
             lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1:1] AS two FROM e),
h AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
             count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal,
             list(struct_pack(role := role, text := text, fault := fault) ORDER BY i) AS ws FROM g GROUP BY conv_id),
z AS (SELECT [struct_pack(k := '000000', r := ''), struct_pack(k := '9', r := ''), struct_pack(k := '9', r := ''), struct_pack(k := '000000', r := '')] AS p),
r AS (SELECT conv_id, CAST(len(ws) AS BIGINT) AS i, {_inserts('p')} AS f FROM h, z
      UNION ALL
      SELECT conv_id, i - 1, {_inserts('p')} FROM (
        SELECT conv_id, i, [{', '.join(_row_options(s) for s in range(1, 5))}] AS p
        FROM (SELECT r.conv_id, r.i, r.f, h.ws[r.i] AS w FROM r JOIN h ON r.conv_id IS NOT DISTINCT FROM h.conv_id WHERE r.i > 0))),
o AS (SELECT conv_id, f[1] AS best FROM r WHERE i = 0)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(CAST(best.k[1:6] AS BIGINT), 0) AS cost, coalesce(best.k[7:], '') AS audit, sha256(coalesce(best.r[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN h ON a.conv_id IS NOT DISTINCT FROM h.conv_id LEFT JOIN o ON a.conv_id IS NOT DISTINCT FROM o.conv_id
"""

TRIE_SQL = rf"""
WITH crc AS ({_CRC_TABLE}),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
      FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, count(*) AS n, {_crc32("CAST(conv_id AS VARCHAR)", "any_value(crc.t)")} % 6 AS h FROM t, crc GROUP BY conv_id),
c AS (SELECT a.*, a.conv_id - a.conv_id % 100 AS base, least(a.h, coalesce(b.n, 0)) AS head FROM n a LEFT JOIN n b ON b.conv_id = a.conv_id - a.conv_id % 100),
x AS (SELECT c.conv_id, t.i AS d, role, text FROM c JOIN t ON t.conv_id = c.base AND t.i <= c.head
      UNION ALL SELECT c.conv_id, t.i - c.h + c.head, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > c.h),
p AS (SELECT conv_id, d, length(text) AS chars, list(struct_pack(role := role, text := text)) OVER (PARTITION BY conv_id ORDER BY d) AS path, d = max(d) OVER (PARTITION BY conv_id) AS last FROM x
      UNION ALL SELECT conv_id, 0, 0, [], conv_id NOT IN (SELECT conv_id FROM x) FROM c),
k AS (SELECT d, path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
             coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '') AS ends FROM p GROUP BY d, path),
f AS (SELECT k.*, (SELECT count(*) FROM k q WHERE q.d = k.d + 1 AND q.path[:-2] = k.path) AS n_children,
             (SELECT any_value(q.conv_id) FROM k q WHERE k.d > 0 AND q.d = k.d - 1 AND q.path = k.path[:-2]) AS parent_conv_id FROM k),
u AS (SELECT a.d, a.path, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.chars) AS saved_tokens
      FROM f a JOIN p s ON s.d = a.d AND s.path = a.path JOIN f b ON b.d >= a.d AND b.conv_id = s.conv_id GROUP BY a.d, a.path)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, f.parent_conv_id, f.n_convs, f.n_children, u.n_leaves, CAST(u.saved_tokens AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN u ON u.d = f.d AND u.path = f.path
"""

REPEATS_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 18, 1))) AS s, w FROM d),
y AS (SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(w[s : s + 19], ' ') ORDER BY doc_id NULLS LAST, s) > 1 AS again FROM x),
z AS (SELECT DISTINCT doc_id, s + o AS pos FROM (SELECT doc_id, s, unnest(range(20)) AS o FROM y WHERE again)),
g AS (SELECT doc_id, list(pos) AS gone FROM z GROUP BY doc_id),
v AS (SELECT d.doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
k AS (SELECT v.doc_id, string_agg(word, ' ' ORDER BY v.pos) AS kept FROM v LEFT JOIN z ON z.doc_id = v.doc_id AND z.pos = v.pos WHERE z.pos IS NULL GROUP BY v.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g ON g.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id
"""
