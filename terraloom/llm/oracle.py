"""SQL giving the same rows as the queries that SQL can express."""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _words(table: str, key: str) -> str:
    return rf"SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM {table}"


OP1 = f"""
WITH d AS ({_words("documents", "doc_id")}), it AS ({_words("benchmark", "item_id")}),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS k FROM it, unnest(range(1, greatest(len(w) - 12, 1) + 1)) t(i) WHERE len(w) > 0),
pos AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM d, (SELECT DISTINCT n FROM win) s, unnest(range(1, len(w) - n + 2)) t(i)),
hit AS (SELECT doc_id, i, n, item_id FROM pos JOIN win USING (n, k)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) t(p) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _escape(text: str, control: tuple) -> str:
    out = f"replace({text}, '\\', '\\\\')"
    for c in control:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


def op3(control: tuple, frame: int, budget: int, history: int) -> str:
    return f"""
WITH given AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL
  SELECT -1, k, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(k, r)),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS k FROM given),
x AS (SELECT *, CAST(ceil((strlen(role) + strlen(text)) / 4e0) AS BIGINT) + 4 AS tok, k = 0 AND role = 'system' AS sys,
  length({_escape("role", control)}) + length({_escape("text", control)}) + {frame} AS size FROM t),
p AS (SELECT *, coalesce(max(CASE WHEN sys THEN tok END) OVER c, 0) AS stok, sum(tok) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM x WINDOW c AS (PARTITION BY conv_id)),
b AS (SELECT *, greatest(1, {budget - history} - stok) AS room, greatest(0, upto - tok - stok) AS b FROM p),
o AS (SELECT *, b // room AS cell FROM b),
m AS (SELECT conv_id, cell, max(k) AS last_k, count(*) > 1 AND arg_max(b + tok, k) - arg_min(b, k) > any_value(room) AS over FROM o GROUP BY 1, 2),
f AS (SELECT o.*, CASE WHEN over AND k = last_k THEN 1 ELSE 0 END AS part FROM o JOIN m USING (conv_id, cell)),
w AS (SELECT conv_id, cell, part, min(k) AS from_k, arg_min(b, k) AS first, sum(size) AS own FROM f GROUP BY 1, 2, 3),
h AS (SELECT w.conv_id, w.cell, w.part, any_value(own) + coalesce(sum(f.size) FILTER (WHERE f.sys OR (f.k < w.from_k AND w.first - f.b <= {history})), 0) AS size
  FROM w LEFT JOIN f ON f.conv_id = w.conv_id AND f.k < w.from_k GROUP BY 1, 2, 3),
c AS (SELECT conv_id, CAST(sum(size) AS BIGINT) AS formatted_chars FROM h GROUP BY 1)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, any_value(formatted_chars) AS formatted_chars
FROM t JOIN c USING (conv_id) GROUP BY 1
"""


_B32 = " || ".join(
    f"substr('{_UPPER}234567', CAST((v[{i + 1}] >> {s}) & 31 AS INTEGER) + 1, 1)" for i in range(8) for s in (15, 10, 5, 0))

OP7 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
f AS (SELECT s, min(page_id) AS first FROM p GROUP BY 1),
d AS (SELECT p.*, first, list_transform(range(8), lambda i: CAST('0x' || substr(p.s, CAST(5 * i + 1 AS INTEGER), 5) AS BIGINT)) AS v FROM p JOIN f USING (s))
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, {_B32} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d
"""

OP8 = """
WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""


def op11(parts: int, entries: int, rounds: int, scale: int) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f"d{r} AS MATERIALIZED (SELECT x.vec_id, x.k, x.q, min(struct_pack(d := list_sum(list_transform(range(1, len(x.q) + 1), lambda i: (x.q[i] - c.c[i]) * (x.q[i] - c.c[i])))::BIGINT, j := c.j)) AS b "
            f"FROM x JOIN c{r} c USING (k) GROUP BY 1, 2, 3)")
        if r < rounds:
            steps.append(
                f"s{r} AS (SELECT k, j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (SELECT k, b.j AS j, i, sum(q[i])::BIGINT AS s, count(*) AS n FROM d{r}, unnest(range(1, len(q) + 1)) t(i) GROUP BY 1, 2, 3) GROUP BY 1, 2), "
                f"c{r + 1} AS MATERIALIZED (SELECT c.k, c.j, coalesce(s.c, c.c) AS c FROM c{r} c LEFT JOIN s{r} s ON s.k = c.k AND s.j = c.j)")
    return f"""
WITH e AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT vec_id, k, v[k * (len(v) // {parts}) + 1:(k + 1) * (len(v) // {parts})] AS q FROM e, range({parts}) t(k)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS j FROM e ORDER BY vec_id LIMIT {entries}),
c0 AS MATERIALIZED (SELECT k, j, q AS c FROM x JOIN f USING (vec_id)),
{", ".join(steps)},
o AS (SELECT vec_id, string_agg(printf('%02x', b.j), '' ORDER BY k) AS code, CAST(sum(b.d) AS BIGINT) AS error FROM d{rounds} GROUP BY 1)
SELECT e.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY k, j)) FROM c{rounds}) AS codebooks_sha256 FROM e JOIN o USING (vec_id)
"""


# Edits as text with their cost: rows are read one after another, and for each
# state the least (cost, audit) is kept. Inserts come before the row's own edit.
_NEXT = "(CASE s WHEN 2 THEN 3 ELSE 2 END)"
OP13 = f"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
    lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
g AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
h AS (SELECT *, xor(list_reduce(list_transform(range(1, length(key) + 1), lambda i: CAST(ascii(key[i]) AS BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS fault FROM g, tab),
w AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM h, LATERAL (SELECT unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))) WHERE fault <> 0),
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
    substr(role, 1, 1) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM w),
n2 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again FROM n),
r AS MATERIALIZED (SELECT *, bare = '' AS blank, bare <> '' AND again AS dup, bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS open, lag(i) OVER (PARTITION BY conv_id ORDER BY k) || i AS pair FROM n2),
f AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE dup) AS duplicate, count(*) FILTER (WHERE open) AS truncated,
    count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, max(k) AS n FROM r GROUP BY 1),
dp AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS k, 0 AS s, 0 AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS said FROM r UNION ALL (
  SELECT conv_id, k, s2, min(struct_pack(c := c, a := a)).c, min(struct_pack(c := c, a := a)).a, arg_min(d, struct_pack(c := c, a := a)) FROM (
    SELECT m.conv_id, r.k, e.s2, m.cost + e.c AS c, m.audit || e.a AS a, CASE WHEN e.said IS NULL THEN m.said ELSE list_append(m.said, e.said) END AS d
    FROM (SELECT conv_id, k, s, cost, audit, said FROM dp UNION ALL SELECT conv_id, k, {_NEXT}, cost + 2, audit || 'I', list_append(said, CASE s WHEN 2 THEN 'assistant:' ELSE 'user:' END) FROM dp
      UNION ALL SELECT conv_id, k, CASE s WHEN 2 THEN 2 ELSE 5 - {_NEXT} END, cost + 4, audit || 'II', list_concat(said, CASE s WHEN 2 THEN ['assistant:', 'user:'] ELSE ['user:', 'assistant:'] END) FROM dp) m
    JOIN r ON r.conv_id = m.conv_id AND r.k = m.k + 1,
    LATERAL (SELECT m.s AS s2, 3 AS c, 'D' AS a, NULL AS said
      UNION ALL SELECT CASE m.s WHEN 2 THEN 3 ELSE 2 END, 2 + r.open::INT, 'R', CASE m.s WHEN 2 THEN 'assistant:' ELSE 'user:' END || r.text WHERE NOT r.blank AND NOT r.dup
      UNION ALL SELECT CASE r.i WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, r.open::INT, 'K', r.role || ':' || r.text
        WHERE NOT r.blank AND NOT r.dup AND ((r.i = 's' AND m.s = 0) OR (r.i = 'u' AND m.s <> 2) OR (r.i = 'a' AND m.s = 2))) e) GROUP BY 1, 2, 3)),
z AS (SELECT conv_id, min(struct_pack(c := c, a := a)).c AS cost, min(struct_pack(c := c, a := a)).a AS audit, arg_min(d, struct_pack(c := c, a := a)) AS said FROM (
    SELECT conv_id, cost + CASE s WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END AS c, audit || CASE s WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END AS a,
      list_concat(said, CASE s WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE CAST([] AS VARCHAR[]) END) AS d FROM dp JOIN f USING (conv_id) WHERE k = n) GROUP BY 1)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN f USING (conv_id) LEFT JOIN z USING (conv_id)
"""
