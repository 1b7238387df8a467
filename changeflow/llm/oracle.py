"""DuckDB SQL for the queries that SQL can express, over the same tables.

The others have no SQL: op1 (506 rules), op2, op5 and op9 (tokenizers), op6
(an approximate search), op8 (a classifier); the tests hold them against
brute force.
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lowered(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}')"


_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"

OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, list_aggregate(list_transform(range(32), lambda j:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((16 * (instr('0123456789abcdef', substr(h, CAST(1 + 5 * j // 4 AS INTEGER), 1)) - 1)
    + greatest(instr('0123456789abcdef', substr(h || '0', CAST(2 + 5 * j // 4 AS INTEGER), 1)) - 1, 0)) >> (3 - 5 * j % 4)::INTEGER) & 31), 1)),
  'string_agg', '') AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to FROM f
"""

OP4 = f"""
WITH b AS MATERIALIZED (SELECT item_id, regexp_extract_all({_lowered('text')}, '{_ALNUM}') AS w FROM benchmark),
win AS MATERIALIZED (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS g
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_lowered('text')}, '{_ALNUM}') AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
found AS MATERIALIZED (SELECT rid, i, g.n, item_id FROM (
    SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)) AS g
  JOIN win ON win.n = g.n AND win.g = g.g),
hit AS (SELECT rid, count(DISTINCT i + k) AS n_hit FROM found, unnest(range(0, n)) AS t(k) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)
"""

OP7 = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
g AS MATERIALIZED (SELECT rid, i, array_to_string(w[i:i + 34], ' ') AS s FROM d, unnest(range(1, len(w) - 33)) AS t(i)),
again AS (SELECT s FROM g GROUP BY s HAVING count(*) > 1),
covered AS MATERIALIZED (SELECT DISTINCT rid, i + k AS p FROM g JOIN again USING (s), unnest(range(0, 35)) AS t(k)),
u AS (SELECT rid, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(p)),
kept AS (SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS words FROM u ANTI JOIN covered USING (rid, p) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""

OP10 = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_lowered('text')}, '{_SPACED}') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT rid, array_to_string(w[i:i + 3], ' ') AS g
  FROM d, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT rid, count(*) AS n FROM s GROUP BY rid),
shared AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid GROUP BY a.rid, b.rid),
e AS MATERIALIZED (SELECT x, y FROM shared JOIN n nx ON nx.rid = x JOIN n ny ON ny.rid = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
reach(rid, other) AS (SELECT rid, rid FROM d UNION SELECT reach.rid, e.y FROM reach JOIN e ON e.x = reach.other),
least AS (SELECT reach.rid, min(o.doc_id) AS component_id FROM reach JOIN d o ON o.rid = reach.other GROUP BY reach.rid)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d JOIN least USING (rid) LEFT JOIN n USING (rid)
"""

OP11 = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_lowered('text')}, '{_ALNUM}') AS w FROM documents),
size AS MATERIALIZED (SELECT rid, doc_id, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
total AS MATERIALIZED (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_words FROM size),
tf AS MATERIALIZED (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) GROUP BY rid, term),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS weight
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
q AS MATERIALIZED (SELECT q, item_id, term, count(*) AS times FROM (SELECT row_number() OVER () AS q, item_id,
  unnest(regexp_extract_all({_lowered('text')}, '{_ALNUM}')) AS term FROM benchmark) GROUP BY q, item_id, term),
scored AS (SELECT q, item_id, rid, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_words)))) AS BIGINT) AS score
  FROM q JOIN weight USING (term) JOIN tf USING (term) JOIN size USING (rid), total GROUP BY q, item_id, rid),
ranked AS (SELECT q, item_id, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scored JOIN size USING (rid) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

_ASSIGN = """a{r} AS MATERIALIZED (SELECT rid, position, part, CAST(min(d) AS BIGINT) AS d, CAST(arg_min(entry, d * 256 + entry) AS BIGINT) AS entry FROM (
  SELECT rid, p.position, part, entry, CAST(list_sum(list_transform(range(1, len(part) + 1), lambda i: (part[i] - c[i]) * (part[i] - c[i]))) AS BIGINT) AS d
  FROM p JOIN c{r} AS c ON c.position = p.position) GROUP BY rid, position, part)"""
_UPDATE = """m{r} AS (SELECT position, entry, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x
  FROM (SELECT position, entry, unnest(part) AS x, generate_subscripts(part, 1) AS i FROM a{r}) GROUP BY position, entry, i),
c{n} AS MATERIALIZED (SELECT c.position, c.entry, coalesce(l.c, c.c) AS c FROM c{r} AS c
  LEFT JOIN (SELECT position, entry, list(x ORDER BY i) AS c FROM m{r} GROUP BY position, entry) AS l ON l.position = c.position AND l.entry = c.entry)"""
_ROUNDS = ",\n".join(f"{_ASSIGN.format(r=r)},\n{_UPDATE.format(r=r, n=r + 1)}" for r in range(4))

OP12 = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT rid, vec_id, k AS position, x[1 + k * len(x) // 4:(k + 1) * len(x) // 4] AS part FROM v, unnest(range(4)) AS t(k)),
first AS (SELECT rid, row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS entry FROM v QUALIFY entry < 256),
c0 AS MATERIALIZED (SELECT position, entry, part AS c FROM p JOIN first USING (rid)),
{_ROUNDS},
{_ASSIGN.format(r=4)},
coded AS (SELECT rid, string_agg(lpad(to_hex(entry), 2, '0'), '' ORDER BY position) AS code, CAST(sum(d) AS BIGINT) AS error FROM a4 GROUP BY rid),
books AS (SELECT sha256(array_to_string(flatten(list(c ORDER BY position, entry)), ',')) AS codebooks_sha256 FROM c4)
SELECT vec_id, lower(code) AS code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM v JOIN coded USING (rid), books
"""

OP13 = f"""
WITH d AS (SELECT doc_id, {_lowered('text')} AS t FROM documents),
h AS (SELECT doc_id, t, sha256(t) AS text_sha256 FROM d)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256 FROM h
"""
