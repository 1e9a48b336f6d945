"""DuckDB SQL for the corpus queries that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"

OP3 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + 9], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)
),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
runs AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM pos, (SELECT DISTINCT n FROM win) WHERE i + n - 1 <= len(w)
),
hit AS (SELECT r.doc_id, r.i, r.n, win.item_id FROM runs r JOIN win ON r.s = win.s AND r.n = win.n),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY 1
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP5 = """
WITH RECURSIVE d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
win AS (
  SELECT doc_id, k, i, array_to_string(l[i:i + k - 1], chr(10)) AS s
  FROM (SELECT doc_id, l, k, unnest(range(1, len(l) - k + 2)) AS i FROM d, range(1, 5) t(k) WHERE len(l) >= k)
),
chosen AS (SELECT * FROM win WHERE k = 4 OR len(regexp_extract_all(s, '[^\\x20\\x09-\\x0D]+')) >= 50),
place AS (SELECT doc_id, k, i, row_number() OVER w AS nth, first_value(doc_id) OVER w AS doc_1, first_value(i) OVER w AS i_1 FROM chosen WINDOW w AS (PARTITION BY k, s ORDER BY doc_id, i)),
later AS (SELECT doc_id, CASE WHEN doc_1 = doc_id THEN greatest(i, i_1 + k) ELSE i END AS a, i + k AS b FROM place WHERE nth > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS g FROM (SELECT doc_id, unnest(range(a, b)) AS p FROM later) GROUP BY 1),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY p) AS text FROM (
    SELECT d.doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS p, coalesce(g, []) AS g FROM d LEFT JOIN gone USING (doc_id)
  ) WHERE NOT list_contains(g, p) GROUP BY 1
),
one AS (SELECT doc_id, i, dense_rank() OVER (ORDER BY s) AS r, count(*) OVER (PARTITION BY s) AS n FROM win WHERE k = 1),
run AS (
  SELECT doc_id, i, r, CAST(1 AS BIGINT) AS depth FROM one WHERE n > 1
  UNION ALL
  SELECT doc_id, i, dense_rank() OVER (ORDER BY r, nxt) AS r, depth + 1 AS depth FROM (
    SELECT *, count(*) OVER (PARTITION BY r, nxt) AS n FROM (
      SELECT doc_id, i, r, depth, lead(r) OVER w AS nxt, lead(i) OVER w AS j FROM run WINDOW w AS (PARTITION BY doc_id ORDER BY i)
    ) WHERE j = i + 1
  ) WHERE n > 1
),
deepest AS (SELECT doc_id, CAST(2 ** floor(log2(max(depth))) AS BIGINT) AS repeat_depth FROM run GROUP BY 1)
SELECT d.doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed, coalesce(repeat_depth, 0) AS repeat_depth, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id) LEFT JOIN deepest USING (doc_id)
"""

OP8 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
starts AS (
  SELECT doc_id, i, md5(substr(x, 2 * i + 1, 800)) AS h
  FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 399)) AS i FROM d WHERE len(x) >= 800)
),
twice AS (SELECT doc_id, i FROM starts WHERE h IN (SELECT h FROM starts GROUP BY h HAVING count(*) > 1)),
marked AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS fresh FROM twice),
runs AS (
  SELECT doc_id, min(i) AS a, max(i) + 400 AS b
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM marked) GROUP BY doc_id, k
),
gaps AS (
  SELECT doc_id, coalesce(lag(b) OVER w, 0) AS a, a AS b FROM runs WINDOW w AS (PARTITION BY doc_id ORDER BY a)
  UNION ALL SELECT doc_id, coalesce(max(b), 0), any_value(len(x)) // 2 FROM d LEFT JOIN runs USING (doc_id) GROUP BY doc_id
),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * a + 1, 2 * (b - a)), '' ORDER BY a, b) AS k FROM gaps JOIN d USING (doc_id) GROUP BY 1),
sums AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM runs GROUP BY 1)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
  coalesce(spans, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)
"""

_SUM = "list_reduce(list_transform(range(1, len({a}) + 1), lambda k: {a}[k] * {b}[k]), lambda s, y: s + y)"
_DOT, _NORM_Q, _NORM_C = (_SUM.format(a=a, b=b) for a, b in (("q.v", "c.v"), ("q.v", "q.v"), ("c.v", "c.v")))
OP9 = f"""
WITH e AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, {_DOT} / (sqrt({_NORM_Q}) * sqrt({_NORM_C})) AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

OP10 = """
WITH r AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    md5('7:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS key
  FROM documents
),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM r GROUP BY source),
w AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight FROM s),
v AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER f, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS level
  FROM w WINDOW f AS (ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
m AS (SELECT *, max(CASE WHEN level * weight < 2 * source_size THEN level END) OVER () AS last FROM v),
t AS (SELECT source, source_size, CAST(CASE WHEN level * weight >= 2 * source_size THEN 2.0 * source_size ELSE last * weight END AS DOUBLE) AS target FROM m),
g AS (
  SELECT r.*, source_size, target, CAST(round(target) AS BIGINT) AS budget,
    coalesce(sum(size) OVER (PARTITION BY r.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source
),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM g)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - ahead)) AS BIGINT) AS taken
FROM e
"""

OP11 = """
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x, string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') AS s FROM documents
),
w AS (SELECT doc_id, part, x, list_filter(s, lambda y: y <> '') AS w, min(doc_id) OVER (PARTITION BY x) AS first FROM t),
f AS (
  SELECT doc_id, part, len(w) < 100 AS fa, 100 * len(list_distinct(w)) < 80 * len(w) AS fb, 100 * len(regexp_replace(x, '[^A-Z]', '', 'g')) > 10 * len(x) AS fc,
    regexp_matches(x, '[#$%&*|]') AS fd, coalesce(doc_id > first, false) AS fe FROM w
),
m AS (
  SELECT part, fa::INT + 2 * fb::INT + 4 * fc::INT + 8 * fd::INT + 16 * fe::INT AS mask, count(*) AS n,
    count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS good, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS toxic
  FROM f GROUP BY ALL
),
l AS (SELECT i, substr('ABCDE', i + 1, 1) AS c FROM range(5) t(i)),
o AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS seq FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
),
s AS (
  SELECT filter_order, CAST(k AS INTEGER) AS step, CAST(1 << seq[k] AS INTEGER) AS bit, CAST(coalesce(list_sum(list_transform(seq[1:k - 1], lambda i: 1 << i)), 0) AS INTEGER) AS before
  FROM o, range(1, 6) r(k)
),
g AS (
  SELECT part, filter_order, step, bit, CAST(coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS BIGINT) AS toxic_lost
  FROM m, s GROUP BY ALL
)
SELECT * EXCLUDE (bit), CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM g
"""

_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
OP12 = f"""
WITH i AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE item_id IS NOT NULL),
d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
c AS (SELECT CAST(count(*) FILTER (len(w) > 0) AS BIGINT) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d),
p AS (
  SELECT r, doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT r, doc_id, unnest(w) AS term, CAST(len(w) AS BIGINT) AS n FROM d)
  WHERE term IN (SELECT term FROM i) GROUP BY r, doc_id, term
),
w AS (SELECT term, CAST(floor(1000 * ln((2 * c.n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight FROM p, c GROUP BY term, c.n),
s AS (
  SELECT item_id, r, any_value(doc_id) AS doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * p.n * c.n) // c.l)))) AS BIGINT) AS score
  FROM p JOIN w USING (term) JOIN i USING (term), c GROUP BY item_id, r
),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM k WHERE rank <= 50
"""

OP13 = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""

ORACLES = {"op3_decontaminate": OP3, "op5_lines": OP5, "op8_repeats": OP8, "op9_nearest": OP9, "op10_mixing": OP10, "op11_audit": OP11, "op12_search": OP12, "op13_exact": OP13}
