"""DuckDB SQL for the queries that SQL can express."""

from .kd_search import K
from .mixing import EPOCHS, SEED
from .ngram_join import N, THRESHOLD
from .resharding import EXTRA_SHARDS, SLACK_PERCENT
from .suffix_dedup import LEAST
from .textnp import SEPARATORS

WORDS = rf"list_filter(string_split_regex(lower(text), '{SEPARATORS}'), lambda x: x <> '')"

NGRAM_SETS = f"""
split AS (SELECT doc_id, text, {WORDS} AS ws FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) < {N} THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - {N - 2}), lambda i: array_to_string(ws[i:i + {N - 1}], ' ')) END)) AS grams
  FROM split WHERE len(ws) > 0),
classes AS (SELECT row_number() OVER (ORDER BY min(doc_id), len(grams), grams) AS c, list_sort(list(doc_id)) AS docs, grams, len(grams)::INT AS n FROM sets GROUP BY grams),
each AS (SELECT c, n, unnest(grams) AS g FROM classes),
pairs AS (
  SELECT a.c AS ca, b.c AS cb, count(*)::INT AS common FROM each a JOIN each b ON a.g = b.g AND a.c < b.c
  WHERE least(a.n, b.n) >= {THRESHOLD} * greatest(a.n, b.n) - 1e-9
  GROUP BY a.c, b.c, a.n, b.n HAVING count(*) >= {THRESHOLD} * (a.n + b.n - count(*)) - 1e-9)
"""

NGRAM_JOIN = f"""
WITH RECURSIVE {NGRAM_SETS},
edges AS (SELECT ca AS x, cb AS y FROM pairs UNION ALL SELECT cb, ca FROM pairs),
reach AS (SELECT DISTINCT x, x AS y FROM edges UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x),
least AS (SELECT x AS c, min(docs[1]) AS class_id FROM reach JOIN classes ON classes.c = y GROUP BY x),
links AS (SELECT x AS c, count(*) AS n_links FROM edges GROUP BY x),
found AS (SELECT unnest(docs) AS doc_id, len(docs) AS n_copies, coalesce(class_id, docs[1]) AS class_id, coalesce(n_links, 0) AS n_links FROM classes LEFT JOIN least USING (c) LEFT JOIN links USING (c))
SELECT doc_id, class_id, n_copies::BIGINT AS n_copies, n_links::BIGINT AS n_links FROM found
UNION ALL
SELECT doc_id, NULL, 0, 0 FROM (SELECT doc_id, {WORDS} AS ws FROM documents) WHERE doc_id IS NULL OR ws IS NULL OR len(ws) = 0
"""

#: Stays are the least-cost optimum, min(size, capacity); what is moved is dealt out in shard order.
RESHARDING = f"""
WITH base AS (SELECT doc_id, text, coalesce(strlen(text), 0) AS one, coalesce(source, '') AS old_shard, count(*) AS copies FROM documents GROUP BY ALL),
ordered AS (SELECT *, coalesce(sum(one * copies) OVER (PARTITION BY old_shard ORDER BY doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM base),
old AS (SELECT old_shard AS name, sum(one * copies) AS size FROM base GROUP BY 1),
room AS (SELECT ((sum(size) * {100 + SLACK_PERCENT}) + 100 * (count(*) + {EXTRA_SHARDS}) - 1) // (100 * (count(*) + {EXTRA_SHARDS})) AS each FROM old),
news AS (SELECT name, 0 AS late, size FROM old UNION ALL SELECT 'new' || j, 1, 0 FROM range({EXTRA_SHARDS}) r(j)),
stay AS (SELECT name, late, size, least(size, each) AS stays, size - least(size, each) AS more, each - least(size, each) AS free FROM news, room),
sends AS (SELECT name, stays, more, sum(more) OVER (ORDER BY name) - more AS s0 FROM stay WHERE late = 0),
gets AS (SELECT name, free, sum(free) OVER (ORDER BY late, name) - free AS g0 FROM stay),
flows AS (
  SELECT s.name AS a, g.name AS b, stays + greatest(s0, g0) - s0 AS f0 FROM sends s JOIN gets g ON more > 0 AND free > 0 AND s0 < g0 + free AND g0 < s0 + more
  UNION ALL SELECT name, name, 0 FROM stay WHERE late = 0 AND (stays > 0 OR size = 0)),
found AS (SELECT o.doc_id, one, copies, old_shard, arg_max(b, f0) AS new_shard FROM ordered o JOIN flows ON old_shard = a AND f0 <= before GROUP BY o.doc_id, o.text, one, copies, old_shard)
SELECT doc_id, one::BIGINT AS n_bytes, old_shard, new_shard, new_shard <> old_shard AS moved FROM found, range(copies)
"""

MIXING = rf"""
WITH base AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\x0B\f]+')) AS tokens, md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS lot FROM documents),
placed AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY lot) - tokens AS before FROM base),
supply AS (SELECT source, sum(tokens) AS n FROM base GROUP BY source),
weights AS (
  SELECT source, n::HUGEINT AS n, CASE WHEN n > 0 THEN round_even(n / (SELECT sum(n) FROM supply) * 1000000, 0)::HUGEINT ELSE 0 END AS b,
    CASE WHEN n > 0 THEN round_even(pow(n / (SELECT sum(n) FROM supply), 0.5) * 1000000, 0)::HUGEINT ELSE 0 END AS e FROM supply),
run AS (SELECT floor(sum(n) * {EPOCHS}::DOUBLE)::HUGEINT AS span, sum(b + e)::HUGEINT AS whole FROM weights),
demands AS (SELECT w.*, span, (span * (b + e)) // whole AS demand FROM weights w, run),
used AS (
  SELECT doc_id, p.source, tokens, before, n, b::DOUBLE AS b, e::DOUBLE AS e, span, demand, unnest(range(0, 1 + greatest(0, CASE WHEN n > 0 THEN floor((demand - 1 - before) / n)::BIGINT ELSE 0 END))) AS pass
  FROM placed p JOIN demands d ON p.source IS NOT DISTINCT FROM d.source WHERE before < demand OR n = 0),
due AS (SELECT *, (before + pass * n)::DOUBLE / greatest(demand, 1)::DOUBLE AS share, (b + e) / 2 AS half FROM used),
roots AS (SELECT *, sqrt(greatest(b * b + 2 * (e - b) * half * share, 0)) AS root FROM due)
SELECT doc_id, source, tokens::BIGINT AS tokens, pass::INT AS pass,
  floor(least(1, CASE WHEN b + root > 0 THEN 2 * half * share / (b + root) ELSE 0 END) * span::DOUBLE)::BIGINT AS position
FROM roots
"""

REPEATS = f"""
WITH split AS (SELECT doc_id, {WORDS} AS ws FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)),
starts AS (SELECT doc_id, ws, unnest(range(0, len(ws) - {LEAST - 1})) AS b FROM split WHERE len(ws) >= {LEAST}),
windows AS (SELECT doc_id, b, array_to_string(ws[b + 1:b + {LEAST}], ' ') AS t FROM starts),
ranked AS (SELECT doc_id, b, b + {LEAST} AS e, first_value(doc_id) OVER w AS first_doc, row_number() OVER w AS n FROM windows WINDOW w AS (PARTITION BY t ORDER BY doc_id, b)),
again AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ranked WHERE n > 1),
runs AS (SELECT *, sum(CASE WHEN reach IS NULL OR b > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY b) AS run FROM again)
SELECT doc_id, min(b)::INT AS begin_word, max(e)::INT AS end_word, min(first_doc) AS first_doc FROM runs GROUP BY doc_id, run
"""

TOP_K = f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
d AS (SELECT a.vec_id, b.vec_id AS neighbour, list_sum(list_transform(list_zip(a.e, b.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d2 FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, neighbour)::INT AS rank FROM d)
SELECT vec_id, rank, neighbour, round(sqrt(d2), 6) AS distance FROM ranked WHERE rank <= {K}
"""
