"""DuckDB SQL for the queries that SQL can express on whole tables.

The SQL is written from the contracts, not from the operators: joins of all
pairs, windows counted from scratch, no index and no signature.
"""

from __future__ import annotations

from veritable.llm import secret_scan

ORACLE: dict[str, str] = {}

_VECTORS = """
ok AS (SELECT DISTINCT vec_id, {value} AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 {more})"""

ORACLE["op2_exact_top_k"] = f"""
WITH {_VECTORS.format(value="list_transform(embedding, lambda x: floor(256 * x::DOUBLE))", more="")},
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM ok q JOIN ok c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, r::INTEGER AS rank, vec_id, score FROM ranked WHERE r <= 5
"""

ORACLE["op7_nearest_neighbours"] = f"""
WITH {_VECTORS.format(value="embedding::DOUBLE[]", more="AND len(list_filter(embedding, lambda x: x <> 0)) > 0")},
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i])),
                                                      lambda a, b: a + b)) AS score
  FROM ok q JOIN ok c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS r FROM scored)
SELECT query_id, r::INTEGER AS rank, vec_id, score FROM ranked WHERE r <= 10
"""

ORACLE["op9_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 85 * (nx.n + ny.n - i)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(a, b) AS (SELECT x, y FROM edges UNION SELECT r.a, e.y FROM reach r JOIN edges e ON e.x = r.b),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(low.m, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.a = d.doc_id
"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _matches(name: str, pattern: str) -> str:
    """(doc_id, hit, pos): every match with its place, from the lengths of the gaps and matches before it."""
    p = _quoted(pattern)
    return f"""{name} AS (
  SELECT doc_id, hits[i] AS hit,
         list_sum(list_transform(gaps[1:i], lambda g: length(g)))::BIGINT + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0)::BIGINT AS pos
  FROM (SELECT doc_id, gaps, hits, unnest(range(1, len(hits) + 1)) AS i
        FROM (SELECT doc_id, string_split_regex(text, {p}) AS gaps, regexp_extract_all(text, {p}) AS hits FROM d)))"""


def _secrets() -> str:
    base = []
    for rank, (kind, pattern, group, least) in enumerate(secret_scan.KINDS):
        measured = f"regexp_extract(hit, {_quoted(pattern)}, {group})"
        base.append(f"SELECT doc_id, pos, {rank} AS rank, '{kind}' AS kind, pos + length(hit) AS stop FROM m_{kind} WHERE length({measured}) >= {least}")
    found = ",\n".join(_matches(f"m_{kind}", pattern) for kind, pattern, _, _ in secret_scan.KINDS)
    size = secret_scan.WINDOW
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
{found},
base AS ({" UNION ALL ".join(base)}),
{_matches("runs", "[A-Za-z0-9+/_=-]{" + str(size) + ",}")},
windows AS (
  SELECT doc_id, pos, i, hit[i + 1:i + {size}] AS w
  FROM (SELECT doc_id, pos, hit, unnest(range(0, length(hit) - {size - 1})) AS i FROM runs
        WHERE regexp_matches(hit, '[0-9]') AND NOT regexp_matches(hit, {_quoted(secret_scan.ALLOW)}))),
counted AS (
  SELECT *, length(regexp_replace(w, '[^0-9]', '', 'g')) AS digits,
         -list_sum(list_transform(list_distinct(string_split(w, '')), lambda c: (length(w) - length(replace(w, c, ''))) / {size}.0
                                  * log2((length(w) - length(replace(w, c, ''))) / {size}.0))) AS bits FROM windows),
high AS (
  SELECT doc_id, pos, i FROM counted WHERE digits > 0 AND digits < {size}
    AND bits >= CASE WHEN regexp_full_match(w, '[0-9a-fA-F]+') THEN {secret_scan.HEX_BITS} ELSE {secret_scan.WORD_BITS} END),
islands AS (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id, pos ORDER BY i) AS island
  FROM (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id, pos ORDER BY i) + {size} THEN 0 ELSE 1 END AS fresh FROM high)),
entropy AS (
  SELECT doc_id, pos + min(i) AS start, pos + max(i) + {size} AS stop FROM islands GROUP BY doc_id, pos, island),
spans AS (
  SELECT doc_id, pos, rank, kind, stop, true AS base FROM base
  UNION ALL SELECT doc_id, start, {len(secret_scan.KINDS)}, 'entropy', stop, false FROM entropy e
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = e.doc_id AND b.pos <= e.start AND b.stop >= e.stop)),
per AS (
  SELECT doc_id, string_agg(kind || ':' || pos || ':' || stop, ',' ORDER BY pos, rank) AS spans,
         string_agg(kind || ':' || pos || ':' || stop, ',' ORDER BY pos, rank) FILTER (WHERE base) AS base_spans,
         {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in [*(k for k, *_ in secret_scan.KINDS), "entropy"])}
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in [*(k for k, *_ in secret_scan.KINDS), "entropy"])},
       sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (doc_id)
"""


ORACLE["op10_secret_scan"] = _secrets()

ORACLE["op12_hard_negatives"] = f"""
WITH {_VECTORS.format(value="list_transform(embedding, lambda x: floor(256 * x::DOUBLE))", more="AND label IS NOT NULL").replace(
    "DISTINCT vec_id,", "DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,")},
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score
  FROM ok a JOIN ok c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id AND len(c.v) = len(a.v)),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
windows AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS r
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
   AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score)
SELECT anchor_id, positive_id, r::INTEGER AS rank, negative_id, positive_score, negative_score FROM windows WHERE r <= 5
"""

ORACLE["op13_decontamination"] = r"""
WITH d AS (SELECT row_number() OVER () AS place, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
w AS (SELECT DISTINCT item_id, least(10, len(ws)) AS size, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS run
      FROM (SELECT *, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
runs AS (SELECT place, size, i, array_to_string(ws[i:i + size - 1], ' ') AS run
         FROM (SELECT place, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM w) WHERE len(ws) >= size)),
hits AS (SELECT r.place, r.i, r.size, w.item_id FROM runs r JOIN w USING (size, run)),
places AS (SELECT place, count(DISTINCT spot) AS n_hit FROM (SELECT place, unnest(range(i, i + size)) AS spot FROM (SELECT DISTINCT place, i, size FROM hits)) GROUP BY place),
listed AS (SELECT place, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
           FROM (SELECT DISTINCT place, item_id::VARCHAR AS item FROM hits) GROUP BY place)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN places USING (place) LEFT JOIN listed USING (place)
"""

#: The driver's pages mark their article and use no character references in it but these.
ORACLE["op6_html_main_text"] = r"""
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM (
  SELECT page_id, url, array_to_string(list_filter(list_transform(
    string_split_regex(regexp_extract(html, '(?s)<article>(.*?)(?:</article>|$)', 1), '</?(?:p|h1)>'),
    lambda b: trim(regexp_replace(replace(replace(replace(replace(replace(
           regexp_replace(replace(b, '<br>', ' '), '<[^>]*>', '', 'g'),
           '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))),
    lambda x: x <> ''), chr(10)) AS text FROM pages)
"""
