"""DuckDB SQL for the operators that SQL can express."""

# exact top-k: all pairs of a query and another vector
_OP5 = """
WITH usable AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
FROM scored WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
"""

# classes of texts with the same n-gram set or a similarity of 0.8 or more; 5 * overlap >= 4 * union
_OP2 = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT DISTINCT rid, unnest(CASE WHEN len(w) >= 5
      THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS g
  FROM words WHERE len(w) > 0
), sizes AS (SELECT rid, count(*) AS n FROM grams GROUP BY rid),
numbered AS (SELECT rid, dense_rank() OVER (ORDER BY g) AS g FROM grams),
shared AS (SELECT a.rid AS a, b.rid AS b, count(*) AS common FROM numbered a JOIN numbered b ON a.g = b.g AND a.rid <> b.rid GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.rid = a JOIN sizes y ON y.rid = b WHERE 5 * common >= 4 * (x.n + y.n - common)
), reach AS (
  SELECT rid AS a, rid AS b FROM words
  UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
)
SELECT w.doc_id, (SELECT min(o.doc_id) FROM reach JOIN words o ON o.rid = reach.b WHERE reach.a = w.rid) AS class_id,
       (SELECT count(*) FROM links WHERE links.a = w.rid) AS n_links
FROM words w
"""

# which words are covered by a window that occurs at more than one place
_OP10 = r"""
WITH words AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT rid, unnest(range(1, len(w) - 33)) AS place, unnest(list_transform(range(1, len(w) - 33), lambda i: md5(array_to_string(w[i:i + 34], ' ')))) AS h
  FROM words WHERE len(w) >= 35
), repeated AS (
  SELECT rid, place FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)
), covered AS (SELECT DISTINCT rid, place + unnest(range(35)) AS place FROM repeated),
gone AS (SELECT rid, list(place) AS places, count(*) AS n FROM covered GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(places, i)) END, ' ')) AS kept_sha256
FROM words LEFT JOIN gone USING (rid)
"""



def _op11(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """Lloyd's rounds over the parts, one common table expression a step."""
    first = f"""
rows AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * x::DOUBLE) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT rid, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS x FROM rows, range({parts}) t(p)
), seeds AS (SELECT rid, row_number() OVER (ORDER BY vec_id, v) - 1 AS entry FROM rows QUALIFY entry < {entries}),
book0 AS MATERIALIZED (SELECT p, entry, x AS c FROM parts JOIN seeds USING (rid))"""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
near{r} AS MATERIALIZED (
  SELECT rid, p, min(struct_pack(d := d, entry := entry)) AS best FROM (
    SELECT rid, p, entry, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM parts JOIN book{r} USING (p)) GROUP BY rid, p)""")
        if r < rounds:
            steps.append(f"""
sums{r} AS (
  SELECT p, entry, i, sum(v)::BIGINT AS s, count(*) AS n FROM (
    SELECT p, best.entry AS entry, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM parts JOIN near{r} USING (rid, p)) GROUP BY ALL
), book{r + 1} AS MATERIALIZED (
  SELECT p, entry, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN (
    SELECT p, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM sums{r} GROUP BY ALL) m USING (p, entry))""")
    return "WITH " + ",".join([first, *steps]) + f""",
coded AS (
  SELECT rid, string_agg(format('{{:02x}}', best.entry), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error
  FROM near{rounds} GROUP BY rid),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, entry)) AS h FROM book{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM coded JOIN rows USING (rid), books
"""


# every document's score for every item, all in integers but the weight
_OP12 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents
), totals AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM docs WHERE len(t) > 0),
held AS MATERIALIZED (
  SELECT rid, doc_id, len(t) AS n, unnest(t) AS term FROM docs
), postings AS MATERIALIZED (SELECT rid, doc_id, n, term, count(*) AS tf FROM held GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM postings, totals GROUP BY term
), items AS (SELECT DISTINCT item_id, text FROM benchmark),
asked AS (
  SELECT item_id, text, term, count(*) AS times FROM (
    SELECT item_id, text, unnest(regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM items) GROUP BY ALL
), scored AS (
  SELECT item_id, text, rid, doc_id,
    sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term), totals GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER best AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
WINDOW best AS (PARTITION BY item_id, text ORDER BY score DESC, doc_id)
QUALIFY row_number() OVER best <= 20
"""

# what the records of the pages say when they are read back whole
_OP13 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS h FROM pages
), least AS (SELECT h, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
       CASE WHEN first_id IS NULL OR first_id IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id IS NOT DISTINCT FROM page_id THEN NULL ELSE first_id END AS refers_to
FROM p LEFT JOIN least USING (h)
"""

# spans from the lengths of the matches and of what lies between them, then owners per value over distinct texts
_OP8 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS repo,
         coalesce(split_part(source, '/', 1), '') AS owner FROM documents
), matched AS (
  SELECT rid, 0 AS kind, regexp_extract_all(t, '(?:(?i:password|passwd|secret|token|api_?key))["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)', 0) AS m,
         regexp_extract_all(t, '(?:(?i:password|passwd|secret|token|api_?key))["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)', 1) AS v,
         regexp_split_to_array(t, '(?:(?i:password|passwd|secret|token|api_?key))["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)') AS gaps FROM docs
  UNION ALL SELECT rid, 1, regexp_extract_all(t, 'AKIA[A-Z0-9]{12,}'), regexp_extract_all(t, 'AKIA[A-Z0-9]{12,}'), regexp_split_to_array(t, 'AKIA[A-Z0-9]{12,}') FROM docs
  UNION ALL SELECT rid, 2, regexp_extract_all(t, '[0-9a-f]{32,}'), regexp_extract_all(t, '[0-9a-f]{32,}'), regexp_split_to_array(t, '[0-9a-f]{32,}') FROM docs
  UNION ALL SELECT rid, 3, regexp_extract_all(t, '[A-Za-z0-9+/_-]{20,}'), regexp_extract_all(t, '[A-Za-z0-9+/_-]{20,}'),
         regexp_split_to_array(t, '[A-Za-z0-9+/_-]{20,}') FROM docs
), each AS (
  SELECT rid, kind, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS whole, unnest(v) AS value, unnest(gaps[1:len(m)]) AS gap FROM matched
), placed AS (
  SELECT rid, kind, value, length(whole) AS n, sum(length(gap) + length(whole)) OVER (PARTITION BY rid, kind ORDER BY i) AS stop FROM each
), kept AS (
  SELECT rid, kind, value, stop - n AS start, stop FROM placed
  WHERE CASE kind WHEN 0 THEN length(value) >= 8
        WHEN 3 THEN regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[0-9]') ELSE TRUE END
), free AS (
  SELECT * FROM kept k WHERE kind < 3 OR NOT EXISTS (
    SELECT 1 FROM kept o WHERE o.rid = k.rid AND o.kind < 3 AND o.start < k.stop AND k.start < o.stop)
), owners AS (
  SELECT value, count(DISTINCT first_owner) AS independent FROM (
    SELECT value, t, min(owner) AS first_owner FROM free JOIN docs USING (rid) GROUP BY value, t) GROUP BY value
), told AS (
  SELECT rid, kind, start, independent < 3 AS live, ['assign', 'access', 'hex', 'token'][kind + 1] || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT) AS span
  FROM free JOIN owners USING (value) WHERE kind < 3 OR independent < 3
), spans AS (
  SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         coalesce(string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3), '') AS base, string_agg(span, ',' ORDER BY start, kind) AS spans,
         count(*) FILTER (live) AS n_live FROM told GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM docs LEFT JOIN spans USING (rid)
"""

ORACLES = {"op2_ngram_jaccard_join": _OP2, "op5_exact_topk": _OP5, "op8_secrets": _OP8, "op10_substring_dedup": _OP10,
           "op11_vector_codes": _op11(), "op12_lexical_search": _OP12, "op13_warc_salvage": _OP13}
