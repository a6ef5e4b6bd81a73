"""The registered queries once more, as SQL over the same tables."""

from __future__ import annotations

from .functions.text import STOP_WORDS, WHITE_SPACE
from .operators.querylog import LATENCY_BOUNDS
from .registry import (
    CLAUSES,
    HYBRID_QUERIES,
    INDEX_CAP,
    KEYWORD_QUERIES,
    PAGE_CAP,
    QUERY_VECTOR_ID,
    ROUTED_QUERIES,
    ROUTING_ENTRIES,
    STAMP,
)


def lit(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def values(rows, columns: str, name: str) -> str:
    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (SELECT * FROM (VALUES {body}))"


WORD = r"[\p{L}\p{M}\p{N}_]+(?:[''’.][\p{L}\p{M}\p{N}_]+)*"
MARKUP = r"''''''|''''|\[\[|\]\]|\{\{|\}\}|\[|\]"
STOPS = ", ".join(lit(w) for w in STOP_WORDS)
SPACE = lit(WHITE_SPACE)


def flat(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '{MARKUP}', '', 'g'), '[ \\n\\t]+', ' ', 'g')"


def clean(text: str, cut: bool) -> str:
    inner = f"substr({flat(text)}, 1, 2000)" if cut else flat(text)
    return f"trim({inner}, {SPACE})"


def shard(doc_id: str, n: int = 8) -> str:
    return f"(('0x' || substr(md5({doc_id}), 1, 2))::INT % {n})::BIGINT"


CORPUS = f"""
bodies AS (
  SELECT doc_id, lang, 'wiki_' || doc_id AS id, split_part(text, chr(10), 1) AS title, {clean('text', False)} AS body
  FROM documents),
corpus AS (
  SELECT b.doc_id, b.lang, b.id, b.title, b.body, e.embedding::DOUBLE[] AS title_vector, {shard('b.id')} AS shard,
    TIMESTAMP '{STAMP}' + to_hours((b.doc_id % 200)::INT) AS indexed_at
  FROM bodies b LEFT JOIN embeddings e ON e.vec_id = b.doc_id
  WHERE strlen(b.body) >= 50)"""


def tokens(source: str = "corpus", name: str = "tokens", fields=("id", "title", "body")) -> str:
    parts = [
        f"""SELECT id, shard, '{f}' AS field, unnest(w) AS term, unnest(range(len(w))) AS pos
        FROM (SELECT id, shard, regexp_extract_all(lower({f}), '{WORD}') AS w FROM {source})"""
        for f in fields
    ]
    return f"{name} AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE term NOT IN ({STOPS}))"


TOKENS = f"{CORPUS},\n{tokens()}"


def score_tables(model: str = "bm25", scope: str = "shard") -> str:
    """term_scores(field, shard, id, term, score) for every posting of every field."""
    n = "(SELECT shard, count(*) AS n FROM corpus GROUP BY shard)"
    df_key = "field, term, shard" if scope == "shard" else "field, term"
    if scope == "global":
        totals = "SELECT l.field, n.shard, (SELECT count(*) FROM corpus) AS n, (sum(sum(l.dl)) OVER (PARTITION BY l.field)) / (SELECT count(*) FROM corpus) AS avgdl FROM lens l JOIN {n} n USING (shard) GROUP BY l.field, n.shard, n.n"
    else:
        totals = "SELECT l.field, n.shard, n.n, sum(l.dl) / n.n AS avgdl FROM lens l JOIN {n} n USING (shard) GROUP BY l.field, n.shard, n.n"
    idf = "ln(1 + (t.n - d.df + 0.5) / (d.df + 0.5))" if model == "bm25" else "(1 + ln(t.n / (d.df + 1)))"
    part = (
        "(p.tf * 2.2) / (p.tf + 1.2 * (1 - 0.75 + 0.75 * l.dl / t.avgdl))" if model == "bm25" else "sqrt(p.tf) / sqrt(l.dl)"
    )
    return f"""{TOKENS},
spread AS (SELECT id, shard, field, term FROM tokens UNION ALL SELECT id, shard, '_all', term FROM tokens),
post AS (SELECT field, shard, id, term, count(*) AS tf FROM spread GROUP BY ALL),
lens AS (SELECT field, shard, id, count(*) AS dl FROM spread GROUP BY ALL),
dfs AS (SELECT {df_key}, count(*) AS df FROM post GROUP BY ALL),
totals AS ({totals.format(n=n)}),
term_scores AS (
  SELECT p.field, p.shard, p.id, p.term, {idf}::DOUBLE * {part} AS score
  FROM post p JOIN lens l USING (field, shard, id) JOIN dfs d USING ({df_key}) JOIN totals t ON t.field = p.field AND t.shard = p.shard)"""


def query_hits(rows, routed: bool = False, **how) -> str:
    """asked(query_id, q, lim) and hits(query_id, shard, id, score)."""
    fixed = [(q[0], q[1], q[2] if q[2] and q[2] > 0 else 20) for q in rows]
    terms = f"""
asked_terms AS (
  SELECT query_id, term, count(*) AS weight
  FROM (SELECT query_id, unnest(regexp_extract_all(lower(q), '{WORD}')) AS term FROM asked)
  WHERE term NOT IN ({STOPS}) GROUP BY ALL)"""
    where = ""
    route = ""
    if routed:
        route = "," + ROUTES
        where = "JOIN routes r ON r.query_id = a.query_id AND list_contains(r.route, s.shard)"
    return f"""{score_tables(**how)},
{values(fixed, 'query_id, q, lim', 'asked')}{route},{terms},
hits AS (
  SELECT a.query_id, s.shard, s.id, round(sum(a.weight * s.score), 6) AS score
  FROM asked_terms a JOIN term_scores s ON s.term = a.term AND s.field = '_all' {where}
  GROUP BY ALL)"""


ROUTES = f"""
{values(ROUTING_ENTRIES, 'key, value', 'kv')},
lists AS (
  SELECT key, list_filter(list_transform(string_split(value, ','), lambda x: CASE WHEN regexp_matches(trim(x), '^[+-]?[0-9]+$') THEN trim(x)::INT END),
    lambda x: x IS NOT NULL) AS ids FROM kv),
routes AS (
  SELECT query_id, q, CASE WHEN len(ids) > 0 THEN 'hot' ELSE 'cold' END AS routing_type,
    CASE WHEN len(ids) > 0 THEN list_filter(ids, lambda x: x BETWEEN 0 AND 7) ELSE range(8) END AS route
  FROM asked LEFT JOIN lists ON key = '/hot_terms/' || q || '/shards')"""

TOP = """
top AS (
  SELECT * FROM (SELECT h.*, a.lim, row_number() OVER (PARTITION BY h.query_id ORDER BY h.score DESC, h.id) AS rank
    FROM hits h JOIN asked a USING (query_id)) WHERE rank <= lim)"""
CANDIDATES = """
candidates AS (
  SELECT * FROM (SELECT h.*, a.lim, row_number() OVER (PARTITION BY h.query_id, h.shard ORDER BY h.score DESC, h.id) AS shard_rank
    FROM hits h JOIN asked a USING (query_id)) WHERE shard_rank <= 3 * lim)"""
RANKED = "SELECT query_id, rank, id, score, shard FROM top"


def bag_vectors(dim: int) -> str:
    """digests(k1, k2, dims, square, ramp, steep) of the hashed bag of words of texts(k1, k2, text)."""
    return f"""
bags AS (
  SELECT k1, k2, h % {dim} AS place, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS signed, count(*) AS plain
  FROM (SELECT k1, k2, ('0x' || substr(md5(unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'))), 1, 8))::BIGINT AS h
    FROM texts) GROUP BY ALL),
counted AS (
  SELECT k1, k2, place, CASE WHEN max(abs(signed)) OVER (PARTITION BY k1, k2) > 0 THEN signed ELSE plain END::DOUBLE AS x FROM bags),
sums AS (
  SELECT k1, k2, sum(x * x) AS square, sum(x * (place + 1)) AS ramp, sum(x * (place + 1) * (place + 1)) AS steep
  FROM counted GROUP BY ALL),
digests AS (
  SELECT t.k1, t.k2, CASE WHEN square IS NULL THEN 0 ELSE {dim} END::BIGINT AS dims, round(square / square, 5) AS square,
    round(ramp / sqrt(square), 5) AS ramp, round(steep / sqrt(square), 5) AS steep
  FROM texts t LEFT JOIN sums USING (k1, k2))"""


def one_byte(term: str) -> str:
    """The SQL engine counts edits in bytes, we in characters: give each accented letter one byte of its own.

    Terms are lower-case, so upper-case letters are free to stand for the eleven that occur.
    """
    return f"translate({term}, 'ßäçèéêíñóöü', 'ABCDEFGHIJK')"


def clause_hits(key: str) -> str:
    """Hits of a clause table; a clause matches whatever its term test says."""
    return f"""WITH {score_tables()},
{values(CLAUSES[key], 'query_id, clause_no, occur, kind, field, value, boost', 'clauses')},
found AS (
  SELECT c.query_id, c.clause_no, c.occur, s.shard, s.id, sum(c.boost * s.score) AS score
  FROM clauses c JOIN term_scores s ON s.field = c.field AND CASE c.kind
    WHEN 'match' THEN list_contains(regexp_extract_all(lower(c.value), '{WORD}'), s.term)
    WHEN 'prefix' THEN starts_with(s.term, replace(c.value, '*', ''))
    WHEN 'wildcard' THEN regexp_full_match(s.term, replace(replace(c.value, '*', '.*'), '?', '.'))
    WHEN 'regexp' THEN regexp_full_match(s.term, c.value)
    WHEN 'fuzzy' THEN levenshtein({one_byte('s.term')}, {one_byte("split_part(c.value, '~', 1)")}) <= split_part(c.value, '~', 2)::INT
    ELSE false END
  GROUP BY ALL),
matched AS (
  SELECT f.query_id, f.id, round(sum(f.score) FILTER (f.occur <> 'must_not'), 6) AS score,
    count(*) FILTER (f.occur = 'must') AS musts, count(*) FILTER (f.occur = 'must_not') AS nots,
    count(*) FILTER (f.occur <> 'must_not') AS positives
  FROM found f GROUP BY ALL),
needed AS (SELECT query_id, count(*) FILTER (occur = 'must' AND kind <> 'range') AS musts FROM clauses GROUP BY ALL),
hits AS (
  SELECT m.query_id, m.id, m.score FROM matched m JOIN needed n USING (query_id)
  WHERE m.musts = n.musts AND m.nots = 0 AND m.positives > 0)"""


PHRASE = f"""WITH {score_tables()},
starts AS (
  SELECT 7 AS query_id, a.id FROM tokens a JOIN tokens b ON a.id = b.id AND a.field = 'body' AND b.field = 'body'
    AND a.term = 'anea' AND b.term = 'eriner' AND b.pos = a.pos + 1 GROUP BY ALL
  UNION ALL SELECT 71, id FROM tokens WHERE term = 'thing' GROUP BY ALL),
wanted(query_id, field, term) AS (VALUES (7, 'body', 'anea'), (7, 'body', 'eriner'), (71, '_all', 'thing'))
SELECT s.query_id, s.id, round(sum(t.score), 6) AS score
FROM starts s JOIN wanted w USING (query_id) JOIN term_scores t ON t.id = s.id AND t.field = w.field AND t.term = w.term
GROUP BY ALL"""

SIZED = "(SELECT c.*, d.n_chars FROM corpus c JOIN documents d USING (doc_id))"

RANGE = f"""{clause_hits('range_match')}
SELECT h.query_id, h.id, h.score FROM hits h JOIN {SIZED} c USING (id)
WHERE CASE h.query_id
  WHEN 18 THEN c.indexed_at >= TIMESTAMP '2024-01-02 00:00:00' AND NOT c.indexed_at > TIMESTAMP '2024-01-06 12:00:00'
  WHEN 181 THEN c.n_chars >= 500 AND c.n_chars < 1500.5 ELSE true END
UNION ALL SELECT 182, id, 0.0::DOUBLE FROM {SIZED} WHERE n_chars < 200 OR indexed_at >= TIMESTAMP '2024-01-08 00:00:00'
UNION ALL SELECT 183, id, 0.0::DOUBLE FROM {SIZED}
WHERE n_chars > 3000 AND id NOT IN (SELECT id FROM tokens WHERE term = 'thing')
UNION ALL SELECT 20, id, 0.0::DOUBLE FROM corpus
WHERE indexed_at >= TIMESTAMP '2024-01-03 00:00:00' AND indexed_at < TIMESTAMP '2024-01-05 00:00:00'"""

HYBRID_FIXED = [
    (q[0], q[1], q[2] or 10, q[3] or 0.7, q[4] or "rrf", q[5]) for q in HYBRID_QUERIES
]


def hybrid(routed: bool) -> str:
    """fused(query_id, rank, ...) over all hybrid queries."""
    join = "JOIN routes r ON r.query_id = a.query_id AND list_contains(r.route, s.shard)" if routed else ""
    routes = "," + ROUTES if routed else ""
    return f"""WITH {score_tables()},
{values(HYBRID_FIXED, 'query_id, q, lim, alpha, fusion, with_vector', 'asked')}{routes},
asked_terms AS (
  SELECT query_id, term, count(*) AS weight
  FROM (SELECT query_id, unnest(regexp_extract_all(lower(q), '{WORD}')) AS term FROM asked) GROUP BY ALL),
hits AS (
  SELECT a.query_id, s.shard, s.id, round(sum(a.weight * s.score), 6) AS score
  FROM asked_terms a JOIN term_scores s ON s.term = a.term AND s.field = '_all' {join} GROUP BY ALL),
cand AS (
  SELECT * FROM (SELECT h.*, a.lim, a.alpha, a.fusion, a.with_vector,
      row_number() OVER (PARTITION BY h.query_id, h.shard ORDER BY h.score DESC, h.id) AS rn
    FROM hits h JOIN asked a USING (query_id))
  WHERE rn <= CASE WHEN fusion = 'rrf' THEN 100 ELSE 3 * lim END),
sem AS (
  SELECT k.*, c.title, k.with_vector AND c.title_vector IS NOT NULL AS both_vectors,
    CASE WHEN k.with_vector AND c.title_vector IS NOT NULL
      THEN round(list_cosine_similarity(c.title_vector, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {QUERY_VECTOR_ID})), 6)
      ELSE 0.0 END AS semantic
  FROM cand k JOIN corpus c USING (id)),
ranks AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS kr,
    row_number() OVER (PARTITION BY query_id ORDER BY semantic DESC, id) AS sr,
    count(*) OVER (PARTITION BY query_id) AS keyword_hits FROM sem),
scored AS (
  SELECT *, fusion = 'rrf' AND with_vector AS by_rank,
    round(CASE WHEN fusion = 'rrf' AND with_vector THEN 1.0::DOUBLE / (60 + kr) + 1.0::DOUBLE / (60 + sr)
      WHEN both_vectors THEN alpha::DOUBLE * score + (1 - alpha::DOUBLE) * semantic ELSE score END, 6) AS hybrid FROM ranks),
fused AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid DESC, id) AS rank FROM scored)
  WHERE rank <= lim)"""


def hybrid_rows(keep) -> str:
    ids = ", ".join(str(q[0]) for q in HYBRID_QUERIES if keep(q))
    return f"""{hybrid(False)}
SELECT query_id, id, score AS keyword_score, semantic AS semantic_score, hybrid AS hybrid_score,
  CASE WHEN by_rank THEN 'RRF' ELSE 'weighted' END AS fusion_method, rank, shard
FROM fused WHERE query_id IN ({ids})"""


LOG = """log AS (
  SELECT event_id AS query_id, ts, 'q' || user_id AS q, CASE WHEN event_id % 2 = 0 THEN 5 ELSE 10 END::BIGINT AS lim,
    event_type AS status, 'shard-' || (user_id % 8) AS shard, value / 1000 AS latency_s FROM events)"""

LOG_ROUTES = f"""{LOG},
per_q AS (SELECT q, count(*) AS n, min(query_id) AS f FROM log GROUP BY q),
{values(ROUTING_ENTRIES, 'key, value', 'fixed_kv')},
kv AS (
  SELECT '/hot_terms/' || q || '/shards' AS key, (f % 8) || ', 9,x,' || (n % 8) AS value FROM per_q WHERE n % 2 = 0
  UNION ALL SELECT key, value FROM fixed_kv),
routed AS (
  SELECT l.query_id, l.ts, l.q, CASE WHEN p.q IS NULL THEN 'cold' ELSE 'hot' END AS routing_type,
    CASE WHEN p.q IS NULL THEN range(8) ELSE list_sort(list_distinct([p.f % 8, p.n % 8])) END AS route
  FROM log l LEFT JOIN (SELECT * FROM per_q WHERE n % 2 = 0) p USING (q)),
stats AS (
  SELECT q AS term, query_id % 50 AS hits, len(route)::BIGINT AS shards, floor(epoch(ts))::BIGINT AS ts
  FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY ts DESC, query_id DESC) AS rn FROM routed WHERE routing_type = 'hot')
  WHERE rn = 1)"""

LINES = f"""{CORPUS},
lines AS (
  SELECT *, doc_id % 10 = 3 AS broken, '{{"id": "' || id || '", "title": ' AS bad_line FROM corpus)"""

BUCKETS = ", ".join(f"count(*) FILTER (latency_s <= {b}) AS b{i}" for i, b in enumerate(LATENCY_BOUNDS))
BUCKET_ROWS = " UNION ALL ".join(
    [f"SELECT status, shard, latency_sum, latency_count, '{b}' AS le, b{i} AS n FROM h" for i, b in enumerate(LATENCY_BOUNDS)]
    + ["SELECT status, shard, latency_sum, latency_count, '+Inf', latency_count FROM h"]
)

MARKED = (
    "concat('''''''a'''''' [[b]]', chr(10), chr(9), '{{c}} [d] ''''', text, '''''', chr(10), '[[e]]', chr(9))"
)
CLEAN_MARKED = f"(SELECT doc_id, {clean(MARKED, True)} AS body FROM documents)"

MERGED = f"""{CORPUS},
merged AS (
  SELECT id, shard, title, CASE WHEN lang = 'de' THEN body || ' nachtrag ertion' ELSE body END AS body FROM corpus
  UNION ALL
  SELECT id, {shard('id')}, url, body FROM (SELECT 'page_' || page_id AS id, url, {clean('html', False)} AS body FROM pages)),
{tokens('merged')}"""

REVISED = f"""
raw AS (
  SELECT 'wiki_' || doc_id AS id, CASE WHEN lang = 'en' AND strlen({clean("'[[revised]] ' || text", False)}) >= 50
    THEN {clean("'[[revised]] ' || text", False)} ELSE {clean('text', False)} END AS body FROM documents),
corpus AS (SELECT id, body, {shard('id')} AS shard FROM raw WHERE strlen(body) >= 50),
{tokens(fields=('body',))}"""

RAW_QUERIES = """raw AS (
  SELECT event_id AS query_id, CASE WHEN event_type = 'error' THEN '' ELSE 'q' || user_id END AS q, event_id % 6 AS pick FROM events)"""


def oracle_sql() -> dict[str, str]:
    keyword = lambda **how: f"WITH {query_hits(KEYWORD_QUERIES, **how)},{TOP} {RANKED}"
    sql = {
        "clean_pages": f"SELECT doc_id, body FROM {CLEAN_MARKED} WHERE strlen(body) >= 50",
        "page_scan_xml": "SELECT doc_id::VARCHAR AS title, md5(text) AS text_md5 FROM documents",
        "page_cap": f"SELECT doc_id, md5(text) AS text_md5 FROM documents ORDER BY doc_id LIMIT {PAGE_CAP}",
        "jsonl_roundtrip": f"""WITH {CORPUS}, both_kinds AS (
  SELECT 'flat' AS kind, -1::BIGINT AS shard, * EXCLUDE (shard) FROM corpus UNION ALL
  SELECT 'sharded', shard, * EXCLUDE (shard) FROM corpus)
SELECT kind, shard, id, md5(title) AS title_md5, md5(body) AS body_md5, coalesce(len(title_vector), 0)::BIGINT AS dims FROM both_kinds""",
        "jsonl_bad_rows": f"""WITH {LINES}
SELECT 'bad' AS kind, count(*) AS n, sum(length(bad_line))::BIGINT AS chars FROM lines WHERE broken
UNION ALL SELECT 'good', count(*), sum(length(body))::BIGINT FROM lines WHERE NOT broken""",
        "index_doc_cap": f"WITH {LINES} SELECT id, md5(body) AS body_md5 FROM lines WHERE NOT broken ORDER BY id LIMIT {INDEX_CAP}",
        "ingest_counters": f"""WITH {LINES}
SELECT count(*) FILTER (NOT broken) AS indexed, count(*) FILTER (broken) AS skipped,
  count(*) FILTER (NOT broken AND len(title_vector) > 0) AS embeds_ok,
  count(*) FILTER (NOT broken AND title_vector IS NULL) AS embeds_failed FROM lines""",
        "build_counters": f"""WITH {CORPUS}, texts AS (
  SELECT CASE WHEN title <> '' THEN title ELSE substr(body, 1, 100) END AS text FROM corpus),
tried AS (SELECT regexp_matches(text, '[\\p{{L}}\\p{{N}}_]') AND NOT contains(text, 'ß') AS ok FROM texts)
SELECT count(*) AS indexed, count(*) FILTER (ok) AS embeds_ok, count(*) FILTER (NOT ok) AS embeds_failed, 0::BIGINT AS embeds_not_tried
FROM tried""",
        "dense_ids": f"""SELECT doc_id, 'wiki_' || row_number() OVER (ORDER BY doc_id) AS id, md5(body) AS body_md5
FROM (SELECT doc_id, {clean(MARKED, False)} AS body FROM documents) WHERE strlen(body) >= 50""",
        "stamped_docs": f"WITH {CORPUS} SELECT id, strftime(indexed_at, '%Y-%m-%d %H:%M:%S') AS indexed_at FROM corpus",
        "doc_shards": f"""SELECT 'wiki_' || doc_id AS id, {shard("'wiki_' || doc_id")} AS shard, 0::BIGINT AS unsharded,
  {shard("'wiki_' || doc_id", 200)} AS shard_200 FROM documents""",
        "shard_distribution": f"""WITH {CORPUS}, few AS (SELECT {shard("'wiki_' || n_nationkey", 64)} AS shard FROM nation)
SELECT 'nation' AS kind, s.shard, count(few.shard) AS n_docs FROM range(64) s(shard) LEFT JOIN few USING (shard) GROUP BY ALL
UNION ALL
SELECT 'documents', s.shard, count(c.shard) FROM range(8) s(shard) LEFT JOIN corpus c USING (shard) GROUP BY ALL""",
        "shard_catalogue": f"""WITH {CORPUS}
SELECT string_agg(shard::VARCHAR, ',' ORDER BY shard) AS shards, count(*) AS count FROM (SELECT DISTINCT shard FROM corpus)""",
        "token_stats": f"""WITH {TOKENS}, spread AS (
  SELECT id, field, term FROM tokens UNION ALL SELECT id, '_all', term FROM tokens)
SELECT term, field, count(DISTINCT id) AS df, count(*) AS tf FROM spread GROUP BY ALL""",
        "index_postings": f"""WITH {TOKENS}, spread AS (
  SELECT id, shard, field, term FROM tokens UNION ALL SELECT id, shard, '_all', term FROM tokens),
lens AS (SELECT id, field, count(*) AS dl FROM spread GROUP BY ALL)
SELECT term, s.field, s.id, shard, count(*) AS tf, any_value(dl) AS dl FROM spread s JOIN lens USING (id, field) GROUP BY ALL""",
        "index_keyword_only": f"""WITH {TOKENS}
SELECT c.id, -1::BIGINT AS dims, count(DISTINCT t.term) AS n_terms FROM corpus c LEFT JOIN tokens t USING (id) GROUP BY ALL""",
        "index_upsert": f"""WITH {MERGED}, per_term AS (
  SELECT term, count(DISTINCT id) AS df, count(*) FILTER (field = 'body') AS body_tf FROM tokens GROUP BY ALL)
SELECT term, df, body_tf, df AS live_df, body_tf AS live_body_tf FROM per_term""",
        "match_bm25": keyword(),
        "match_bm25_global": keyword(scope="global"),
        "match_tfidf": keyword(model="tfidf"),
        "phrase_match": PHRASE,
        "range_match": RANGE,
        "shard_topn": f"WITH {query_hits(KEYWORD_QUERIES)},{CANDIDATES} SELECT query_id, id, score, shard, shard_rank FROM candidates",
        "fanout_union": f"""WITH {query_hits(ROUTED_QUERIES, routed=True)},{CANDIDATES}
SELECT h.query_id, h.shard, count(*) AS n_hits, count(c.id) AS n_candidates
FROM hits h LEFT JOIN candidates c USING (query_id, shard, id) GROUP BY ALL""",
        "global_topk": f"WITH {query_hits(ROUTED_QUERIES, routed=True)},{TOP} {RANKED}",
        "search_summary": f"""WITH {query_hits(ROUTED_QUERIES, routed=True)},{TOP},{CANDIDATES},
totals_q AS (SELECT query_id, count(*) AS total_hits FROM candidates GROUP BY ALL),
matches AS (SELECT query_id, count(*) AS match_count FROM hits GROUP BY ALL),
listed AS (SELECT query_id, count(*) AS n_hits, string_agg(id, ',' ORDER BY rank) AS ids FROM top GROUP BY ALL)
SELECT r.query_id, r.q AS query, 8::BIGINT AS shards, coalesce(total_hits, 0) AS total_hits, routing_type,
  coalesce(n_hits, 0) AS n_hits, coalesce(ids, '') AS ids, coalesce(match_count, 0) AS match_count
FROM routes r LEFT JOIN totals_q USING (query_id) LEFT JOIN listed USING (query_id) LEFT JOIN matches USING (query_id)""",
        "search_collapsed": f"""WITH {query_hits(KEYWORD_QUERIES)},{TOP},{CANDIDATES},
{values([(n, q[0]) for n, q in enumerate(KEYWORD_QUERIES)], 'n, answer_id', 'picked')},
totals_q AS (SELECT query_id, count(*) AS total_hits FROM candidates GROUP BY ALL),
listed AS (SELECT query_id, string_agg(id, ',' ORDER BY rank) AS ids FROM top GROUP BY ALL)
SELECT e.event_id AS query_id, a.q AS query, coalesce(total_hits, 0) AS total_hits, coalesce(ids, '') AS ids
FROM events e JOIN picked p ON p.n = e.event_id % {len(KEYWORD_QUERIES)} JOIN asked a ON a.query_id = p.answer_id
LEFT JOIN totals_q t ON t.query_id = p.answer_id LEFT JOIN listed l ON l.query_id = p.answer_id""",
        "search_hot_stats": f"""WITH {query_hits(ROUTED_QUERIES, routed=True)},{CANDIDATES},
{values([(n, q[0]) for n, q in enumerate(ROUTED_QUERIES)], 'n, answer_id', 'picked')},
totals_q AS (SELECT query_id, count(*) AS total_hits FROM candidates GROUP BY ALL),
written AS (
  SELECT r.q AS term, coalesce(total_hits, 0) AS hits, len(r.route)::BIGINT AS shards, floor(epoch(e.ts))::BIGINT AS ts,
    row_number() OVER (PARTITION BY r.q ORDER BY e.ts DESC, e.event_id DESC) AS rn
  FROM events e JOIN picked p ON p.n = e.event_id % {len(ROUTED_QUERIES)} JOIN routes r ON r.query_id = p.answer_id
  LEFT JOIN totals_q t ON t.query_id = p.answer_id WHERE r.routing_type = 'hot')
SELECT term, hits, shards, ts FROM written WHERE rn = 1""",
        "search_fields": f"""WITH {query_hits(KEYWORD_QUERIES)},{TOP}
SELECT t.query_id, t.rank, t.id, c.title, md5(c.body) AS body_md5, coalesce(len(c.title_vector), 0)::BIGINT AS dims
FROM top t JOIN corpus c USING (id)""",
        "highlights": f"""WITH {query_hits(KEYWORD_QUERIES)},{TOP}
SELECT t.query_id, t.rank, t.id, bool_or(k.field = 'title') AS in_title, bool_or(k.field = 'body') AS in_body,
  bool_or(k.field = 'body') AS marked
FROM top t JOIN asked_terms a USING (query_id) JOIN tokens k ON k.id = t.id AND k.term = a.term GROUP BY ALL""",
        "query_defaults": f"""WITH {RAW_QUERIES}
SELECT query_id, q, CASE pick WHEN 3 THEN 7 WHEN 5 THEN 25 ELSE 20 END::BIGINT AS "limit",
  CASE pick WHEN 3 THEN 7 WHEN 5 THEN 25 ELSE 10 END::BIGINT AS hybrid_limit,
  CASE pick WHEN 1 THEN 0.25 WHEN 4 THEN 1.5 ELSE 0.7 END::DOUBLE AS alpha,
  CASE WHEN pick < 2 THEN 'rrf' WHEN pick < 4 THEN 'weighted' ELSE 'rrf' END AS fusion, '' AS error
FROM raw WHERE q <> ''
UNION ALL SELECT query_id, q, NULL, NULL, NULL, NULL, 'missing ''q'' parameter' FROM raw WHERE q = ''""",
        "hot_lookup": f"WITH {LOG_ROUTES} SELECT query_id, q, routing_type, array_to_string(route, ',') AS route FROM routed",
        "hot_routing": f"""WITH {query_hits(ROUTED_QUERIES, routed=True)}
SELECT h.query_id, r.routing_type, h.shard, h.id, h.score FROM hits h JOIN routes r USING (query_id)""",
        "hot_stats": f"WITH {LOG_ROUTES} SELECT term, hits, shards, ts FROM stats",
        "hot_listing": f"""WITH {LOG_ROUTES}, written AS (
  SELECT '/hot_terms/' || term || '/stats' AS key, 'hits:' || hits || ' shards:' || shards || ' ts:' || ts AS value FROM stats),
all_kv AS (SELECT * FROM kv WHERE key NOT IN (SELECT key FROM written) UNION ALL SELECT * FROM written),
parts AS (SELECT string_split(substr(key, 12), '/') AS p, value FROM all_kv WHERE starts_with(key, '/hot_terms/'))
SELECT p[1] AS term, max(value) FILTER (p[2] = 'shards') AS shards, max(value) FILTER (p[2] = 'stats') AS stats, count(*) AS n_fields,
  count(*) OVER () AS n_terms
FROM parts WHERE len(p) = 2 GROUP BY 1""",
        "cosine_to_query": f"""WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = {QUERY_VECTOR_ID})
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT v FROM q)), 6) AS to_query, 0.0::DOUBLE AS unequal,
  0.0::DOUBLE AS to_zero, -1.0::DOUBLE AS opposite FROM embeddings""",
        "vector_coercion": """WITH v AS (
  SELECT vec_id, label % 4 AS kind, list_transform(embedding[1:4], lambda x: trunc((x * 1000::FLOAT)::DOUBLE)) AS w FROM embeddings)
SELECT vec_id, CASE kind WHEN 0 THEN 4 WHEN 1 THEN 5 WHEN 2 THEN 6 ELSE -1 END::BIGINT AS dims,
  CASE WHEN kind < 3 THEN list_sum(w) + 0.0 END AS total, CASE kind WHEN 0 THEN w[1] + 0.0 WHEN 3 THEN NULL ELSE 0.0 END AS head FROM v""",
        "embed_text": f"""WITH {CORPUS}
SELECT id, CASE WHEN lang = 'en' AND title <> '' THEN title ELSE substr(body, 1, 100) END AS embedding_text FROM corpus""",
        "embed_docs": f"""WITH {CORPUS}, texts AS (
  SELECT id AS k1, 0 AS k2, CASE WHEN title <> '' THEN title ELSE substr(body, 1, 100) END AS text FROM corpus),{bag_vectors(64)}
SELECT k1 AS id, dims, square, ramp, steep FROM digests""",
        "embed_batch": f"""WITH texts AS (SELECT conv_id AS k1, turn AS k2, text FROM conversations),{bag_vectors(16)}
SELECT k1 AS conv_id, k2 AS turn, dims, square, ramp, steep FROM digests""",
        "embed_queries": f"""WITH texts AS (
  SELECT conv_id AS k1, turn AS k2, CASE WHEN turn % 3 = 0 THEN '?!' ELSE text END AS text FROM conversations),{bag_vectors(32)}
SELECT k1 AS conv_id, k2 AS turn, dims, square, ramp, steep FROM digests""",
        "hybrid_rrf": hybrid_rows(lambda q: q[4] in ("rrf", None) and q[5]),
        "hybrid_weighted": hybrid_rows(lambda q: q[4] in ("weighted", "other")),
        "hybrid_fallback": hybrid_rows(lambda q: not q[5]),
        "hybrid_summary": f"""{hybrid(True)},
listed AS (SELECT query_id, any_value(keyword_hits) AS keyword_hits, count(*) AS n, string_agg(id, ',' ORDER BY rank) AS ids FROM fused GROUP BY ALL)
SELECT a.query_id, a.q AS query, CASE WHEN with_vector THEN (SELECT len(embedding) FROM embeddings WHERE vec_id = {QUERY_VECTOR_ID}) ELSE 0 END::BIGINT AS dims,
  coalesce(keyword_hits, 0) AS keyword_hits, coalesce(n, 0) AS semantic_topk,
  CASE WHEN fusion <> 'rrf' THEN alpha END::DOUBLE AS fusion_alpha, fusion AS fusion_method, CASE WHEN fusion = 'rrf' THEN 60 END::BIGINT AS fusion_k,
  r.routing_type, coalesce(ids, '') AS ids
FROM asked a JOIN routes r USING (query_id) LEFT JOIN listed USING (query_id)""",
        "query_counts": f"WITH {LOG} SELECT status, shard, count(*) AS n FROM log GROUP BY ALL",
        "latency_histogram": f"""WITH {LOG}, h AS (
  SELECT status, shard, round(sum(latency_s), 6) AS latency_sum, count(latency_s) AS latency_count, {BUCKETS} FROM log GROUP BY status, shard)
{BUCKET_ROWS}""",
        "query_collapse": f"""WITH {LOG}, asked AS (SELECT query_id, q, CASE WHEN query_id % 3 <> 0 THEN lim END AS lim FROM log)
SELECT min(query_id) OVER (PARTITION BY q, lim) AS answer_id, query_id, concat_ws(':', q, lim) AS answer FROM asked""",
        "stream_upsert": f"""WITH {REVISED}
SELECT c.id, c.shard, md5(c.body) AS body_md5, count(t.term) AS n_words FROM corpus c LEFT JOIN tokens t USING (id) GROUP BY ALL""",
        "stream_collapse": f"WITH {LOG} SELECT DISTINCT q, lim AS \"limit\" FROM log",
        "stream_hot_stats": f"WITH {LOG_ROUTES} SELECT term, hits, shards, ts FROM stats",
        "stream_metrics": f"WITH {LOG} SELECT status, shard, count(*) AS n FROM log GROUP BY ALL",
    }
    sql["stream_latency"] = sql["latency_histogram"]
    for key in ("bool_match", "field_match", "wildcard_match", "fuzzy_match", "boosted_match"):
        sql[key] = f"{clause_hits(key)} SELECT query_id, id, score FROM hits"
    sql["bool_match"] += """ UNION ALL SELECT 62, id, 0.0::DOUBLE FROM corpus
WHERE id NOT IN (SELECT id FROM tokens WHERE term = 'thing' OR (term = 'erly' AND field = 'body'))"""
    return sql
