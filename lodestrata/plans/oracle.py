"""ANSI SQL for the registered queries, as an independent statement of their results."""

from __future__ import annotations

from ..functions.text import ENDINGS, STOPWORDS
from . import records

Z = "1.959963984540054"


def _wilson(h: str, n: str) -> str:
    p = f"(({h}) * 1.0 / nullif({n}, 0))"
    mid = f"(({p} + {Z} * {Z} / (2.0 * {n})) / (1 + {Z} * {Z} / {n}))"
    half = f"({Z} / (1 + {Z} * {Z} / {n}) * sqrt({p} * (1 - {p}) / {n} + {Z} * {Z} / (4.0 * {n} * {n})))"
    return f"round(CASE WHEN {n} > 0 THEN greatest(0.0, {mid} - {half}) END, 9) AS lo, round(CASE WHEN {n} > 0 THEN least(1.0, {mid} + {half}) END, 9) AS hi"


def _rates(h: str = "hits", n: str = "n") -> str:
    return f"CAST({h} AS BIGINT) AS {h}, CAST({n} AS BIGINT) AS {n}, round(CASE WHEN {n} > 0 THEN {h} * 1.0 / {n} END, 9) AS rate, {_wilson(h, n)}, {n} >= 25 AS reportable"


NORMAL = "trim(regexp_replace(lower(translate({0}, '‘’“”–—', '''''\"\"--')), '[\\s ]+', ' ', 'g'))"

POSTINGS = """post AS (SELECT chunk_id, lexeme, count(*) AS tf FROM (
  SELECT doc_id AS chunk_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS lexeme FROM documents) GROUP BY ALL)"""
TERMS = """terms AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS lexeme FROM benchmark)"""
SPARSE = f"""{POSTINGS}, {TERMS},
sp0 AS (SELECT query_id, chunk_id, sum(tf) AS positions FROM post JOIN terms USING (lexeme) GROUP BY ALL),
sp AS (SELECT query_id, 'sparse' AS arm, CAST(row_number() OVER (PARTITION BY query_id ORDER BY positions DESC, chunk_id) AS INTEGER) AS rank, chunk_id, round(positions * 0.1::DOUBLE, 1) AS score FROM sp0),
sparse AS (SELECT * FROM sp WHERE rank <= 50)"""


def _dense(where: str) -> str:
    return f"""dn0 AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, round(1 - list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 12) AS score
  FROM embeddings q, embeddings v WHERE {where}),
dn AS (SELECT query_id, 'dense' AS arm, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id) AS INTEGER) AS rank, chunk_id, score FROM dn0),
dense AS (SELECT * FROM dn WHERE rank <= 50)"""


def _fused(name: str, votes: str) -> str:
    return f"""{name}0 AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM ({votes}) GROUP BY ALL),
{name} AS (SELECT query_id, '{name}' AS arm, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, chunk_id) AS INTEGER) AS rank, chunk_id, score FROM {name}0)"""


ITEM_VECTORS = "q.vec_id IN (SELECT item_id FROM benchmark)"
BOTH = "SELECT * FROM sparse UNION ALL SELECT * FROM dense"
HYBRID = f"{SPARSE}, {_dense(ITEM_VECTORS)}, {_fused('hybrid', BOTH)}"
GATES = f"""{SPARSE}, L AS (SELECT query_id, count(*) AS n FROM terms GROUP BY ALL),
gates AS (SELECT b.item_id AS query_id, CAST(coalesce(L.n, 0) AS INTEGER) AS L, coalesce(s.score, 0.0) AS s1, round(coalesce(L.n, 0) * 2.0::DOUBLE, 1) AS tau
  FROM benchmark b LEFT JOIN L ON L.query_id = b.item_id LEFT JOIN sparse s ON s.query_id = b.item_id AND s.rank = 1)"""
GOLD = f"""hits AS (SELECT b.item_id AS query_id, d.doc_id AS chunk_id, d.source AS accession FROM documents d, benchmark b
  WHERE contains({NORMAL.format('d.text')}, {NORMAL.format('b.text')})),
places AS (SELECT query_id, arg_min(accession, chunk_id) AS accession FROM hits GROUP BY ALL),
gold AS (SELECT query_id, chunk_id FROM hits JOIN places USING (query_id, accession))"""
SCORED = f"""{HYBRID}, {GOLD},
arms AS (SELECT * FROM sparse UNION ALL SELECT * FROM dense UNION ALL SELECT * FROM hybrid),
best AS (SELECT query_id, arm, min(rank) AS best FROM arms JOIN gold USING (query_id, chunk_id) GROUP BY ALL),
outcomes AS (SELECT g.query_id, CASE WHEN g.query_id % 2 = 0 THEN 'exact_entity' ELSE 'conceptual' END AS stratum, a.arm, k.k, coalesce(best.best <= k.k, false) AS hit
  FROM (SELECT DISTINCT query_id FROM gold) g CROSS JOIN (SELECT DISTINCT arm FROM arms) a CROSS JOIN (VALUES (1), (5), (10), (50)) k(k)
  LEFT JOIN best ON best.query_id = g.query_id AND best.arm = a.arm)"""
EXTRACTION = """ex AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'total_assets' ELSE 'goodwill_impairment' END AS field,
  CASE WHEN o_orderkey % 7 = 0 THEN 'not_addressed' WHEN o_orderkey % 7 = 1 THEN 'stated_none' ELSE 'value' END AS kind,
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS v,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN 0 WHEN o_orderkey % 5 = 2 THEN CAST(CAST(o_totalprice * 1.0005 AS DECIMAL(18,2)) AS DOUBLE)
    WHEN o_orderkey % 5 = 3 THEN CAST(CAST(o_totalprice * 1.01 AS DECIMAL(18,2)) AS DOUBLE) ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END AS p FROM orders),
oc AS (SELECT k, field, kind, k % 11 = 0 AS ambiguous, CASE
  WHEN kind = 'not_addressed' THEN CASE WHEN p IS NULL THEN 'correct_abstention' ELSE 'false_extraction' END
  WHEN p IS NULL THEN 'missed'
  WHEN kind = 'stated_none' THEN CASE WHEN p = 0 THEN 'correct' ELSE 'false_extraction' END
  WHEN p = 0 OR v = 0 THEN CASE WHEN p = v THEN 'correct' ELSE 'wrong_value' END
  WHEN abs(p - v) <= 0.001 * greatest(abs(p), abs(v)) THEN 'correct' ELSE 'wrong_value' END AS outcome FROM ex)"""
STEM = "CASE " + " ".join(f"WHEN ends_with(w, '{x}') AND length(w) - {len(x)} >= 4 THEN " + (f"regexp_replace(left(w, length(w) - {len(x)}), 'i$', '')" if x == "ies" else f"left(w, length(w) - {len(x)})") for x in ENDINGS) + " ELSE w END"
RIGHT = "outcome IN ('correct', 'correct_abstention')"

ORACLE: dict[str, str] = {
    "store_measure": "SELECT count(*) AS chunks, count(DISTINCT source) AS filings, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS tokens, count(*) FILTER (text IS NULL) AS without_text FROM documents",
    "chunks_by_group": "SELECT lang AS item, count(*) AS chunks FROM documents GROUP BY lang",
    "token_percentiles": "SELECT CAST(sum(n_chars) AS BIGINT) AS total, quantile_disc(n_chars, 0.5) AS p50, quantile_disc(n_chars, 0.75) AS p75, quantile_disc(n_chars, 0.95) AS p95, max(n_chars) AS largest FROM documents",
    "dup_text_groups": "SELECT sha256(text) AS digest, count(*) AS copies, count(DISTINCT source) AS filings FROM documents GROUP BY sha256(text) HAVING count(*) > 1",
    "null_scan": "SELECT " + ", ".join(f"count(*) FILTER ({c} IS NULL) AS null_{c}" for c in ("doc_id", "text", "lang", "source", "n_chars")) + " FROM documents",
    "token_coverage_band": """SELECT * FROM (SELECT source AS accession, CAST(sum(length(split_part(text, ' ', 1)) * 300) AS BIGINT) AS stated, CAST(sum(n_chars) AS BIGINT) AS stored,
      round(CAST(sum(n_chars) AS DOUBLE) / sum(length(split_part(text, ' ', 1)) * 300), 9) AS ratio FROM documents GROUP BY source) WHERE NOT ratio BETWEEN 1.0 AND 1.5""",
    "postings_df": f"WITH {POSTINGS} SELECT chunk_id, lexeme, tf FROM post",
    "lexeme_doc_frequency": f"WITH {POSTINGS} SELECT lexeme, count(*) AS ndoc, CAST(sum(tf) AS BIGINT) AS nentry FROM post GROUP BY lexeme",
    "sparse_topk": f"WITH {SPARSE} SELECT * FROM sparse",
    "sparse_or_match": f"WITH {POSTINGS}, {TERMS} SELECT query_id, count(DISTINCT chunk_id) AS matches, min(chunk_id) AS first, max(chunk_id) AS last FROM post JOIN terms USING (lexeme) GROUP BY query_id",
    "dense_by_cells": f"WITH {_dense('q.vec_id % 20 = 0')} SELECT query_id, arm, rank, chunk_id, round(score, 6) AS score FROM dense",
    "dense_topk": f"WITH {_dense('q.vec_id % 20 = 0')} SELECT query_id, arm, rank, chunk_id, round(score, 6) AS score FROM dense",
    "hybrid_rrf": f"WITH {HYBRID} SELECT query_id, arm, rank, chunk_id, round(score, 9) AS score FROM hybrid",
    "gate_decisions": f"WITH {GATES} SELECT *, s1 <= tau AS fires FROM gates",
    "gated_rrf": f"""WITH {GATES}, {_dense(ITEM_VECTORS)},
      {_fused('gated', "SELECT s.* FROM sparse s JOIN gates g USING (query_id) WHERE g.s1 > g.tau UNION ALL SELECT * FROM dense")} SELECT query_id, arm, rank, chunk_id, round(score, 9) AS score FROM gated""",
    "gold_sets": f"WITH {GOLD} SELECT query_id, chunk_id FROM gold",
    "gold_cap_violations": f"WITH {GOLD}, n AS (SELECT query_id, count(*) AS n FROM gold GROUP BY ALL) SELECT item_id AS query_id, coalesce(n, 0) AS gold_chunks FROM benchmark LEFT JOIN n ON n.query_id = item_id WHERE coalesce(n, 0) = 0 OR n > 5",
    "duplicate_span_flags": f"""WITH {GOLD} SELECT query_id, string_agg(accession, ',' ORDER BY accession) AS elsewhere
      FROM (SELECT DISTINCT h.query_id, h.accession FROM hits h JOIN places p USING (query_id) WHERE h.accession <> p.accession) GROUP BY query_id""",
    "recall_at_k_by_stratum": f"""WITH {SCORED}, c AS (SELECT arm, k, CASE WHEN grouping(stratum) = 1 THEN 'pooled' ELSE stratum END AS stratum, count(*) FILTER (hit) AS hits, count(*) AS n
      FROM outcomes GROUP BY GROUPING SETS ((arm, k), (arm, k, stratum))) SELECT arm, k, stratum, {_rates()} FROM c""",
    "mcnemar_pairs": f"""WITH {SCORED}, p AS (SELECT a.arm AS arm_a, b.arm AS arm_b, a.k, count(*) FILTER (a.hit AND NOT b.hit) AS b, count(*) FILTER (NOT a.hit AND b.hit) AS c, count(*) AS n
      FROM outcomes a JOIN outcomes b ON a.query_id = b.query_id AND a.k = b.k AND a.arm < b.arm GROUP BY ALL),
      q AS (SELECT *, b + c AS discordant, n - b - c AS concordant FROM p),
      r AS (SELECT arm_a, arm_b, k, b, c, discordant, concordant, n, round(CASE WHEN discordant > 0 THEN b * 1.0 / discordant END, 9) AS rate, {_wilson('b', 'discordant')} FROM q)
      SELECT *, coalesce(lo > 0.5 OR hi < 0.5, false) AS established FROM r""",
    "context_dedupe": f"""WITH {SPARSE}, {_fused('hybrid', 'SELECT * FROM sparse')},
      ctx AS (SELECT query_id, arm, string_agg(CAST(chunk_id AS VARCHAR), '|' ORDER BY rank) AS ids FROM (SELECT * FROM sparse UNION ALL SELECT * FROM hybrid) WHERE rank <= 5 GROUP BY ALL)
      SELECT query_id || '-' || substr(sha256(ids), 1, 12) AS call_id, query_id, replace(ids, '|', ',') AS ids, string_agg(arm, ',' ORDER BY arm) AS arms FROM ctx GROUP BY query_id, ids""",
    "wilson_by_group": f"WITH c AS (SELECT source, count(*) FILTER (quality = 1) AS hits, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY source) SELECT source, {_rates()} FROM c",
    "extraction_outcomes": f"WITH {EXTRACTION} SELECT k AS accession, field, outcome FROM oc",
    "field_summary": f"""WITH {EXTRACTION}, c AS (SELECT field, count(*) AS n, count(*) FILTER ({RIGHT}) AS correct_n, {', '.join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in ('correct', 'wrong_value', 'missed', 'false_extraction', 'correct_abstention'))} FROM oc GROUP BY field)
      SELECT field, n, correct_n, correct, wrong_value, missed, false_extraction, correct_abstention, round(correct_n * 1.0 / n, 9) AS accuracy, {_wilson('correct_n', 'n')}, n >= 25 AS reportable FROM c""",
    "extraction_summary": f"""WITH {EXTRACTION}, c AS (SELECT 'pooled' AS name, count(*) FILTER ({RIGHT}) AS hits, count(*) AS n FROM oc
      UNION ALL SELECT 'excluding_ambiguous', count(*) FILTER ({RIGHT}), count(*) FROM oc WHERE NOT ambiguous
      UNION ALL SELECT 'false_extraction', count(*) FILTER (outcome = 'false_extraction'), count(*) FROM oc WHERE kind <> 'value') SELECT name, {_rates()} FROM c
      UNION ALL SELECT 'macro', -1, count(*), round(avg(r), 9), NULL, NULL, true FROM (SELECT count(*) FILTER ({RIGHT}) * 1.0::DOUBLE / count(*) AS r FROM oc GROUP BY field)""",
    "gate_counts": f"WITH {GATES} SELECT CASE WHEN query_id % 2 = 0 THEN 'exact_entity' ELSE 'conceptual' END AS stratum, count(*) FILTER (s1 <= tau) AS fired, count(*) AS n FROM gates GROUP BY ALL",
    "null_summary": f"""WITH {POSTINGS}, {TERMS}, n AS (SELECT query_id, CAST(count(*) AS INTEGER) AS L FROM terms GROUP BY ALL),
      hit AS (SELECT query_id, chunk_id, sum(tf) AS p FROM terms JOIN post USING (lexeme) GROUP BY ALL),
      s AS (SELECT L, coalesce(max(p) * 0.1::DOUBLE, 0.0) AS s FROM n LEFT JOIN hit USING (query_id) GROUP BY query_id, L)
      SELECT L, count(*) AS bags, round(quantile_disc(s, 0.95), 6) AS tau, round(min(s), 6) AS min, round(median(s), 6) AS median, round(avg(s), 6) AS mean, round(max(s), 6) AS max, count(*) FILTER (s = 0) AS zero_scoring_bags FROM s GROUP BY L""",
    "qa_outcomes": f"""WITH {SPARSE}, {GOLD},
      r AS (SELECT s.query_id, s.chunk_id, d.text, d.source, CASE WHEN s.query_id % 2 = 0 THEN split_part(d.text, '.', 1) ELSE 'it says something else altogether' END AS quote, s.query_id % 7 AS k FROM sparse s JOIN documents d ON d.doc_id = s.chunk_id WHERE rank = 1),
      o AS (SELECT r.*, k NOT IN (0, 3, 4) AS ok, CASE k WHEN 0 THEN 'not valid JSON' WHEN 3 THEN 'citation is neither integer nor null' WHEN 4 THEN 'missing fields' END AS reason,
        CASE WHEN k IN (0, 3, 4) THEN 'malformed' WHEN k = 1 THEN 'abstained' WHEN k = 2 THEN 'unsupported'
        WHEN {NORMAL.format('quote')} = '' OR NOT contains({NORMAL.format('text')}, {NORMAL.format('quote')}) THEN 'unsupported'
        WHEN EXISTS (SELECT 1 FROM gold g WHERE g.query_id = r.query_id AND g.chunk_id = r.chunk_id) THEN 'supported_gold' ELSE 'supported_nongold' END AS outcome FROM r)
      SELECT query_id, ok, reason, outcome, CASE WHEN k IN (5, 6) THEN chunk_id ELSE -1 END AS cited_chunk_id,
        outcome = 'supported_nongold' AND EXISTS (SELECT 1 FROM hits h JOIN places p USING (query_id) WHERE h.query_id = o.query_id AND h.chunk_id = o.chunk_id AND p.accession <> o.source) AS wrong_filing FROM o""",
    "json_variant_types": """SELECT kind, count(*) AS n FROM (SELECT CASE json_type(props, '$.k') WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'number'
      WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'missing' END AS kind FROM events) GROUP BY kind""",
    "grid_gaps": """SELECT n_nationkey, s.segment FROM nation, (VALUES ('AUTOMOBILE'), ('BUILDING'), ('FURNITURE'), ('HOUSEHOLD'), ('MACHINERY'), ('OTHER')) s(segment)
      WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_mktsegment = s.segment)""",
    "pending_antijoin": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)",
    "symmetric_diff": """WITH a AS (SELECT DISTINCT l_partkey AS key FROM lineitem), b AS (SELECT p_partkey AS key FROM part WHERE p_size > 5)
      SELECT key, 'left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT key, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
    "latest_per_key": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id",
    "latest_turns": "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n = 1",
    "undo_target": """SELECT user_id, event_id, event_type FROM (SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id)
      WHERE event_type <> (SELECT min(event_type) FROM events) ORDER BY event_id DESC LIMIT 1""",
    "merged_ranges": """WITH r AS (SELECT l_suppkey AS key, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS s, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) + l_linenumber AS e FROM lineitem),
      g AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM r),
      n AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM g)
      SELECT key, CAST(min(s) AS INTEGER) AS start, CAST(max(e) AS INTEGER) AS "end" FROM n GROUP BY key, run""",
    "newest_per_group": "SELECT o_custkey, o_orderkey, o_orderdate, CAST(nth AS INTEGER) AS nth FROM (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS nth FROM orders) WHERE nth <= 2",
    "cascade_delete": "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
    "span_normalize": f"SELECT doc_id, md5({NORMAL.format('text')}) AS normal FROM documents",
    "content_word_overlap": f"""WITH w AS (SELECT item_id, trim(unnest(regexp_extract_all(lower(regexp_replace(translate(text, '‘’', ''''''), '\\p{{Pd}}', '-', 'g')), '[a-z0-9'']+')), '''') AS w FROM benchmark),
      s AS (SELECT DISTINCT item_id, {STEM} AS word FROM w WHERE length(w) >= 3 AND w NOT IN ({', '.join("'" + x.replace("'", "''") + "'" for x in STOPWORDS)}))
      SELECT a.item_id AS a, b.item_id AS b, count(*) AS shared FROM s a JOIN s b ON a.word = b.word AND a.item_id < b.item_id GROUP BY ALL""",
    "chunk_pack": """WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(0, len(string_split(text, chr(10))))) AS line FROM documents),
      b AS (SELECT doc_id, trim(raw) AS block, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS k, len(regexp_extract_all(raw, '[\\pL\\pM\\p{Nd}\\p{Nl}\\p{Pc}]+|[^\\pL\\pM\\p{Nd}\\p{Nl}\\p{Pc}\\s\\pZ]')) AS t FROM l WHERE trim(raw) <> ''),
      p AS (SELECT doc_id, k, t, length(block) AS n, sum(t) OVER w AS upto, sum(length(block)) OVER w AS chars, count(*) OVER (PARTITION BY doc_id) AS m FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
      ends AS (SELECT a.doc_id, a.k, a.m, max(CASE WHEN z.k = a.k OR z.upto - a.upto + a.t + z.k - a.k <= 512 THEN z.k END) AS e FROM p a JOIN p z ON a.doc_id = z.doc_id AND z.k BETWEEN a.k AND a.k + 512 GROUP BY ALL),
      -- where the next range begins: back over the blocks of at most 64 tokens together, over one at least if there are several
      nexts AS (SELECT s.doc_id, s.k, s.e, s.m, CASE WHEN s.e = s.k THEN s.e + 1 ELSE least(s.e, min(CASE WHEN z.k = s.e OR y.upto - z.upto + z.t <= 64 THEN z.k END)) END AS nxt
        FROM ends s JOIN p y ON y.doc_id = s.doc_id AND y.k = s.e JOIN p z ON z.doc_id = s.doc_id AND z.k > s.k AND z.k <= s.e GROUP BY s.doc_id, s.k, s.e, s.m
        UNION ALL SELECT doc_id, k, e, m, e + 1 FROM ends WHERE e = k),
      r AS (SELECT doc_id, 0 AS i, k, e, m, nxt FROM nexts WHERE k = 1
        UNION ALL SELECT r.doc_id, r.i + 1, x.k, x.e, x.m, x.nxt FROM r JOIN nexts x ON x.doc_id = r.doc_id AND x.k = r.nxt WHERE r.e < r.m)
      SELECT substr(sha256(doc_id || '||' || i), 1, 16) AS chunk_id, CAST(doc_id AS VARCHAR) AS accession, i AS "index", 1 AS first_page, 1 AS last_page,
        CAST(z.upto - a.upto + a.t AS INTEGER) AS tokens, CAST(z.chars - a.chars + a.n + r.e - r.k AS INTEGER) AS n_chars
      FROM r JOIN p a USING (doc_id, k) JOIN p z ON z.doc_id = r.doc_id AND z.k = r.e""",
    "numeric_match": """SELECT same, count(*) AS n FROM (SELECT CASE WHEN a = 0 OR b = 0 THEN a = b ELSE abs(a - b) <= 0.001 * greatest(abs(a), abs(b)) END AS same FROM (
      SELECT CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS a, CAST(CAST(l_extendedprice * (1 - l_discount / 50) AS DECIMAL(18,2)) AS DOUBLE) AS b FROM lineitem)) GROUP BY same""",
    "person_match": "SELECT c_custkey AS k, true AS same FROM customer",
    "company_match": "SELECT p_partkey AS k, p_partkey % 2 = 0 AS same FROM part",
}

_PARTS = "(VALUES (0, '1', '1', 'Business'), (1, '1A', '1A', 'Risk Factors'), (2, '2', '2', 'PROPERTIES'), (3, '3', '3', 'Legal Proceedings'), (4, '5', '5,6', 'Market and Data'), (5, '7', '7', NULL), (6, '9A', '9A', 'Controls and Procedures'), (7, '15', '15', 'Exhibits')) p(i, item, covers, title)"
ORACLE["sections"] = f"""WITH n AS (SELECT CAST(doc_id AS VARCHAR) AS accession, 2 + len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents)
  SELECT accession, item, covers, coalesce(title, 'The registrant describes in this part what it does and how it does it, in words that fill the part with more than two hundred characters, so that a heading is backed by a body, as it is in a report and not in a contents table') AS title,
    CAST(9 + i * n AS INTEGER) AS start_line, CAST(9 + (i + 1) * n AS INTEGER) AS end_line FROM n, {_PARTS}
  UNION ALL SELECT accession, '', '', '', 0, 9 FROM n UNION ALL SELECT accession, '', '', '', CAST(9 + 8 * n AS INTEGER), CAST(11 + 8 * n AS INTEGER) FROM n"""
ORACLE |= records.SQL
