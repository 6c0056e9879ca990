"""The record types of the engine as DDL; evaluated data is read with these, never by inference."""

from __future__ import annotations

CHUNKS = "chunk_id string, accession string, ticker string, period string, item string, title string, index int, first_page int, last_page int, tokens int, text string"
QUERIES = "query_id string, stratum string, query string, gold array<struct<accession:string,span:string,item:string,ticker:string>>"
RANKINGS = "query_id string, arm string, rank int, chunk_id string, score double"
RANKING_RECORDS = "query_id string, stratum string, tsquery string, arms map<string,array<struct<chunk_id:string,score:double>>>"
THRESHOLDS = "L int, queries int, bags int, tau double, min double, median double, mean double, max double, zero_scoring_bags int"
LABELS = "accession string, ticker string, period string, field string, status string, answer_kind string, value string, ambiguous boolean, note string, labeled_at string"
PREDICTIONS = "accession string, ticker string, period string, field string, value string"
FACTS = "accession string, name string, text string, value double, unit string, instant string, start string, end string, dims array<string>, offset int"
ANSWERS = "call_id string, query_id string, excerpt_ids array<string>, arms array<string>, raw string"
VERDICTS = "key string, verdict string, ambiguous boolean, note string, adjudicated_at string, query_sha256 string"
DECISIONS = "query_id string, verdict string, note string, query_sha256 string"
FILINGS = "accession string, ticker string, period string, fits_context_window boolean, tokens long"
REPORTS = "id string, filename string, status string, upload_date timestamp"
