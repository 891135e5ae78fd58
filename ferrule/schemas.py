"""DDL of the logical tables."""

SOURCES = "id string, url string, kind string, category string, title string, parser string, tags array<string>"
DOCUMENTS = "id string, title string, url string, category string, tags array<string>, text string, source_type string"
CHUNKS = "chunk_id string, text string, source string, title string, page int, category string, source_url string, source_type string, chunk_index int, embedding array<float>"
POSTINGS = "chunk_id string, term string, tf int"
EVIDENCE = "sentence string, title string, source string, page int, source_type string, source_url string, match_type string, chunk_score double, reranker_score double, semantic_score double, definition_score double, score double, keyword_hits int, exact_phrase boolean, incomplete boolean"
TRIPLES = "s string, p string, o string, o_is_uri boolean, graph string"
NODES, EDGES = "id string, label string, type string", "id string, source string, target string, type string"
FACTS = "subject string, predicate string, object string, depth int, score double, source string, subject_uri string, object_uri string"
SOURCE_STATE = "url string, fingerprint string, fetched_at timestamp, status string"
RUNS = "run_id long, started_at timestamp, completed_at timestamp, status string, index_version string, changed_sources int, message string"
UPLOAD_STATUS = "id string, name string, status string, progress int, job_id string, message string, error string, uploaded_at timestamp, updated_at timestamp"
QUERY_LOG = "ts timestamp, question string, intent string, latency_s double, answer string, metadata string"
GOLDEN = "question string, ground_truth string, context array<string>"
QUERIES = "query_id long, query string, history array<struct<role:string,content:string>>, answer_mode string"
