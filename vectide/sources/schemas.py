"""Schemas of all tables; vectors are never inferred."""

CHUNKS = "id bigint, file_id bigint, chunk_text string, vector binary"
POINTS = "doc_id bigint, point_idx int, vec array<float>"
CLOUDS = "doc_id bigint, points array<array<float>>"
CORPUS = "_id string, title string, text string"
ASKED = "_id string, text string"
VECTOR_LINES = "_id string, vector array<float>, sentences array<array<float>>"
QRELS = "query_id string, doc_id string, rel int"
LATE = "id string, token_emb binary, mean_emb binary, n_tokens int"
DENSE = "id string, emb_fp16 binary"
CODEBOOK = "subspace int, centroid int, vec array<float>"
CODES = "doc_id bigint, point_idx int, codes array<int>"
POSTINGS = "subspace int, centroid int, doc_id bigint, point_idx int"
EDGES = "query_id bigint, src bigint, dst bigint, w double"
REFERENCES = "case_id bigint, statute_id bigint"
RESULTS = "query_id bigint, doc_id bigint, score double, rank bigint"
