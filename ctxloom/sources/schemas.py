"""Schemas of the stored tables."""
BLOCKS = "block_id string, kind string, body binary, token_counts map<string,bigint>, priority float, created_at_ms bigint, updated_at_ms bigint, provenance struct<source:string,parents:array<string>,labels:array<string>>, content_hash string"
SESSION_BLOCKS = "session_id string, block_id string"
EDGES = "from_id string, to_id string, kind string"
HASH_INDEX = "content_hash string, block_id string"
TRACES = "call_id string, session_id string, model string, selected array<struct<block_id:string,score:double,reason:string>>, estimated_tokens bigint, prompt_tokens bigint, prompt_hash string, started_at_ms bigint, duration_ms bigint, model_version string, tokenizer_version string, output string, output_tokens bigint, version bigint"
EMBEDDINGS = "embedder string, content_hash string, dim int, vector array<float>, version bigint"
TABLES = {"blocks": BLOCKS, "session_blocks": SESSION_BLOCKS, "edges": EDGES, "hash_index": HASH_INDEX, "traces": TRACES, "embedding_cache": EMBEDDINGS}
