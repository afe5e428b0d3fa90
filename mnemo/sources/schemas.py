"""Tables of the engine; times are epoch seconds."""

from __future__ import annotations

# Columns and types by table.
SCHEMAS = {
    "documents": "id string, container_tag string, source string, title string, reference string, canonical_url string, content_hash string, blob_key string, captured_at bigint, source_published_at bigint, processing_state string, error string, created_at bigint",
    "chunks": "id string, document_id string, container_tag string, chunk_index int, content string, char_start int, char_end int, embed_model string, dim int, embedding array<float>",
    "memories": "id string, container_tag string, kind string, statement string, confidence double, is_latest boolean, needs_review boolean, supersedes string, superseded_by string, extends string, event_from bigint, event_to bigint, valid_until bigint, learned_at bigint, document_id string, created_at bigint, superseded_at bigint, embedding array<float>",
    "memory_evidence": "id string, memory_id string, document_id string, chunk_id string, char_start int, char_end int, quote string, extractor string",
    "edges": "id string, container_tag string, subject string, predicate string, object string, valid_from bigint, valid_to bigint, singular boolean, is_latest boolean, captured_at bigint, document_id string, statement string, embedding array<float>",
    "jobs": "id string, container_tag string, kind string, state string, progress bigint, total bigint, error string, created_at bigint, updated_at bigint",
    "audit_events": "id string, actor string, container_tag string, action string, target_id string, request_id string, ts bigint",
    "acl_entries": "id string, principal string, scope string, capability string, created_at bigint",
    "profiles": "id string, container_tag string, static_text string, dynamic_text string, computed_at bigint",
    "entity_aliases": "id string, container_tag string, alias string, canonical string, created_at bigint",
}
