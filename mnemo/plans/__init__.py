"""Jobs composed of operators: ingest and retrieval."""
