"""A memory engine for text on Spark: documents, chunks, dated facts and edges, searched, reconciled and read as of any time."""
