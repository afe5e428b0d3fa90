"""Column functions: text, URLs, times and tolerant parsing."""
