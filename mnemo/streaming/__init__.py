"""Structured Streaming entry to the batch jobs."""
