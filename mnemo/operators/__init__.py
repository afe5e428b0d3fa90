"""Operators on DataFrames: predicates, chunking, search, memory lifecycle, graph, tenancy and evaluation."""
