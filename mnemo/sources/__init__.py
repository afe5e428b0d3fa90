"""Readers and the change-log warehouse."""
