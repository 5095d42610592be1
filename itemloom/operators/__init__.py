"""Reads and writes on tables: lazily as DataFrames (frame), or by request and response (api)."""
