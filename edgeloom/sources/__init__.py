"""Readers and writers for the JSON, CSV, text and Parquet layouts."""
