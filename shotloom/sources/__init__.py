"""Readers and writers: driver parquet tables, JSON/JSONL/text files, DDL scripts."""
