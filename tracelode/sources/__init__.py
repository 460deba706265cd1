"""Readers for log files and Parquet tables."""
