"""Versioned graphs: commits over Parquet layers."""
