"""Sources and sinks: parquet tables, JSON corpora, result writers."""
