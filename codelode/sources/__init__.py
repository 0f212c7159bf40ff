"""Sources: parquet tables and source trees."""
