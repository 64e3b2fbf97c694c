"""Record tables from Parquet, views over interfaces and types, JSON documents and archives."""
