"""Table readers, page and feed parsers, and the Parquet ledger."""
