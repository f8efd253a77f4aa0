"""Document-to-ledger analytics expressed as Spark DataFrame, SQL and Structured Streaming jobs."""
