"""Account-integrity analytics expressed as Spark DataFrame operations."""
