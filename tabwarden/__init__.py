"""Table quality checks, snapshot comparison and audit-log analytics on Spark."""
