"""ledgerloom: document-archive analytics expressed as Spark jobs."""
