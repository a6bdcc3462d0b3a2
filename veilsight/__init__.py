"""veilsight: threat-indicator extraction and analytics as Spark jobs."""
