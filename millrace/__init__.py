"""Event analytics, feature building, monitoring and retrieval as Spark jobs."""
