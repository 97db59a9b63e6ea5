"""Multi-channel signal analytics as Spark DataFrame jobs."""
