"""Multi-tenant medallion analytics as plain Spark DataFrame jobs."""
