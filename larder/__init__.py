"""Purchase analytics for a grocery star schema, as PySpark DataFrame jobs."""
