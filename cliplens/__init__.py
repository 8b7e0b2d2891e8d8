"""cliplens: content analytics as Spark DataFrame jobs."""
