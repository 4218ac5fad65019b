"""News-feed analytics as PySpark DataFrame jobs."""
