"""Settlement-morphology analytics as PySpark DataFrame jobs."""
