"""Archive-catalog analytics expressed as PySpark DataFrame jobs."""
