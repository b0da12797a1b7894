"""Media-catalogue and access-log analytics as PySpark jobs."""
