"""Space-time panel, outlier and discourse analytics as Spark DataFrame jobs."""
