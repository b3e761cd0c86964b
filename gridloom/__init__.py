"""Grid time-series analytics as Spark jobs."""
