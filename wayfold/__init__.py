"""wayfold: trajectory and event analytics as Spark DataFrame jobs."""
