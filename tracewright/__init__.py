"""tracewright: trajectory analytics as composable Spark DataFrame transforms."""
