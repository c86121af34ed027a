"""Feature pipelines and the registered query catalogue."""
