"""Log analytics on Spark: sources, search, detections, correlation and entity graphs as DataFrame operations."""
