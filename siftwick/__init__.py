"""Event search, detection and correlation on Spark."""
