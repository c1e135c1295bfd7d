"""operators of the log-analytics library."""
