"""streaming of the log-analytics library."""
