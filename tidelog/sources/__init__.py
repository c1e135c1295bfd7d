"""sources of the log-analytics library."""
