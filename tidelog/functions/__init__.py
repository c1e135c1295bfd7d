"""functions of the log-analytics library."""
