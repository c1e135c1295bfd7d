"""plans of the log-analytics library."""
