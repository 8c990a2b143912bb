"""Sources and sinks of code-scan data."""
