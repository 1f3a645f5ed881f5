"""Sources and sinks of tables."""
