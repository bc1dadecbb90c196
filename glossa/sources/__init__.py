"""Sources and sinks: key sets and stored dictionaries."""
