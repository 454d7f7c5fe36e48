"""Sources and sinks: readings adapters, files, in-memory samples."""
