"""Sources and sinks: file scans (text, binary, image) and the index / metrics tables."""
