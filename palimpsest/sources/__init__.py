"""Sources and sinks: schema-drifting files, text, shards, and content-addressed storage."""
