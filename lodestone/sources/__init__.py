"""Sources and sinks: tables, JSON lines, token shards, scratch tables."""
