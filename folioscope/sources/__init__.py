"""Sources and sinks: table catalog, registry JSON, queues, dumps, and adapters for the supplied tables."""
