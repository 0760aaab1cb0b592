"""sinks of the wide-event engine."""
