"""streaming of the wide-event engine."""
