"""sources of the wide-event engine."""
