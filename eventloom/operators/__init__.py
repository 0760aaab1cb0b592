"""operators of the wide-event engine."""
