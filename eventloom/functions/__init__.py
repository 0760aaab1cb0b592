"""functions of the wide-event engine."""
