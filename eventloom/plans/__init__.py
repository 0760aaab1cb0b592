"""plans of the wide-event engine."""
