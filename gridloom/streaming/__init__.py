"""Submitting work without waiting for it: events, barriers, concurrent jobs. The engine has no event-time streams."""
