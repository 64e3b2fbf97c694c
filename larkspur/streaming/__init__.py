"""Event-time windows over streams: an extension, not part of the reference's language."""
