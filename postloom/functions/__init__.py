"""Part of the posting engine."""
