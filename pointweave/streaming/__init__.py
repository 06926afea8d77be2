"""Operators on streams: frames that arrive, are checked, registered and evaluated."""
