"""Part of pointweave."""
