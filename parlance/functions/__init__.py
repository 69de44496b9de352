"""Part of parlance."""
