"""Functions on records."""
