"""Change feeds."""
