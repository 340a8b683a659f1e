"""Operators on document collections."""
