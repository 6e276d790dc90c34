"""Relational operators on the activity tables."""
