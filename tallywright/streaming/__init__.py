"""Operators on streams of arriving rows."""
