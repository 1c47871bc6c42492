"""Operators over words, ranges, signals and versions, keyed by media_id."""
