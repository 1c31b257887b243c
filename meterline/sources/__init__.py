"""Readers, and normalisers of raw log shapes into usage records."""
