"""Incremental analysis of tracks that arrive in pieces."""
