"""Operators on DataFrames keyed by ``track_id``; all windows share that partitioning."""
