"""tempoframe: event-sequence and signal analytics on Spark DataFrames."""

from tempoframe.session import build_session

__all__ = ["build_session"]
