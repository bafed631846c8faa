"""Tables that grow."""

from .ingest import follow_csv

__all__ = ["follow_csv"]
