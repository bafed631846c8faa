"""Quern: an analytical SQL engine on PySpark."""

__version__ = "0.1.0"
