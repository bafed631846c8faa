"""Operators on DataFrames."""

from .joins import anti_join, band_join, salted_join, semi_join
from .multiway import multiway_join
from .ordering import key, top_k

__all__ = ["anti_join", "band_join", "key", "multiway_join", "salted_join", "semi_join", "top_k"]
