"""Where tables come from and go to."""

from .files import read_csv, read_parquet, register, write_csv, write_parquet

__all__ = ["read_csv", "read_parquet", "register", "write_csv", "write_parquet"]
