"""Column functions."""

from .scalar import int_divide, int_equals, register_aggregate, register_functions, register_table_function

__all__ = ["int_divide", "int_equals", "register_aggregate", "register_functions", "register_table_function"]
