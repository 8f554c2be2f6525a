"""Scalar expressions and the function registry."""

from weftline.functions.registry import FunctionRegistry, UserDefinedAggregate
from weftline.functions.scalar import average, choose, count_rows, divide, int_divide, remainder

__all__ = ["FunctionRegistry", "UserDefinedAggregate", "average", "choose", "count_rows", "divide", "int_divide", "remainder"]
