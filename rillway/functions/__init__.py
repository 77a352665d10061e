from .expr import ExprError, compile_expr, parse, truthy  # noqa: F401
