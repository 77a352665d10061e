"""The operators, by name."""

from . import aggregate, columns, prep, reshape, rows, sequence  # noqa: F401
from .base import OPS, ROW, Context, Op, OpError, op  # noqa: F401
