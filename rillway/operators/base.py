"""Registry and context of the operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import kind_of, quoted


class OpError(ValueError):
    pass


@dataclass
class Op:
    name: str
    apply: Callable[[Context, DataFrame, dict], DataFrame]
    required: tuple[str, ...] = ()
    #: Works row by row.
    stateless: bool = False
    #: Works along the order with a state of bounded size, so that a stream can hand it on.
    stateful: bool = False
    #: What a task holds does not grow with the input.
    bounded: bool = True
    #: Gives the same result each time.
    deterministic: bool = True
    #: Reads a second input.
    files: bool = False


OPS: dict[str, Op] = {}


def op(*names: str, required: tuple[str, ...] = (), **flags: bool):
    def add(f):
        for n in names:
            OPS[n] = Op(n, f, required, **flags)
        return f

    return add


#: Hidden order column that file readers add.
ROW = "__row"


@dataclass
class Context:
    """What operators share: the order of rows, side channels and parameters.

    order: (column, descending) pairs that fix the order of rows, which Spark itself doesn't have.
    """

    spark: SparkSession
    order: list[tuple[str, bool]] = field(default_factory=list)
    errors: list[dict] = field(default_factory=list)
    counts: list[tuple[str, object]] = field(default_factory=list)
    stack: list[str] = field(default_factory=list)
    #: Rows, and bytes as the optimizer estimates them, of one range of the sequence operators.
    block: int = 1_000_000
    block_bytes: int = 256 << 20
    max_categories: int = 1000
    #: Where the ranges of an order begin; they only balance the work, so they stay good for any later rows.
    cuts: dict[tuple, list] = field(default_factory=dict)
    #: The order that the ranges in the DataFrame at hand follow.
    ranged: tuple | None = None
    #: In a stream: what the operators have seen in the batches before, by place in the plan and name; None in a batch.
    memory: dict | None = None
    place: int = 0

    def seen(self) -> dict:
        return (self.memory or {}).get(self.place, {})

    def remember(self, name: str, value) -> None:
        if self.memory is not None:
            self.memory.setdefault(self.place, {})[name] = value

    def sorting(self, what: str, back: bool = False) -> list[Column]:
        if not self.order:
            raise OpError(f"{what} depends on the order of rows: give an order key, or sort before")
        return [quoted(c).desc_nulls_last() if d != back else quoted(c).asc_nulls_last() if not back else quoted(c).asc_nulls_first() for c, d in self.order]

    def key(self) -> Column:
        """The order key as one sortable value; only for ascending keys."""
        return F.struct(*[quoted(c) for c, _ in self.order])


def kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: kind_of(f.dataType) for f in df.schema.fields}


def visible(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("__")]


def need(df: DataFrame, column: str, what: str) -> str:
    if column not in df.columns:
        raise OpError(f"{what}: no column {column!r}")
    return kinds(df)[column]


def number(df: DataFrame, column: str, what: str) -> Column:
    """The column as a double; dates as days, timestamps as microseconds."""
    kind = need(df, column, what)
    c = quoted(column)
    if kind == "date":
        return F.unix_date(c).cast("double")
    if kind == "timestamp":
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if kind in ("int", "float"):
        return c.cast("double")
    if kind == "null":
        return F.lit(None).cast("double")
    raise OpError(f"{what}: column {column!r} holds no numbers")


def size_of(df: DataFrame) -> int:
    """Bytes of df as the optimizer estimates them, from the sizes of the files below."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
