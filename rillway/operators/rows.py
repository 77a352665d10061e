"""Filters, limits, order, samples, first rows per key."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import compile_expr, quoted, truthy
from .base import Context, kinds, op, visible
from .sequence import dense_index


@op("filter", required=("expr",), stateless=True)
def filter_(ctx: Context, df: DataFrame, args: dict) -> DataFrame:
    """Rows whose expression is true; any value that is neither null nor false counts as true, 0 too."""
    return df.filter(truthy(compile_expr(args["expr"], df.schema)))


@op("validate", required=("expr",), stateless=True)
def validate(ctx: Context, df: DataFrame, args: dict) -> DataFrame:
    return df.withColumn("_valid", truthy(compile_expr(args["expr"], df.schema)))


_POSIX = {"alpha": r"\p{Alpha}", "digit": r"\d", "alnum": r"\p{Alnum}", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "space": r"\s", "punct": r"\p{Punct}", "xdigit": r"\p{XDigit}", "blank": r" \t", "cntrl": r"\p{Cntrl}", "print": r"\p{Print}", "graph": r"\p{Graph}"}


def java_regex(pattern: str) -> str:
    """A POSIX extended expression in Java's syntax. Alternatives are tried in order, not by length."""
    return re.sub(r"\[:(\w+):\]", lambda m: _POSIX.get(m[1], m[0]), pattern)


@op("grep", required=("pattern",), stateless=True)
def grep(ctx: Context, df: DataFrame, args: dict) -> DataFrame:
    """Rows whose text column holds the pattern; null and other types never do, so invert keeps them."""
    column = args.get("column") or "_line"
    hit = F.lit(False)
    if kinds(df).get(column) == "string":
        c = quoted(column)
        hit = c.rlike(java_regex(args["pattern"])) if args.get("regex") else c.contains(F.lit(args["pattern"]))
        hit = F.coalesce(hit, F.lit(False))
    return df.filter(~hit if args.get("invert") else hit)


@op("head", stateful=True)
def head(ctx: Context, df: DataFrame, args: dict) -> DataFrame:
    n = max(0, int(args["n"]) - ctx.seen().get("rows", 0))
    out = df.orderBy(*ctx.sorting("head")).limit(n)
    if ctx.memory is not None:
        ctx.remember("rows", ctx.seen().get("rows", 0) + df.limit(n).count())
    return out


@op("skip", stateful=True)
def skip(ctx: Context, df: DataFrame, args: dict) -> DataFrame:
    return dense_index(ctx, df, "__i").where(F.col("__i") >= int(args["n"])).drop("__i")


@op("tail", required=("n",))
def tail(ctx: Context, df: DataFrame, args: dict) -> DataFrame:
    return df.orderBy(*ctx.sorting("tail", back=True)).limit(int(args["n"])).orderBy(*ctx.sorting("tail"))


@op("sort", required=("columns",))
def sort(ctx: Context, df: DataFrame, args: dict) -> DataFrame:
    """Nulls last both ways; unknown columns are ignored; equal rows keep the order they had."""
    keys = [(c["name"], bool(c.get("desc"))) if isinstance(c, dict) else (c.lstrip("+-"), c.startswith("-")) for c in args["columns"]]
    keys = [k for k in keys if k[0] in df.columns]
    ctx.order = keys + [k for k in ctx.order if k[0] not in {n for n, _ in keys}]
    return df.orderBy(*ctx.sorting("sort")) if keys else df


@op("top", required=("n", "column"))
def top(ctx: Context, df: DataFrame, args: dict) -> DataFrame:
    """The n largest (or smallest) values, in that order. A null counts as -1e308, a text as 0; ties keep the earlier row."""
    kind = kinds(df).get(args["column"])
    c = quoted(args["column"]).cast("double") if kind in ("int", "float") else F.lit(0.0) if kind else F.lit(-1e308)
    rank = next(n for k in range(len(df.columns) + 1) if (n := f"__top{k}") not in df.columns)
    desc = bool(args.get("desc", True))
    df = df.withColumn(rank, F.coalesce(c, F.lit(-1e308)))
    ctx.order = [(rank, desc), *ctx.order]
    return df.orderBy(*ctx.sorting("top")).limit(int(args["n"]))


@op("sample", required=("n",), deterministic=False)
def sample(ctx: Context, df: DataFrame, args: dict) -> DataFrame:
    """n rows at random, without replacement: the smallest of random numbers. With a seed and an order these are the numbers of split-data, so the
    sample is the same however the rows are dealt."""
    if args.get("seed") is not None and ctx.order:
        df = dense_index(ctx, df, "__i")
        return df.withColumn("__r", uniform(F.col("__i"), int(args["seed"]))).orderBy("__r", "__i").limit(int(args["n"])).drop("__r", "__i")
    return df.withColumn("__r", F.rand(args.get("seed"))).orderBy("__r").limit(int(args["n"])).drop("__r")


@op("unique", "dedup")
def unique(ctx: Context, df: DataFrame, args: dict) -> DataFrame:
    """The first row of each key; nulls equal one another. Without columns the whole row is the key."""
    cols = args.get("columns") or visible(df)
    cols = [c for c in cols if c in df.columns]
    if set(cols) == set(df.columns) or not ctx.order:
        return df.dropDuplicates(cols)
    if any(d for _, d in ctx.order):
        w = Window.partitionBy(*map(quoted, cols)).orderBy(*ctx.sorting("unique"))
        return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    # a minimum is combined before the shuffle, so a frequent key costs no more than another
    row = F.struct(*[quoted(c) for c in df.columns])
    return df.groupBy(*[quoted(c).alias(f"__k{i}") for i, c in enumerate(cols)]).agg(F.min_by(row, ctx.key()).alias("__row_")).select("__row_.*")


@op("split-data", "split_data", stateful=True)
def split_data(ctx: Context, df: DataFrame, args: dict) -> DataFrame:
    """`train` or `test` by a linear congruential number of the seed and the place of the row."""
    ratio, seed = float(args.get("ratio", 0.8)), int(args.get("seed", 42))
    df = dense_index(ctx, df, "__i")
    out = uniform(F.col("__i"), seed)
    return df.withColumn(args.get("result") or "_split", F.when(out < ratio, "train").otherwise("test")).drop("__i")


# fixed values: multiplier and increment of the 64-bit congruential generator
LCG = (6364136223846793005, 1442695040888963407)


def uniform(i, seed: int):
    """A number of [0, 1) for a place and a seed: three rounds x * a + c modulo 2^64, the first from the place and then
    xor the seed; of the last the upper 31 bits. Longs never overflow: a value is four digits of 16 bits."""
    m = F.lit(0xFFFF).cast("bigint")
    a, c, s = ([(v >> (16 * k)) & 0xFFFF for k in range(4)] for v in (*LCG, seed % 2**64))
    names = [f"d{k}" for k in range(4)]

    def digits(values):
        return F.struct(*[v.cast("bigint").alias(n) for n, v in zip(names, values)])

    def turn(x, k):
        low, carry = [], F.lit(c[0]).cast("bigint")
        for place in range(4):
            total = carry
            for j in range(place + 1):
                total = total + x[names[j]] * F.lit(a[place - j]).cast("bigint")
            low.append(total.bitwiseAND(m))
            carry = F.shiftright(total, 16) + F.lit(c[place + 1] if place < 3 else 0)
        return digits([F.when(k == 0, d.bitwiseXOR(F.lit(v).cast("bigint"))).otherwise(d) for d, v in zip(low, s)])

    start = digits([F.shiftright(i, 16 * k).bitwiseAND(m) for k in range(4)])
    high = F.aggregate(F.array(F.lit(0), F.lit(1), F.lit(2)), start, turn, lambda x: x["d3"] * 32768 + F.shiftright(x["d2"], 1))
    return high / F.lit(float(1 << 31))
