"""Grouped aggregates, frequencies, statistics per column."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import quoted
from ..functions.text import as_text, general
from .base import Context, OpError, kinds, number, op, size_of, visible


@op("group-agg", "group_agg", required=("aggs",))
def group_agg(ctx: Context, df: DataFrame, args: dict) -> DataFrame:
    """count counts rows, nulls too; sum, avg, min and max of a group without numbers are 0. Results are doubles; null is a group of its own."""
    kind, out = kinds(df), []
    for a in args["aggs"]:
        func, name = a["func"], a.get("name") or a.get("result") or f"{a['column']}_{a['func']}"
        x = number(df, a["column"], "group-agg") if kind.get(a["column"]) in ("int", "float", "date", "timestamp") else F.lit(0.0)
        if func in ("sum", "avg", "min", "max"):
            c = F.coalesce({"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[func](x), F.lit(0.0))
        elif func in ("stddev", "var", "median"):
            c = {"stddev": F.stddev_samp, "var": F.var_samp, "median": F.median}[func](x)
        else:
            c = F.count(F.lit(1)).cast("double")
        out.append(c.alias(name))
    ctx.order = []
    return df.groupBy(*[quoted(c) for c in args.get("group_by") or []]).agg(*out)


@op("frequency")
def frequency(ctx: Context, df: DataFrame, args: dict) -> DataFrame:
    """value (text) and count, most frequent first; several columns are joined by \\x01, null is \\N."""
    kind = kinds(df)
    cols = [c for c in args.get("columns") or visible(df) if c in kind]
    key = F.concat_ws("\x01", *[F.coalesce(as_text(quoted(c), kind[c]).cast("string"), F.lit("\\N")) for c in cols])
    ctx.order = [("count", True), ("value", False)]
    return df.groupBy(key.alias("value")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "value")


MEASURES = ("count", "sum", "avg", "min", "max", "var", "stddev", "median", "p25", "p75", "skewness", "kurtosis", "distinct", "hist", "sample")
DEFAULT = ("count", "sum", "avg", "min", "max", "var", "stddev", "median")
BINS = 32


def _text(df: DataFrame, c: str) -> Column:
    return as_text(quoted(c), kinds(df)[c]).cast("string")


def samples(df: DataFrame, cols: list[str], n: int = 10) -> DataFrame:
    """One row with, for each column, the n distinct texts of smallest MD5, joined by commas: the same however the rows are dealt.

    Values are made distinct before they meet, and a task passes on n of a column at most.
    """
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), _text(df, c).alias("t")) for i, c in enumerate(cols)])
    each = df.select(F.explode(pairs).alias("p")).select("p.i", "p.t").where("t is not null").groupBy("i", "t").agg(F.md5(F.col("t").cast("binary")).alias("h"))
    few = each.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy("h", "t"))).where(F.col("r") <= n)
    lists = few.groupBy("i").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "t"))), lambda s: s["t"]), ",").alias("s"))
    return lists.agg(*[F.max(F.when(F.col("i") == i, F.col("s"))).alias(f"m{i}_sample") for i in range(len(cols))])


#: Below this estimated size of the input, quantiles are taken from one buffer of all distinct values of a column.
QUANTILE_BYTES = 64 << 20


def quantiles(df: DataFrame, values: dict[str, Column], shares: list[float], block: int = 1_000_000, sampled: int = 400_000) -> dict[str, dict[float, float | None]]:
    """Exact quantiles (linear between neighbours) of each value, with no task that holds a whole column.

    Each rank asked for is enclosed by values of a sample, and the rows below and at these are counted: either it is such a value, or it lies strictly between two of them, and
    only rows there are looked at from then on. When they are `block` at most, they are counted value by value and sorted up to the rank. Samples only say where to look.
    """
    xs = list(values)
    d = df.select(*[F.nanvl(v, F.lit(None)).alias(x) for x, v in values.items()])
    # of NaN, which comes last, only the number matters
    sizes = df.agg(*[F.struct(F.count(v).alias("n"), F.count_if(v.isNotNull() & ~F.isnan(v)).alias("some")) for v in values.values()]).first()
    at: dict[tuple[int, float], tuple[int, float]] = {}
    found: dict[tuple[int, int], float] = {}
    #: By (column, rank): the values on both sides that are out, rows up to the lower one, rows between.
    left: dict[tuple[int, int], tuple] = {}
    for i, s in enumerate(sizes):
        for q in shares if s.n else ():
            pos = q * (s.n - 1)
            at[i, q] = int(pos), pos - int(pos)
            for rank in {int(pos), min(int(pos) + 1, s.n - 1)}:
                if rank < s.some:
                    left[i, rank] = None, None, 0, s.some
                else:
                    found[i, rank] = float("nan")

    def between(i: int, low: float | None, high: float | None) -> Column:
        x = F.col(f"`{xs[i]}`")
        return (x.isNotNull() if low is None else x > F.lit(low)) & (F.lit(True) if high is None else x < F.lit(high))

    def within(keys: list) -> tuple[DataFrame, Column]:
        """Rows between the bounds of any of these (column, rank), and for a row (number, value) where it is between those of one."""
        inside = [between(k[0], *left[k][:2]) for k in keys]
        pairs = [F.when(hit, F.struct(F.lit(j).alias("j"), F.col(f"`{xs[k[0]]}`").alias("x"))) for j, (k, hit) in enumerate(zip(keys, inside))]
        return d.where(reduce(lambda a, b: a | b, inside)), F.array_compact(F.array(*pairs))

    while large := [k for k in left if left[k][3] > block]:
        m = max(1000, sampled // len(large))
        rows, pairs = within(large)
        seen: dict[int, list[float]] = {}
        part = min(1.0, m / max(left[k][3] for k in large))
        for r in (rows.sample(part, seed=17) if part < 1 else rows).select(F.explode(pairs).alias("s")).select("s.*").collect():
            seen.setdefault(r.j, []).append(r.x)
        cuts: dict[tuple[int, int], list[float]] = {}
        for j, k in enumerate(large):
            if got := sorted(seen.get(j, [])):
                where = (k[1] - left[k][2]) / left[k][3] * len(got)
                off = 4 * math.sqrt(len(got)) / 2 + 1
                cuts[k] = sorted({got[min(len(got) - 1, max(0, int(p)))] for p in (where - off, where, where + off)})
        counts = [F.struct(F.count_if(between(k[0], left[k][0], c)).alias("less"), F.count_if(F.col(f"`{xs[k[0]]}`") == F.lit(c)).alias("same")) for k, cs in cuts.items() for c in cs]
        told = iter(rows.agg(*counts).first() if counts else ())
        for k, cs in cuts.items():
            low, high, before, size = left.pop(k)
            end, first = before + size, before
            for c, r in [(c, next(told)) for c in cs]:
                if k[1] < first + r.less:
                    high, end = c, first + r.less
                    break
                if k[1] < first + r.less + r.same:
                    found[k] = c
                    break
                low, before = c, first + r.less + r.same
            if k not in found:
                left[k] = low, high, before, end - before
    if left:
        keys = list(left)
        rows, pairs = within(keys)
        each = rows.select(F.explode(pairs).alias("s")).select("s.*").groupBy("j", "x").count()
        each = each.withColumn("to", F.sum("count").over(Window.partitionBy("j").orderBy("x")))
        rank = F.element_at(F.array(*[F.lit(k[1] - left[k][2]) for k in keys]), F.col("j") + 1)
        for r in each.where((F.col("to") > rank) & (F.col("to") - F.col("count") <= rank)).collect():
            found[keys[r.j]] = r.x
    out: dict[str, dict[float, float | None]] = {}
    for i, x in enumerate(xs):
        out[x] = {}
        for q in shares:
            low, part = at.get((i, q), (None, 0.0))
            if low is None:
                out[x][q] = None
            else:
                a = found[i, low]
                out[x][q] = a if not part else a + part * (found[i, low + 1] - a)
    return out


@op("stats")
def stats(ctx: Context, df: DataFrame, args: dict) -> DataFrame:
    """One row per column with the chosen measures in a fixed order; texts have count, distinct and sample only.

    Quantiles are exact, or approximate with approx=true; distinct is approximate unless exact=true. All columns are
    measured in one aggregate. Beside it, hist needs the bounds first, quantiles of inputs above QUANTILE_BYTES take a few passes over the columns, and sample one: its
    texts are the ten of smallest MD5.
    """
    want = [m for m in MEASURES if m in (args.get("stats") or args.get("columns") or DEFAULT)] or list(DEFAULT)
    cols, kind = visible(df), kinds(df)
    if not cols:
        raise OpError("stats: no columns")
    numeric = [c for c in cols if kind[c] in ("int", "float", "date", "timestamp")]
    shares = {m: q for m, q in (("median", 0.5), ("p25", 0.25), ("p75", 0.75)) if m in want}
    exact: dict[str, dict] | None = None
    if shares and numeric and not args.get("approx") and size_of(df.select(*[quoted(c) for c in numeric])) > args.get("quantile_bytes", QUANTILE_BYTES):
        exact = quantiles(df, {c: number(df, c, "stats") for c in numeric}, list(shares.values()))
    bounds = {}
    if "hist" in want and numeric:
        row = df.agg(*[F.struct(F.min(number(df, c, "stats")).alias("lo"), F.max(number(df, c, "stats")).alias("hi")).alias(f"c{i}") for i, c in enumerate(numeric)]).first()
        bounds = dict(zip(numeric, row))

    def measure(c: str, m: str) -> Column:
        if m == "count":
            return F.count(quoted(c))
        if m == "distinct":
            return F.count_distinct(quoted(c)) if args.get("exact") else F.approx_count_distinct(quoted(c), 0.0325)
        if c not in numeric:
            return F.max(F.lit(None).cast("string" if m == "hist" else "double"))
        x = number(df, c, "stats")
        if m in shares:
            if exact is not None:
                return F.max(F.lit(exact[c][shares[m]]).cast("double"))
            return F.percentile_approx(x, shares[m], 10000).cast("double") if args.get("approx") else F.percentile(x, shares[m])
        if m == "hist":
            lo, hi = bounds[c]
            if lo is None or lo == hi:
                return F.max(F.lit(None).cast("string"))
            at = F.least(F.floor((x - lo) / ((hi - lo) / BINS)), F.lit(BINS - 1))
            counts = [F.count_if(at == k).cast("string") for k in range(BINS)]
            return F.concat(general(F.lit(float(lo))), F.lit(":"), general(F.lit(float(hi))), F.lit(":"), F.concat_ws(",", *counts))
        if m == "skewness":
            return F.when(F.count(x) >= 3, F.when(F.var_samp(x) <= 1e-15, 0.0).otherwise(F.skewness(x)))
        if m == "kurtosis":
            return F.when(F.count(x) >= 4, F.when(F.var_samp(x) <= 1e-15, 0.0).otherwise(F.kurtosis(x)))
        return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "var": F.var_samp, "stddev": F.stddev_samp}[m](x)

    row = df.agg(F.count(F.lit(1)).alias("__n"), *[measure(c, m).alias(f"m{i}_{m}") for i, c in enumerate(cols) for m in want if m != "sample"])
    if "sample" in want:
        row = row.crossJoin(F.broadcast(samples(df, cols)))  # one row each
    lines = F.array(*[F.struct(F.lit(i).alias("__i"), F.lit(c).alias("column"), *[F.col(f"m{i}_{m}").alias(m) for m in want]) for i, c in enumerate(cols)])
    ctx.order = [("__i", False)]
    return row.select(F.explode(lines).alias("l")).select("l.column", *[f"l.{m}" for m in want], "l.__i")
