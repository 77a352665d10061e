"""Operators along the order of rows, without a single task for all of them.

Rows are dealt to ranges of the order key, all its columns together, cut at the keys of a sample; a range is about `block` rows. Within a range a window
works in order. What the ranges before hand on (sums, last values, the last few rows) is one small row a range: collected by a job over the
needed columns alone, joined up on the driver, and sent to all tasks. So each operator reads its input once for the result, shuffles it once, and
chains of operators keep the ranges they have: the shuffle is shared, and the plan grows with the number of operators only.

A table of one range needs neither: its window starts from nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import SPARK, quoted
from .base import Context, OpError, kinds, need, number, op, size_of, visible

RANGE = "__rng"
MAX_RANGES = 1 << 13
#: Sampled keys for each range.
SAMPLE = 32
#: Values that all ranges together may hand on as the rows before each of them.
MAX_TAILS = 1_000_000


def searched(reached: Callable[[Column], Column], cuts: Column, n: int) -> Column:
    """How many of n sorted cuts, an array of literals, are reached by a row: by halving."""

    def step(acc, _):
        mid = F.shiftright(acc["low"] + acc["high"], 1)
        more = acc["low"] < acc["high"]
        hit = more & reached(F.get(cuts, mid))
        return F.struct(F.when(hit, mid + 1).otherwise(acc["low"]).alias("low"), F.when(more & ~hit, mid).otherwise(acc["high"]).alias("high"))

    rounds = F.sequence(F.lit(1), F.lit(max(1, n.bit_length())))
    return F.aggregate(rounds, F.struct(F.lit(0).alias("low"), F.lit(n).alias("high")), step, lambda acc: acc["low"])


def ranged(ctx: Context, df: DataFrame) -> DataFrame:
    """df with the number of the range of each row, ascending along the order."""
    ctx.sorting("this operator")
    order = tuple(ctx.order)
    if RANGE in df.columns and ctx.ranged == order:
        return df
    df = df.drop(RANGE)
    k, (last, _, key) = next((k, found) for k in range(len(order), 0, -1) if (found := sort_key(ctx, df, k)))
    if order not in ctx.cuts:
        ctx.cuts[order] = _cuts(ctx, df, key, last is F.min_by)
    cuts = ctx.cuts[order]
    ctx.ranged = order
    if not cuts:
        return df.withColumn(RANGE, F.lit(0))
    kinds_ = [f.dataType for f in df.select(key.alias("k")).schema["k"].dataType.fields]
    fixed = F.array(*[F.struct(*[F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(cut, kinds_))]) for cut in cuts])
    return df.withColumn(RANGE, searched((lambda c: c >= key) if last is F.min_by else (lambda c: c <= key), fixed, len(cuts)))


def _cuts(ctx: Context, df: DataFrame, key: Column, down: bool) -> list[tuple]:
    n = df.count()
    row = min(size_of(df) / max(1, n), 1 << 14)
    ranges = min(MAX_RANGES, n // max(1, min(ctx.block, int(ctx.block_bytes / max(row, 1)))) + 1)
    if ranges <= 1:
        return []
    # bounded: a few keys for each range; they only balance the work, so any will do
    rows = df.select(key.alias("k")).sample(min(1.0, SAMPLE * ranges / n), seed=17).collect()
    rows = sorted((tuple(r.k) for r in rows if not any(v != v for v in r.k)), key=lambda t: [(v is not None, v) for v in t], reverse=down)
    picked = [rows[k * len(rows) // ranges] for k in range(1, ranges)] if rows else []
    return list(dict.fromkeys(picked))


def whole(ctx: Context) -> bool:
    """Whether one range is all there is."""
    return not ctx.cuts[tuple(ctx.order)] and ctx.memory is None


def inner(ctx: Context, *more: Column, back: bool = False):
    return Window.partitionBy(RANGE, *more).orderBy(*ctx.sorting("this operator", back=back))


def totals(df: DataFrame, aggs: dict[str, Column]) -> list:
    """One row a range, in order."""
    return df.groupBy(RANGE).agg(*[c.alias(n) for n, c in aggs.items()]).orderBy(RANGE).collect()


def carried(df: DataFrame, rows: list[dict], schema: str) -> DataFrame:
    """df with what is handed on to each range: at most MAX_RANGES rows."""
    names = [f.split(" ")[0] for f in schema.split(", ")]
    small = df.sparkSession.createDataFrame([tuple(r[n] for n in [RANGE, *names]) for r in rows], f"{RANGE} int, {schema}")
    return df.join(F.broadcast(small), RANGE)


def _done(df: DataFrame, keep: list[str], *new: str) -> DataFrame:
    keep = [c for c in keep if c not in new and c != RANGE]
    return df.select(*[quoted(c) for c in keep], *[quoted(c) for c in new], RANGE)


def dense_index(ctx: Context, df: DataFrame, name: str) -> DataFrame:
    """df with the place of each row in the order, from 0 on."""
    df = ranged(ctx, df)
    start = F.lit(ctx.seen().get("rows", 0)).cast("bigint")
    place = F.row_number().over(inner(ctx)).cast("bigint") - 1
    if whole(ctx):
        return df.withColumn(name, place)
    rows, before = [], 0
    for r in totals(df, {"n": F.count(F.lit(1))}):
        rows.append({RANGE: r[RANGE], "__before": before})
        before += r.n
    ctx.remember("rows", ctx.seen().get("rows", 0) + before)
    return carried(df, rows, "__before long").withColumn(name, start + place + F.col("__before")).drop("__before")


def sort_key(ctx: Context, df: DataFrame, columns: int | None = None) -> tuple[Callable, Callable, Column] | None:
    """(pick the last, pick the first, key) for aggregates along the order, or its first columns; None where texts run down beside other columns that run up."""
    order = ctx.order[:columns]
    named = lambda xs: F.struct(*[x.alias(f"k{i}") for i, x in enumerate(xs)])
    if all(d for _, d in order):
        return F.min_by, F.max_by, named([x for c, _ in order for x in (quoted(c).isNotNull(), quoted(c))])
    parts = []
    kind = kinds(df)
    for c, d in order:
        x = quoted(c)
        if d:
            if kind[c] == "string":
                return None
            x = F.unix_date(x) if kind[c] == "date" else F.unix_micros(x.cast("timestamp")) if kind[c] == "timestamp" else x.cast("double" if kind[c] == "float" else "int" if kind[c] == "bool" else "bigint")
            x = -x if kind[c] == "float" else F.bitwise_not(x)
        parts += [quoted(c).isNull(), x]
    return F.max_by, F.min_by, named(parts)


def lasts(ctx: Context, df: DataFrame, values: dict[str, Column]) -> list[dict]:
    """For each range, the last value that isn't null of the ranges before it."""
    key = sort_key(ctx, df)
    if key is None:
        df = dense_index(ctx, df, "__k")
        key = F.max_by, F.min_by, F.col("__k")
    rows = totals(df, {n: key[0](c, F.when(c.isNotNull(), key[2])) for n, c in values.items()})
    out, held = [], dict(ctx.seen().get("last", {}))
    for r in rows:
        out.append({RANGE: r[RANGE]} | {n: held.get(n) for n in values})
        held |= {n: r[n] for n in values if r[n] is not None}
    ctx.remember("last", held)
    return out


def tails(ctx: Context, df: DataFrame, n: int) -> dict[int, list]:
    """For each range, up to n values of __x (null ones left out before) of the rows before it, in order."""
    d = df.select(RANGE, "__x", *[quoted(c) for c, _ in ctx.order]).withColumn("__r", F.row_number().over(inner(ctx, back=True)))
    rows = d.where(F.col("__r") <= n).select(RANGE, "__r", "__x").collect()
    own: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r[0], -r[1])):
        own.setdefault(r[0], []).append(r[2])
    out, held = {}, list(ctx.seen().get("tail", []))
    for k in sorted(own):
        out[k] = held
        held = (held + own[k])[-n:] if n else []
    ctx.remember("tail", held)
    return out


STEPS = {"running-sum": "sum", "cumsum": "sum", "running-avg": "avg", "cumavg": "avg", "running-min": "min", "running-max": "max", "running-count": "count", "delta": "delta", "lag": "lag", "ratio": "ratio"}
UP = (Window.unboundedPreceding, Window.currentRow)


@op("step", required=("column", "func"), stateful=True)
def step(ctx: Context, df: DataFrame, args: dict) -> DataFrame:
    """A running value over the rows so far; a null row gives null and doesn't count."""
    func = STEPS.get(args["func"])
    if func is None:
        raise OpError(f"step: unknown function {args['func']}")
    name = args.get("result") or f"{args['column']}_{args['func']}"
    d = ranged(ctx, df.withColumn("__x", number(df, args["column"], "step")))
    x, keep = F.col("__x"), df.columns
    w = inner(ctx)
    if func in ("delta", "lag", "ratio"):
        prev = F.last(x, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        if not whole(ctx):
            d = carried(d, lasts(ctx, d, {"__p": x}), "__p double")
            prev = F.coalesce(prev, F.col("__p"))
        value = {"delta": lambda: x - prev, "ratio": lambda: F.try_divide(x, prev), "lag": lambda: prev}[func]()
        return _done(d.withColumn(name, F.when(x.isNotNull(), value)), keep, name)
    w = w.rowsBetween(*UP)
    use = {"avg": ("sum", "count")}.get(func, (func,))
    agg = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
    have = {f: agg[f](x).over(w) for f in use}
    if not whole(ctx):
        join = {"sum": lambda a, b: a + b, "count": lambda a, b: a + b, "min": min, "max": max}
        rows, held = [], dict(ctx.seen().get("sums", {}))
        for r in totals(d, {f: agg[f](x) for f in use}):
            rows.append({RANGE: r[RANGE]} | {f"__c_{f}": held.get(f) for f in use})
            held |= {f: r[f] if held.get(f) is None else join[f](held[f], r[f]) for f in use if r[f] is not None}
        ctx.remember("sums", held)
        d = carried(d, rows, ", ".join(f"__c_{f} {'long' if f == 'count' else 'double'}" for f in use))
        both = {"sum": lambda a, b: F.coalesce(a + b, b), "count": lambda a, b: F.coalesce(a, F.lit(0)) + b, "min": lambda a, b: F.least(a, b), "max": lambda a, b: F.greatest(a, b)}
        have = {f: both[f](F.col(f"__c_{f}"), c) for f, c in have.items()}
    value = F.try_divide(have["sum"], have["count"]) if func == "avg" else have[func].cast("double")
    return _done(d.withColumn(name, F.when(x.isNotNull(), value)), keep, name)


def _valid(ctx: Context, df: DataFrame, column: str, what: str, reach: int) -> tuple[DataFrame, Column, object]:
    """(df with __x, and __t: the `reach` values that aren't null before the range, latest first; the number of a value in its range, from 1 on; a window over the values).

    Rows without a value form windows of their own.
    """
    d = ranged(ctx, df.withColumn("__x", number(df, column, what)))
    if whole(ctx):
        d = d.withColumn("__t", F.array().cast("array<double>"))
    else:
        ranges = len(ctx.cuts[tuple(ctx.order)]) + 1
        if ranges * reach > MAX_TAILS:
            raise OpError(f"{what}: a reach of {reach} rows over {ranges} ranges; raise `block` to make them fewer")
        before = tails(ctx, d.where("__x is not null"), reach)
        # a range without a value has rows, but none that asks
        rows = [{RANGE: k, "__t": before.get(k, [])[::-1]} for k in range(ranges)]
        d = carried(d, rows, "__t array<double>")
    w = inner(ctx, F.col("__x").isNull())
    return d.withColumn("__r", F.row_number().over(w)), F.col("__r"), w


@op("window", required=("column", "size", "func"), stateful=True)
def window(ctx: Context, df: DataFrame, args: dict) -> DataFrame:
    """avg, sum, min, max or count of the last `size` values that aren't null, the row's own included."""
    n, func = int(args["size"]), args["func"] if args["func"] in ("sum", "min", "max", "count") else "avg"
    name = args.get("result") or f"{args['column']}_{args['func']}{n}"
    d, r, w = _valid(ctx, df, args["column"], "window", n - 1)
    frame, x = w.rowsBetween(-(n - 1), 0), F.col("__x")
    more = F.slice("__t", F.lit(1), F.greatest(n - r, F.lit(0)))  # what the frame reaches before the range
    add = {"sum": lambda: F.aggregate(more, F.lit(0.0), lambda a, b: a + b), "count": lambda: F.size(more), "min": lambda: F.array_min(more), "max": lambda: F.array_max(more)}
    alone = whole(ctx)

    def both(f):
        local = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[f](x).over(frame)
        if alone:
            return local
        new = {"min": F.least, "max": F.greatest}.get(f, lambda a, b: a + b)(local, add[f]())
        return F.when(r < n, new).otherwise(local)

    value = F.try_divide(both("sum"), both("count")) if func == "avg" else both(func).cast("double")
    return _done(d.withColumn(name, F.when(x.isNotNull(), value)), df.columns, name)


def _lagged(w, r: Column, j: int) -> Column:
    """The value j values before, also from the ranges before."""
    return F.coalesce(F.lag("__x", j).over(w), F.when(r <= j, F.get("__t", F.lit(j) - r)))


@op("diff", required=("column",), stateful=True)
def diff(ctx: Context, df: DataFrame, args: dict) -> DataFrame:
    """The difference of that order over the values that aren't null; the first `order` of them give null."""
    k = min(8, int(args.get("order", 1)))
    name = args.get("result") or f"{args['column']}_diff"
    d, r, w = _valid(ctx, df, args["column"], "diff", k)
    value = F.col("__x")
    for j in range(1, k + 1):
        value = value + F.lit(float((-1) ** j * math.comb(k, j))) * _lagged(w, r, j)
    return _done(d.withColumn(name, F.when(F.col("__x").isNotNull(), value)), df.columns, name)


@op("lead", required=("column",))
def lead(ctx: Context, df: DataFrame, args: dict) -> DataFrame:
    """The value `offset` rows ahead, nulls included."""
    kind = need(df, args["column"], "lead")
    n = int(args.get("offset", 1))
    name = args.get("result") or f"{args['column']}_lead"
    c = quoted(args["column"])
    d = ranged(ctx, df.withColumn("__x", c.cast("double") if kind in ("int", "float") else c))
    w = inner(ctx)
    value = F.lead("__x", n).over(w)
    if not whole(ctx):
        ranges = len(ctx.cuts[tuple(ctx.order)]) + 1
        if ranges * n > MAX_TAILS:
            raise OpError(f"lead: an offset of {n} rows over {ranges} ranges; raise `block` to make them fewer")
        first = d.select(RANGE, "__x", *[quoted(k) for k, _ in ctx.order]).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).collect()
        size = {r[RANGE]: r.n for r in totals(d, {"n": F.count(F.lit(1))})}
        own: dict[int, list] = {}
        for r in sorted(first, key=lambda r: (r[RANGE], r["__r"])):
            own.setdefault(r[RANGE], []).append(r["__x"])
        rows, held = [], []
        for k in sorted(size, reverse=True):
            rows.append({RANGE: k, "__n": size[k], "__t": held})
            held = (own[k] + held)[:n]
        d = carried(d, rows, f"__n long, __t array<{d.schema['__x'].dataType.simpleString()}>")
        left = F.col("__n") - F.row_number().over(w)
        value = F.when(left >= n, value).otherwise(F.get("__t", (F.lit(n) - left - 1).cast("int")))
    return _done(d.withColumn(name, value), df.columns, name)


@op("fill-down", "fill_down", stateful=True)
def fill_down(ctx: Context, df: DataFrame, args: dict) -> DataFrame:
    """Nulls take the last value above them that isn't null; all columns in one pass."""
    keys = {c for c, _ in ctx.order}
    cols = [c for c in visible(df) if (not args.get("columns") or c in args["columns"]) and c not in keys]
    if not cols:
        return df
    d = ranged(ctx, df)
    w = inner(ctx).rowsBetween(*UP)
    new = {c: F.last(quoted(c), True).over(w) for c in cols}
    if not whole(ctx):
        names = {c: f"__f{k}" for k, c in enumerate(cols)}
        d = carried(d, lasts(ctx, d, {n: quoted(c) for c, n in names.items()}), ", ".join(f"{n} {df.schema[c].dataType.simpleString()}" for c, n in names.items()))
        new = {c: F.coalesce(v, F.col(names[c])) for c, v in new.items()}
    return d.withColumns(new).select(*[quoted(c) for c in df.columns if c != RANGE], RANGE)


@op("anomaly", required=("column",), stateful=True)
def anomaly(ctx: Context, df: DataFrame, args: dict) -> DataFrame:
    """1 where the value lies more than `threshold` running sample deviations off the running mean, itself included.

    Means and squared deviations of the ranges before and of the range so far are united as such: no sums of squares of large values.
    """
    t = float(args.get("threshold", 3.0))
    name = args.get("result") or f"{args['column']}_anomaly"
    d = ranged(ctx, df.withColumn("__x", number(df, args["column"], "anomaly")))
    x, w = F.col("__x"), inner(ctx).rowsBetween(*UP)
    n, mean, dev = F.count(x).over(w), F.avg(x).over(w), F.var_pop(x).over(w) * F.count(x).over(w)
    if not whole(ctx):
        rows, held = [], ctx.seen().get("moments", [0, 0.0, 0.0])
        for r in totals(d, {"n": F.count(x), "m": F.avg(x), "v": F.var_pop(x)}):
            rows.append({RANGE: r[RANGE], "__n": held[0], "__m": held[1], "__v": held[2]})
            if r.n:
                both, off = held[0] + r.n, r.m - held[1]
                held = [both, held[1] + off * r.n / both, held[2] + r.v * r.n + off * off * held[0] * r.n / both]
        ctx.remember("moments", held)
        d = carried(d, rows, "__n long, __m double, __v double")
        all_, off = F.col("__n") + n, mean - F.col("__m")
        dev = dev + F.col("__v") + off * off * F.col("__n") * F.try_divide(n.cast("double"), all_)
        mean = F.col("__m") + off * F.try_divide(n.cast("double"), all_)
        n = all_
    d = d.withColumns({"__a": n, "__b": mean, "__d": dev})
    var = F.try_divide(F.col("__d"), F.col("__a") - 1)
    hit = (F.col("__a") > 1) & (var > 0) & (F.abs(x - F.col("__b")) > t * F.sqrt(var))
    return _done(d.withColumn(name, F.when(x.isNotNull() & F.coalesce(hit, F.lit(False)), 1).otherwise(0).cast("bigint")), df.columns, name)


def _ewma(alpha: float, starts: dict[int, float | None], at: int, rng: int, ends: bool):
    """Over batches sorted by range and order: the batches with a further column of e, or only (range, values, e) at the end of each range."""

    def run(batches):
        last, e, n = None, None, 0
        for b in batches:
            r = b.column(rng).to_numpy(zero_copy_only=False)
            x = b.column(at).to_numpy(zero_copy_only=False).astype(float)
            out = np.full(len(r), np.nan)
            edges = [0, *(np.flatnonzero(r[1:] != r[:-1]) + 1).tolist(), len(r)]
            for a, z in zip(edges, edges[1:]):
                if a == z:
                    continue
                if r[a] != last:
                    if ends and last is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([n], pa.int64()), pa.array([e], pa.float64())], [RANGE, "n", "e"])
                    last, e, n = int(r[a]), starts.get(int(r[a])), 0
                ok = a + np.flatnonzero(~np.isnan(x[a:z]))
                if len(ok):
                    v = x[ok] if e is None else np.concatenate([[e], x[ok]])
                    v = pd.Series(v).ewm(alpha=alpha, adjust=False).mean().to_numpy()[-len(ok) :] if alpha < 1 else x[ok]
                    out[ok], e, n = v, float(v[-1]), n + len(ok)
            if not ends:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, from_pandas=True)], [*b.schema.names, "__e"])
        if ends and last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([n], pa.int64()), pa.array([e], pa.float64())], [RANGE, "n", "e"])

    return run


@op("ewma", required=("column", "alpha"), stateful=True)
def ewma(ctx: Context, df: DataFrame, args: dict) -> DataFrame:
    """e = alpha * v + (1 - alpha) * e from the first value on; a null gives null and leaves e as it is.

    Ranges are worked on batch by batch in Arrow form. Each is an affine map of the e it starts from, so the starts follow from
    what each range comes to from 0: one pass over the order and the value.
    """
    a = float(args["alpha"])
    name = args.get("result") or f"{args['column']}_ewma"
    d = ranged(ctx, df.withColumn("__x", number(df, args["column"], "ewma")))
    order = ctx.sorting("ewma")
    starts: dict[int, float | None] = {}
    if not whole(ctx):
        few = d.select(RANGE, "__x", *[quoted(c) for c, _ in ctx.order]).repartition(RANGE).sortWithinPartitions(RANGE, *order).select(RANGE, "__x")
        zero = {k: 0.0 for k in range(len(ctx.cuts[tuple(ctx.order)]) + 1)}
        rows = few.mapInArrow(_ewma(a, zero, 1, 0, True), f"{RANGE} int, n long, e double").collect()
        e = ctx.seen().get("e")
        if e is None and any(r.n for r in rows):  # the first value of all starts from itself
            first = min(r[RANGE] for r in rows if r.n)
            one = few.where(F.col(RANGE) == first).mapInArrow(_ewma(a, {}, 1, 0, True), f"{RANGE} int, n long, e double").collect()[0]
            rows = [one if r[RANGE] == first else r for r in rows]
        for r in sorted(rows, key=lambda r: r[RANGE]):
            starts[r[RANGE]] = e
            if r.n:
                e = r.e if e is None else r.e + (1 - a) ** r.n * e
        ctx.remember("e", e)
    d = d.repartition(RANGE).sortWithinPartitions(RANGE, *order)
    names = d.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields)
    out = d.mapInArrow(_ewma(a, starts, names.index("__x"), names.index(RANGE), False), f"{schema}, __e double")
    return _done(out.withColumn(name, F.when(F.col("__x").isNotNull(), F.col("__e"))), df.columns, name)


@op("interpolate", required=("column",))
def interpolate(ctx: Context, df: DataFrame, args: dict) -> DataFrame:
    """Nulls between values: linear by place, forward (the last) or backward (the next). At the start linear and backward take the next
    value, at the end all take the last one. Integers are cut off."""
    kind, method = need(df, args["column"], "interpolate"), args.get("method", "linear")
    if kind not in ("int", "float", "null"):
        raise OpError("interpolate: numbers only")
    d = ranged(ctx, df.withColumn("__x", number(df, args["column"], "interpolate")))
    d = d.withColumn("__p", F.row_number().over(inner(ctx)).cast("bigint"))
    x = F.col("__x")
    place = F.when(x.isNotNull(), F.struct(F.col("__p").alias("p"), x.alias("x")))
    prev, after = F.last(place, True).over(inner(ctx).rowsBetween(*UP)), F.last(place, True).over(inner(ctx, back=True).rowsBetween(*UP))
    if not whole(ctx):
        few = d.select(RANGE, "__p", "__x")
        rows = few.groupBy(RANGE).agg(F.count(F.lit(1)).alias("n"), F.max_by(place, F.when(x.isNotNull(), F.col("__p"))).alias("l"), F.min_by(place, F.when(x.isNotNull(), F.col("__p"))).alias("f")).orderBy(RANGE).collect()
        start, held, out = 0, None, {}
        for r in rows:
            out[r[RANGE]] = {RANGE: r[RANGE], "__s": start, "__l": held}
            held = (r.l.p + start, r.l.x) if r.l else held
            start += r.n
        held = None
        for r in reversed(rows):
            out[r[RANGE]]["__f"] = held
            held = (r.f.p + out[r[RANGE]]["__s"], r.f.x) if r.f else held
        d = carried(d, list(out.values()), "__s long, __l struct<p:bigint,x:double>, __f struct<p:bigint,x:double>")
        d = d.withColumn("__p", F.col("__p") + F.col("__s"))
        prev, after = F.coalesce(prev, F.col("__l")), F.coalesce(after, F.col("__f"))
    d = d.withColumns({"__prev": prev, "__next": after})
    p, n = F.col("__prev"), F.col("__next")
    if method == "forward":
        fill = p["x"]
    elif method == "backward":
        fill = F.coalesce(n["x"], p["x"])
    else:
        part = F.try_divide((F.col("__p") - p["p"]).cast("double"), (n["p"] - p["p"]).cast("double"))
        fill = F.when(p.isNull(), n["x"]).when(n.isNull(), p["x"]).otherwise(p["x"] + part * (n["x"] - p["x"]))
    c = quoted(args["column"])
    new = F.coalesce(c, F.when(fill >= 0, F.floor(fill)).otherwise(F.ceil(fill)).cast(SPARK["int"])) if kind == "int" else F.coalesce(c.cast("double"), fill)
    return d.withColumn(args["column"], new).select(*[quoted(c) for c in df.columns if c != RANGE], RANGE)


def counted_groups(ctx: Context, df: DataFrame, count: str, keep: list[str]) -> DataFrame:
    """Runs of rows joined along the order: a run starts where the counts before sum up to an even number. value: the texts of a run, joined by line feeds;
    the order key and the columns in keep are those of its first row."""
    d = step(ctx, df, {"column": count, "func": "running-sum", "result": "__s"})
    d = d.withColumn("__new", F.when((F.col("__s") - F.col(count)) % 2 == 0, F.lit(1)))
    d = step(ctx, d.withColumn("__one", F.coalesce("__new", F.lit(0))), {"column": "__one", "func": "running-sum", "result": "__g"})
    row = ctx.order[0][0]
    parts = F.array_sort(F.collect_list(F.struct(quoted(row).alias("r"), *[quoted(k) for k in keep], F.col("value").alias("v"))))
    d = d.groupBy("__g").agg(parts.alias("p"))
    return d.select(F.array_join(F.transform("p", lambda x: x["v"]), "\n").alias("value"), *[F.col("p")[0][k].alias(k) for k in keep], F.col("p")[0]["r"].alias(row))
