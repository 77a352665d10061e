"""Preparation for learning: scales, codes, autocorrelation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import quoted
from .base import Context, OpError, kinds, need, number, op
from .reshape import categories
from .sequence import _lagged, _valid, dense_index, sort_key


@op("normalize", required=("columns",))
def normalize(ctx: Context, df: DataFrame, args: dict) -> DataFrame:
    """In place as doubles: minmax to 0..1 (0 without a range), zscore by mean and sample deviation (0 without one)."""
    cols = [c for c in args["columns"] if c in df.columns and kinds(df)[c] in ("int", "float", "date", "timestamp")]
    if not cols:
        return df
    z = args.get("method") == "zscore"
    both = []
    for i, c in enumerate(cols):
        x = number(df, c, "normalize")
        both += [(F.avg(x) if z else F.min(x)).alias(f"__a{i}"), (F.coalesce(F.stddev_samp(x), F.lit(1.0)) if z else F.max(x) - F.min(x)).alias(f"__d{i}")]
    joined = df.join(F.broadcast(df.agg(*both)), F.lit(True))  # one row
    new = {c: F.when(quoted(c).isNotNull(), F.when(F.col(f"__d{i}") == 0, 0.0).otherwise((number(df, c, "normalize") - F.col(f"__a{i}")) / F.col(f"__d{i}"))) for i, c in enumerate(cols)}
    return joined.withColumns(new).select(*[quoted(c) for c in df.columns])


@op("acf", required=("column",))
def acf(ctx: Context, df: DataFrame, args: dict) -> DataFrame:
    """lag and autocorrelation for lags 0 to `lags`, nulls left out; no rows for fewer than two values or no variance."""
    lags = int(args.get("lags", 20))
    x = number(df, args["column"], "acf")
    mean = df.agg(F.avg(x)).first()[0]
    rest = df.where(x.isNotNull()).withColumn("__e", x - F.lit(mean)).select("__e", *[quoted(c) for c, _ in ctx.order if c != "__e"])
    d, r, w = _valid(ctx, rest, "__e", "acf", lags)
    d = d.withColumns({f"__l{k}": F.col("__x") * (_lagged(w, r, k) if k else F.col("__x")) for k in range(lags + 1)})
    row = d.agg(F.count("__x").alias("n"), F.sum("__l0").alias("var"), *[F.sum(f"__l{k}").alias(f"s{k}") for k in range(lags + 1)])
    lines = F.array(*[F.struct(F.lit(k).cast("bigint").alias("lag"), F.col(f"s{k}").alias("s")) for k in range(lags + 1)])
    ctx.order = [("lag", False)]
    return row.where("n >= 2 and var > 0").select("n", "var", F.explode(lines).alias("l")).where("l.lag < n").select("l.lag", (F.col("l.s") / F.col("var")).alias("acf"))


@op("label-encode", "label_encode", required=("column",), stateful=True)
def label_encode(ctx: Context, df: DataFrame, args: dict) -> DataFrame:
    """Numbers from 0 on by first appearance; null stays null."""
    kind = need(df, args["column"], "label-encode")
    name = args.get("result") or f"{args['column']}_encoded"
    if kind in ("date", "timestamp"):
        return df.withColumn(name, F.lit(None).cast("bigint"))
    ctx.sorting("label-encode")
    key = sort_key(ctx, df)
    if key is None:
        df = dense_index(ctx, df, "__i")
        key = (F.max_by, F.min_by, F.col("__i"))
    # the values, each with its first key: numbered by ranges of these
    last = F.max if key[0] is F.min_by else F.min
    first = df.where(quoted(args["column"]).isNotNull()).groupBy(quoted(args["column"]).alias("__v")).agg(last(key[2]).alias("__f"))
    flat = ["__f"]
    if isinstance(first.schema["__f"].dataType, T.StructType):
        names = first.schema["__f"].dataType.names
        flat = [f"__f{k}" for k in range(len(names))]
        first = first.select("__v", *[F.col("__f")[n].alias(f) for n, f in zip(names, flat)])
    known = dict(map(tuple, ctx.seen().get("labels", [])))
    if ctx.memory is not None:
        first = first.where(~F.col("__v").isin(list(known))) if known else first
    inside = Context(ctx.spark, [(f, key[0] is F.min_by) for f in flat], block=ctx.block)
    ids = dense_index(inside, first, name).select("__v", name)
    if ctx.memory is not None:
        new = ids.limit(ctx.max_categories + 1).collect()
        if len(known) + len(new) > ctx.max_categories:
            raise OpError(f"label-encode in a stream: more than {ctx.max_categories} values; raise max_categories")
        known = known | {r["__v"]: r[name] + len(known) for r in new}
        ctx.remember("labels", list(known.items()))
        ids = df.sparkSession.createDataFrame(list(known.items()), f"__v {df.schema[args['column']].dataType.simpleString()}, {name} long")
    return df.join(ids, quoted(args["column"]) == F.col("__v"), "left").drop("__v", "__i")


@op("onehot", required=("column",))
def onehot(ctx: Context, df: DataFrame, args: dict) -> DataFrame:
    """<column>_<value> as 0 or 1 for all values by first appearance; null has only zeros. drop: without the column itself."""
    from ..functions.text import as_text

    text = as_text(quoted(args["column"]), need(df, args["column"], "onehot")).cast("string")
    new = {f"{args['column']}_{v}": F.coalesce((text == v).cast("bigint"), F.lit(0).cast("bigint")) for v in categories(ctx, df, args["column"], "onehot")}
    out = df.withColumns(new) if new else df
    return out.drop(args["column"]) if args.get("drop") and args["column"] not in {c for c, _ in ctx.order} else out
