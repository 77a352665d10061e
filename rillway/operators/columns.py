"""Operators that change columns row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import SPARK, compile_expr, quoted
from ..functions.text import as_text, strip
from .base import Context, OpError, kinds, need, op, visible
from .rows import java_regex


@op("select", "reorder", required=("columns",), stateless=True)
def select(ctx: Context, df: DataFrame, args: dict) -> DataFrame:
    """These columns in this order; an unknown one is null and noted as an error. The order key stays, hidden."""
    out = []
    for c in args["columns"]:
        if c in df.columns:
            out.append(quoted(c))
        else:
            ctx.errors.append({"op": "select", "error": f"column not found: {c}"})
            out.append(F.lit(None).cast("string").alias(c))
    hidden = []
    order = []
    for c, d in ctx.order:
        if c not in args["columns"] and c in df.columns:
            name = c if c.startswith("__") else f"__o_{c}"
            hidden.append(quoted(c).alias(name))
            order.append((name, d))
        else:
            order.append((c, d))
    ctx.order = order
    return df.select(*out, *hidden)


@op("rename", required=("mapping",), stateless=True)
def rename(ctx: Context, df: DataFrame, args: dict) -> DataFrame:
    m = {a: b for a, b in args["mapping"].items() if a in df.columns}
    ctx.order = [(m.get(c, c), d) for c, d in ctx.order]
    return df.withColumnsRenamed(m)


@op("derive", required=("columns",), stateless=True)
def derive(ctx: Context, df: DataFrame, args: dict) -> DataFrame:
    """New columns; all expressions see the input columns only. An existing name is replaced in place."""
    new = {}
    for c in args["columns"]:
        col, kind = compile_expr(c["expr"], df.schema)
        new[c["name"]] = col.cast("string") if kind == "null" else col
    moved = {c: f"__o_{c}" for c, _ in ctx.order if c in new}
    ctx.order = [(moved.get(c, c), d) for c, d in ctx.order]
    return df.withColumns({n: quoted(c) for c, n in moved.items()} | new) if not moved else df.select("*", *[quoted(c).alias(n) for c, n in moved.items()]).withColumns(new)


_TYPES = {"int": "int", "int64": "int", "float": "float", "float64": "float", "string": "string", "str": "string", "bool": "bool", "boolean": "bool", "date": "date", "timestamp": "timestamp", "datetime": "timestamp"}


def cast_column(c: Column, kind: str, to: str, zero: bool = False) -> Column:
    """A value of `kind` as `to`; what doesn't parse is null, or with zero the value that stands for nothing."""
    if to == kind:
        return c
    if kind == "null":
        return F.lit(None).cast(SPARK[to])
    if to == "string":
        return as_text(c, kind)
    if kind == "string":
        if to == "int":
            out = F.nullif(F.regexp_extract(c, r"^\s*([-+]?\d+)", 1), F.lit("")).try_cast("bigint")
        elif to == "float":
            out = F.nullif(F.regexp_extract(c, r"^\s*([-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?)", 1), F.lit("")).try_cast("double")
        elif to == "bool":
            return (c != "") & (c != "false")
        else:
            out = c.try_cast(to)
    elif to == "int":
        out = F.unix_date(c).cast("bigint") if kind == "date" else F.unix_micros(c) if kind == "timestamp" else c.try_cast("bigint")
    elif to == "float":
        out = F.unix_date(c).cast("double") if kind == "date" else F.unix_micros(c).cast("double") if kind == "timestamp" else c.cast("double")
    elif to == "bool":
        out = c != 0 if kind in ("int", "float") else F.lit(None).cast("boolean")
    elif to == "date":
        out = c.cast("date") if kind == "timestamp" else F.lit(None).cast("date")
    elif kind == "date":
        out = c.cast("timestamp")
    else:
        out = F.timestamp_micros(c.try_cast("bigint")) if kind in ("int", "float") else F.lit(None).cast("timestamp")
    if zero:
        nothing = {"int": F.lit(0).cast("bigint"), "float": F.lit(0.0), "bool": F.lit(False), "date": F.lit("1970-01-01").cast("date"), "timestamp": F.timestamp_micros(F.lit(0))}[to]
        out = F.when(c.isNotNull(), F.coalesce(out, nothing))
    return out


@op("cast", required=("mapping",), stateless=True)
def cast(ctx: Context, df: DataFrame, args: dict) -> DataFrame:
    kind, new = kinds(df), {}
    for name, to in args["mapping"].items():
        if name in kind:
            new[name] = cast_column(quoted(name), kind[name], _TYPES[to], args.get("on_error") == "zero") if to in _TYPES else F.lit(None).cast("string")
    return df.withColumns(new) if new else df


def _texts(df: DataFrame, cols: list[str] | None) -> list[str]:
    return [c for c, k in kinds(df).items() if k == "string" and (not cols or c in cols) and not c.startswith("__")]


@op("trim", stateless=True)
def trim(ctx: Context, df: DataFrame, args: dict) -> DataFrame:
    new = {c: strip(quoted(c)) for c in _texts(df, args.get("columns"))}
    return df.withColumns(new) if new else df


@op("fill-null", "fill_null", required=("mapping",), stateless=True)
def fill_null(ctx: Context, df: DataFrame, args: dict) -> DataFrame:
    """Nulls replaced by the text read as the column's type; one that doesn't parse leaves them. Dates and timestamps take days and microseconds too."""
    kind, new = kinds(df), {}
    for c, text in args["mapping"].items():
        k = kind.get(c)
        if k is None:
            continue
        v = F.lit(str(text))
        if k == "bool":
            v = F.lit(str(text).lower() == "true")
        elif k == "date":
            v = F.coalesce(F.date_from_unix_date(v.try_cast("int")), v.try_cast("date"))
        elif k == "timestamp":
            v = F.coalesce(F.timestamp_micros(v.try_cast("bigint")), v.try_cast("timestamp"))
        elif k in ("int", "float"):
            v = v.try_cast(SPARK[k])
        new[c] = F.coalesce(quoted(c), v)
    return df.withColumns(new) if new else df


@op("clip", required=("column",), stateless=True)
def clip(ctx: Context, df: DataFrame, args: dict) -> DataFrame:
    kind = kinds(df).get(args["column"])
    if kind not in ("int", "float"):
        return df
    c = quoted(args["column"])
    out = c
    for key, test in (("min", lambda a, b: a < b), ("max", lambda a, b: a > b)):
        if args.get(key) is not None:
            bound = F.lit(int(args[key])).cast("bigint") if kind == "int" else F.lit(float(args[key]))
            out = F.when(test(out, bound), bound).otherwise(out)
    return df.withColumn(args["column"], out)


@op("replace", required=("column", "pattern"), stateless=True)
def replace(ctx: Context, df: DataFrame, args: dict) -> DataFrame:
    if kinds(df).get(args["column"]) != "string":
        return df
    c, new = quoted(args["column"]), args.get("replacement", "")
    if args.get("regex"):
        new = new.replace("\\", "\\\\").replace("$", "\\$").replace("&", "$0")
        return df.withColumn(args["column"], F.regexp_replace(c, java_regex(args["pattern"]), new))
    return df.withColumn(args["column"], F.replace(c, F.lit(args["pattern"]), F.lit(new)))


@op("hash", stateless=True)
def hash_(ctx: Context, df: DataFrame, args: dict) -> DataFrame:
    """_hash: h = (h * 33) xor byte from 5381 on, modulo 2^32, over the text forms of the columns; nulls are left out."""
    kind = kinds(df)
    parts = []
    for c in args.get("columns") or visible(df):
        k, x = kind.get(c), quoted(c)
        if k is None:
            continue
        if k == "bool":
            x = F.when(x, "T").otherwise("F")
            x = F.when(quoted(c).isNotNull(), x)
        elif k == "date":
            x = F.unix_date(x).cast("string")
        elif k == "timestamp":
            x = F.unix_micros(x.cast("timestamp")).cast("string")
        elif k == "float":
            # whole numbers as such; others with up to 17 digits, as Spark writes doubles
            x = F.when((F.floor(x) == x) & (F.abs(x) < 1e15), x.cast("bigint").cast("string")).otherwise(x.cast("string"))
        parts.append(x.cast("string"))
    pairs = F.regexp_extract_all(F.hex(F.encode(F.concat_ws("", *parts), "UTF-8")), F.lit("(..)"), F.lit(1))
    mask = F.lit(0xFFFFFFFF).cast("bigint")
    h = F.aggregate(pairs, F.lit(5381).cast("bigint"), lambda a, b: (a * 33).bitwiseAND(mask).bitwiseXOR(F.conv(b, 16, 10).cast("bigint")))
    return df.withColumn("_hash", h)


@op("bin", required=("column", "boundaries"), stateless=True)
def bin_(ctx: Context, df: DataFrame, args: dict) -> DataFrame:
    """<column>_bin: "<18", "18-30", "50+"; an interval holds its lower bound."""
    need(df, args["column"], "bin")
    b = [float(x) for x in args["boundaries"]]
    c = quoted(args["column"]).try_cast("double")
    out = F.when(c < b[0], f"<{b[0]:g}")
    for lo, hi in zip(b, b[1:]):
        out = out.when((c >= lo) & (c < hi), f"{lo:g}-{hi:g}")
    return df.withColumn(f"{args['column']}_bin", out.when(c >= b[-1], f"{b[-1]:g}+"))


@op("split", required=("column", "names"), stateless=True)
def split(ctx: Context, df: DataFrame, args: dict) -> DataFrame:
    """The k-th part as a new column; parts that are missing, or empty at the end, are null; surplus ones are dropped."""
    need(df, args["column"], "split")
    delim = args.get("delimiter") or " "
    parts = F.split(quoted(args["column"]), f"\\Q{delim}\\E", -1)
    new = {}
    for k, name in enumerate(args["names"]):
        part = F.get(parts, F.lit(k))
        new[name] = F.when((F.size(parts) == k + 1) & (part == ""), F.lit(None)).otherwise(part)
    return df.withColumns(new)


_PARTS = ("year", "month", "day", "hour", "minute", "second", "weekday", "epoch")


@op("datetime", required=("column",), stateless=True)
def datetime(ctx: Context, df: DataFrame, args: dict) -> DataFrame:
    """<column>_<part> as integers, in one fixed order; weekday counts from Sunday = 0. Texts may be dates, timestamps or epoch seconds."""
    kind = need(df, args["column"], "datetime")
    want = args.get("extract") or _PARTS
    c = quoted(args["column"])
    if kind == "string":
        t = F.when(c.rlike(r"^\s*-?\d+\s*$"), F.timestamp_seconds(F.trim(c).try_cast("bigint"))).otherwise(c.try_cast("timestamp"))
    elif kind in ("date", "timestamp"):
        t = c.cast("timestamp")
    else:
        t = F.lit(None).cast("timestamp")
    make = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second, "weekday": lambda x: F.dayofweek(x) - 1, "epoch": F.unix_timestamp}
    return df.withColumns({f"{args['column']}_{p}": make[p](t).cast("bigint") for p in _PARTS if p in want})


@op("date-trunc", "date_trunc", required=("column",), stateless=True)
def date_trunc(ctx: Context, df: DataFrame, args: dict) -> DataFrame:
    """Down to the start of the year ... second, in place or as `result`; an unknown level means day. The type stays."""
    kind = need(df, args["column"], "date-trunc")
    level = args.get("trunc", "day")
    level = level if level in _PARTS[:6] else "day"
    c = quoted(args["column"])
    if kind == "timestamp":
        out = F.date_trunc(level, c)
    elif kind == "date":
        out = F.trunc(c, level) if level in ("year", "month") else c
    elif kind == "string":
        d = F.substring(F.trim(c), 1, 10).try_cast("date")
        out = F.coalesce(F.date_format(F.trunc(d, level) if level in ("year", "month") else d, "yyyy-MM-dd"), c)
    else:
        out = c
    return df.withColumn(args.get("result") or args["column"], out)


@op("flatten", stateless=True)
def flatten(ctx: Context, df: DataFrame, args: dict) -> DataFrame:
    """Rows are flat already."""
    return df


@op("explode", required=("column",), stateless=True)
def explode(ctx: Context, df: DataFrame, args: dict) -> DataFrame:
    """A row for each part, trimmed. A null stays one row, an empty text gives none, a last empty part is left out."""
    if need(df, args["column"], "explode") != "string":
        return df
    c = quoted(args["column"])
    parts = F.split(c, f"\\Q{args.get('delimiter') or ','}\\E", -1)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    parts = F.when(c.isNull(), F.array(F.lit(None).cast("string"))).otherwise(F.transform(parts, lambda x: F.trim(x)))
    rest = [quoted(x) for x in df.columns if x != args["column"]]
    out = df.select(*rest, F.posexplode(parts).alias("__pos", args["column"]))
    ctx.order = [*ctx.order, ("__pos", False)] if ctx.order and "__pos" not in df.columns else ctx.order
    return out.select(*[quoted(x) for x in df.columns], "__pos") if ctx.order else out.select(*[quoted(x) for x in df.columns])


@op("unpivot", required=("columns",), stateless=True)
def unpivot(ctx: Context, df: DataFrame, args: dict) -> DataFrame:
    """The other columns with `variable` and `value` (text), in the table's column order; nulls stay."""
    kind = kinds(df)
    cols = [c for c in df.columns if c in args["columns"]]
    if not cols:
        raise OpError("unpivot: no such columns")
    ids = [quoted(c) for c in df.columns if c not in cols]
    rows = F.array(*[F.struct(F.lit(c).alias("variable"), as_text(quoted(c), kind[c]).cast("string").alias("value")) for c in cols])
    out = df.select(*ids, F.posexplode(rows).alias("__var", "__x")).select(*ids, "__var", "__x.variable", "__x.value")
    if not ctx.order:
        return out.drop("__var")
    ctx.order = [k for k in ctx.order if k[0] not in cols] + [("__var", False)]
    return out
