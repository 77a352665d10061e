"""pivot, stack and joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import kind_of, quoted
from ..functions.text import as_text
from ..sources.files import read_csv, read_parquet
from .base import Context, OpError, kinds, need, number, op, visible
from .sequence import dense_index, sort_key


def categories(ctx: Context, df: DataFrame, column: str, what: str) -> list[str]:
    """The distinct texts of a column by first appearance (or by value without an order); at most ctx.max_categories."""
    kind = need(df, column, what)
    text = as_text(quoted(column), kind).cast("string")
    first = F.min(ctx.key()) if ctx.order and not any(d for _, d in ctx.order) else F.lit(0)
    rows = df.where(quoted(column).isNotNull()).groupBy(text.alias("v")).agg(first.alias("f")).orderBy("f", "v").limit(ctx.max_categories + 1).collect()
    if len(rows) > ctx.max_categories:
        raise OpError(f"{what}: more than {ctx.max_categories} values in {column!r}; raise max_categories")
    return [r.v for r in rows]


@op("pivot", required=("name_column", "value_column"))
def pivot(ctx: Context, df: DataFrame, args: dict) -> DataFrame:
    """A column for each value of name_column, a row for each combination of all other columns. A null or text value counts as 0; a cell without rows is null."""
    name, value, agg = args["name_column"], args["value_column"], args.get("agg", "first")
    kind = need(df, value, "pivot")
    values = categories(ctx, df, name, "pivot")
    text = as_text(quoted(name), kinds(df)[name]).cast("string")
    x = F.coalesce(number(df, value, "pivot"), F.lit(0.0)) if kind in ("int", "float", "date", "timestamp") else F.lit(0.0)
    order = {c for c, _ in ctx.order}
    first = sort_key(ctx, df) if ctx.order and agg == "first" else None
    if ctx.order and agg == "first" and first is None:
        df = dense_index(ctx, df, "__place")
        first = F.max_by, F.min_by, F.col("__place")
    rest = [c for c in visible(df) if c not in (name, value) and (c not in order or args.get("keep_order_key"))]

    def cell(v):
        hit = F.when(text == v, x)
        if agg == "count":
            return F.nullif(F.count(hit), F.lit(0))
        if agg == "first":
            return first[1](hit, F.when(text == v, first[2])) if first else F.first(hit, True)
        return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[agg](hit)

    if agg not in ("first", "sum", "count", "avg", "min", "max"):
        raise OpError(f"pivot: unknown function {agg}")
    ctx.order = []
    return df.groupBy(*[quoted(c) for c in rest]).agg(*[cell(v).alias(v) for v in values])


def other(ctx: Context, source, what: str) -> DataFrame:
    """A second input: a DataFrame, or the path of a CSV or Parquet file."""
    if isinstance(source, DataFrame):
        return source
    if not source:
        raise OpError(f"{what}: no file")
    return read_parquet(ctx.spark, source) if str(source).rstrip("/").endswith(".parquet") else read_csv(ctx.spark, source).drop("__row")


@op("stack", required=("file",), files=True)
def stack(ctx: Context, df: DataFrame, args: dict) -> DataFrame:
    """The rows of a second input below, by position, as the types of the first; tag: a first column that says where a row is from."""
    cols = visible(df)
    below = other(ctx, args["file"], "stack")
    names = visible(below)
    rows = below.select(*[(quoted(names[k]) if k < len(names) else F.lit(None)).cast("string").try_cast(df.schema[c].dataType).alias(c) for k, c in enumerate(cols)])
    above = df.select(*[quoted(c) for c in cols])
    if args.get("tag"):
        above = above.select(F.lit("input").alias(args["tag"]), "*")
        rows = rows.select(F.lit(args.get("tag_value") or str(args["file"])).alias(args["tag"]), "*")
    ctx.order = []
    return above.unionByName(rows)


#: Rows of one side in a block of a frequent key.
BLOCK = 2048
#: Keys of no more rows than this on the side that a task holds aren't frequent.
FEW = 32
#: So many keys at most are joined in blocks, the most frequent ones; those beyond are joined as the rest is, which is whole but may be slow.
MAX_FREQUENT = 10_000
#: Rows that a task copies to cells.
COPIED = 500_000


def _comparable(x: Column, one: T.DataType, two: T.DataType) -> Column | None:
    """A key of type `one` so that keys of both types are equal as texts or values where the join says so; None where types are rare."""
    ka, kb = kind_of(one), kind_of(two)
    if one == two and isinstance(one, T.AtomicType):
        return F.unix_date(x) if ka == "date" else F.unix_micros(x) if isinstance(one, T.TimestampType) else x
    if {ka, kb} <= {"int", "float"} and not any(isinstance(t, T.DecimalType) for t in (one, two)):
        return x.cast("bigint" if ka == kb == "int" else "double")
    return None if ka == kb or {ka, kb} <= {"int", "float"} else as_text(x, ka).cast("string")


def _on(keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])


def frequent(streamed: DataFrame, held: DataFrame, keys: list[str]) -> list[tuple]:
    """(key, rows streamed, rows held) of keys with more than BLOCK x BLOCK pairs, or too many rows to hold. Keys of one side are counted, then those of them that are many on the other."""
    counts = held.groupBy(*keys).agg(F.count(F.lit(1)).alias("__b")).where(F.col("__b") > FEW)
    rows = counts.orderBy(F.desc("__b")).limit(MAX_FREQUENT).collect()
    if not rows:
        return []
    few = F.broadcast(held.sparkSession.createDataFrame(rows, counts.schema))
    met = streamed.select(*keys).alias("l").join(few.alias("r"), _on(keys)).groupBy(*[F.col(f"r.{k}").alias(k) for k in keys], "r.__b").agg(F.count(F.lit(1)).alias("__a"))
    return [(*(r[k] for k in keys), r["__a"], r["__b"]) for r in met.where((F.col("__a").cast("double") * F.col("__b") > BLOCK * BLOCK) | (F.col("__b") > FEW * BLOCK)).collect()]


def in_blocks(streamed: DataFrame, held: DataFrame, keys: list[str], found: list[tuple]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both sides without the keys found, and all pairs of these keys.

    Rows of such a key are dealt to blocks of about BLOCK rows by their hash, equal rows in turn. Each block of one side meets each of the other in a cell of its own, so that cells are of like size,
    and spread over all tasks however few the keys are. Every such key has rows on both sides, so these pairs are the same in outer joins.
    """
    rows, cells, ones, twos = [], 0, 0, 0
    for *key, a, b in found:
        na, nb = -(-a // BLOCK), -(-b // BLOCK)
        rows.append((*key, cells, na, nb))
        cells, ones, twos = cells + na * nb, ones + a * nb, twos + b * na
    types = streamed.select(*keys).schema.fields
    fields = [T.StructField(k, f.dataType) for k, f in zip(keys, types)] + [T.StructField(n, T.LongType()) for n in ("__at", "__na", "__nb")]
    few = F.broadcast(streamed.sparkSession.createDataFrame(rows, T.StructType(fields)))

    def dealt(d: DataFrame, blocks: str, copied: int, cell) -> DataFrame:
        plain = [quoted(f.name) for f in d.schema.fields if isinstance(f.dataType, T.AtomicType)]
        whole = len(plain) == len(d.columns)
        d = d.withColumn("__hash", F.xxhash64(*plain)).alias("l").join(few.alias("r"), _on(keys)).select("l.*", "r.__at", "r.__na", "r.__nb")
        # small files are read by one task, which would make all copies
        d = d.repartition(min(copied // COPIED + 1, 200), "__hash")
        d = d.withColumn("__block", F.pmod("__hash", F.col(blocks)))
        if whole:  # rows of one hash are equal, so that it doesn't matter which gets which number
            d = d.withColumn("__block", F.pmod(F.col("__block") + F.row_number().over(Window.partitionBy(*keys, "__hash").orderBy("__hash")), F.col(blocks)))
        d = d.withColumn("__cell", F.explode(cell(F.col("__at"), F.col("__block"), F.col("__na"), F.col("__nb"))))
        return d.drop("__hash", "__block", "__at", "__na", "__nb", *keys).repartition(min(cells, 1000), "__cell")

    def rest(d: DataFrame) -> DataFrame:
        return d.alias("l").join(few.alias("r"), _on(keys), "left_anti")

    one = dealt(streamed, "__na", ones, lambda at, k, na, nb: F.sequence(at + k * nb, at + k * nb + nb - 1, F.lit(1).cast("bigint")))
    two = dealt(held, "__nb", twos, lambda at, k, na, nb: F.sequence(at + k, at + k + (na - 1) * nb, nb))
    # a merge holds one cell of one side at a time, and can spill it; a hash table gives pairs several times as fast, and holds all cells of a task, which stays small for some cells of short rows
    fixed = all(isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DatetimeType)) for f in two.schema.fields)
    short = fixed and len(two.columns) <= 16 and cells <= 64 * 1000
    return rest(streamed), rest(held), one.join(two.hint("shuffle_hash" if short else "merge"), "__cell").drop("__cell")


@op("join", required=("file", "on"), files=True)
def join(ctx: Context, df: DataFrame, args: dict) -> DataFrame:
    """Lookup by equal keys, `on` as "left[=right][,...]"; keys compare as texts, null matches null. how: inner, left, right, full, semi, anti."""
    look = other(ctx, args["file"], "join")
    how = {"outer": "full", "semi": "left_semi", "anti": "left_anti"}.get(args.get("how") or "inner", args.get("how") or "inner")
    if how not in ("inner", "left", "right", "full", "left_semi", "left_anti"):
        raise OpError(f"join: unknown kind {how}")
    pairs = [tuple(p.split("=", 1)) if "=" in p else (p, p) for p in str(args["on"]).split(",")]
    kl, kr = kinds(df), kinds(look)
    for a, b in pairs:
        need(df, a, "join")
        need(look, b, "join lookup")
    rights = {b for _, b in pairs}
    renamed = {c: c if c not in df.columns else f"{c}_right" for c in visible(look) if c not in rights}
    keys = {b: f"__key_{i}" for i, (_, b) in enumerate(pairs)}
    look = look.select(*[quoted(b).alias(k) for b, k in keys.items()], *[quoted(c).alias(n) for c, n in renamed.items()])

    def same(a, b):
        ka, kb = kl[a], kr[b]
        x, y = quoted(a), quoted(keys[b])
        if ka == kb or {ka, kb} <= {"int", "float"}:
            return x.eqNullSafe(y)
        return as_text(x, ka).cast("string").eqNullSafe(as_text(y, kb).cast("string"))

    cond = same(*pairs[0])
    for p in pairs[1:]:
        cond = cond & same(*p)
    names = [*df.columns, *renamed.values()]

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        # whether the lookup is sent to all tasks is left to Spark, which measures it at run time
        if how in ("left_semi", "left_anti"):
            return left.join(right, cond, how)
        # a full join would hold all pairs of a key at once: the rows of the lookup without a match follow by themselves
        out = left.join(right, cond, "left" if how == "full" else how)
        if how == "full":
            out = out.unionByName(right.join(left, cond, "left_anti"), allowMissingColumns=True)
        if how in ("right", "full"):
            out = out.withColumns({a: F.coalesce(quoted(a), quoted(keys[b])) for a, b in pairs if kl[a] == kr[b]})
        return out.select(*map(quoted, names))

    types = {c: (df.schema[a].dataType, look.schema[c].dataType) for a, b in pairs for c in [keys[b]]}
    left_keys = [_comparable(quoted(a), *types[keys[b]]) for a, b in pairs]
    if how in ("left_semi", "left_anti") or df.isStreaming or look.isStreaming or any(k is None for k in left_keys):
        return joined(df, look)
    alike = [f"__alike_{i}" for i in range(len(pairs))]
    one = df.withColumns(dict(zip(alike, left_keys)))
    two = look.withColumns({n: _comparable(quoted(keys[b]), *types[keys[b]][::-1]) for n, (a, b) in zip(alike, pairs)})
    flip = how == "right"  # there the rows of the lookup are streamed, those of the table are held
    found = frequent(*((two, one) if flip else (one, two)), alike)
    if not found:
        return joined(df, look)
    one, two, pairs_ = in_blocks(*((two, one) if flip else (one, two)), alike, found)
    if flip:
        one, two = two, one
    return joined(one.drop(*alike), two.drop(*alike)).unionByName(pairs_.select(*map(quoted, names)))
