"""Pipelines from the language, a recipe name, a JSON plan or a list of steps."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from types import SimpleNamespace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .operators import OPS, ROW, Context
from .operators.sequence import RANGE
from .plans import Plan, Step, find_recipe, parse_dsl
from .sources import files


@dataclass
class Result:
    """df: the result, lazy, with its rows' order in `order`; the side channels besides."""

    df: DataFrame
    order: list[tuple[str, bool]]
    encoder: Step | None = None
    errors: list[dict] = field(default_factory=list)
    stats: list[dict] = field(default_factory=list)
    samples: list[dict] = field(default_factory=list)
    #: (operator, rows in, rows out) to be observed when the result is first written or rendered.
    observed: list[tuple] = field(default_factory=list)

    def _note(self) -> None:
        """Runs the plan once for its counts, which Spark reports for such a run alone and not for rows that are iterated over."""
        if not self.observed:
            return
        self.df.write.format("noop").mode("overwrite").save()
        for op, *both in self.observed:
            self.stats.append({"op": op} | {k: o.get["n"] for k, o in zip(("rows_in", "rows_out"), both)})
        self.observed.clear()

    @property
    def ordered(self) -> DataFrame:
        """The visible columns in order."""
        df = self.df
        if self.order and all(c in df.columns for c, _ in self.order):
            df = df.orderBy(*[F.col(f"`{c}`").desc_nulls_last() if d else F.col(f"`{c}`").asc_nulls_last() for c, d in self.order])
        return df.select(*[F.col(f"`{c}`") for c in df.columns if not c.startswith("__")])

    @property
    def output_text(self) -> str:
        enc = self.encoder or Step("codec.csv.encode")
        self._note()
        return files.render(self.ordered, enc.op.split(".")[1], **enc.args)

    @property
    def output(self) -> bytes:
        return self.output_text.encode()

    @property
    def stats_text(self) -> str:
        return "".join(json.dumps(s) + "\n" for s in self.stats)

    def write(self, path: str) -> None:
        enc = self.encoder or Step("codec.parquet.encode")
        self._note()
        files.write(self.ordered, enc.op.split(".")[1], path, **enc.args)


#: Operators that change columns where they stand.
IN_PLACE = frozenset("cast trim fill-null fill_null clip replace date-trunc date_trunc normalize interpolate".split())


def keep_order(ctx: Context, df: DataFrame, step: Step) -> DataFrame:
    """df, with a hidden copy of each order column that the step changes: rows keep the order that they came in."""
    if step.op not in IN_PLACE:
        return df
    a = step.args
    named = {a.get("column"), *(a.get("mapping") or ()), *(a.get("columns") or df.columns if "column" not in a and "mapping" not in a else ())}
    moved = {c: f"__o_{c}" for c, _ in ctx.order if c in named and c in df.columns and not c.startswith("__")}
    if moved:
        df = df.withColumns({n: F.col(f"`{c}`") for c, n in moved.items()})
        ctx.order = [(moved.get(c, c), d) for c, d in ctx.order]
    return df


class Pipeline:
    def __init__(self, plan: Plan) -> None:
        self.plan = plan.validate()

    def to_json(self) -> str:
        return self.plan.to_json()

    def apply(self, df: DataFrame, order: list | str | None = None, count: bool = False, params: dict | None = None, **options) -> Result:
        """The transforms over df, as a lazy DataFrame; operators that need something of the data first (categories, bounds, the ranges of long tables) run small jobs of their own here.

        order: column, or columns ("-name" for descending), that fix the order of rows. count: also the numbers of rows that filters take in and
        let through, by a run of its own before the result is written.
        """
        if isinstance(order, str):
            order = [order]
        keys = [(o.lstrip("-"), o.startswith("-")) if isinstance(o, str) else o for o in order or ([ROW] if ROW in df.columns else [])]
        ctx = Context(df.sparkSession, keys, **options)
        encoder, observed = None, []
        for k, step in enumerate(self.plan.with_params(params or {}).steps):
            if step.op.startswith("codec."):
                encoder = step if step.op.endswith(".encode") else encoder
                continue
            ctx.place = k
            seen = [Observation(), Observation()] if count and step.op in ("filter", "grep") else []
            if seen:
                df = df.observe(seen[0], F.count(F.lit(1)).alias("n"))
            df = OPS[step.op].apply(ctx, keep_order(ctx, df, step), step.args)
            if seen:
                df = df.observe(seen[1], F.count(F.lit(1)).alias("n"))
                observed.append((step.op, *seen))
        return Result(df.drop(RANGE), ctx.order, encoder, ctx.errors, observed=observed)

    def run(self, spark: SparkSession | None = None, input: str | bytes | None = None, input_file: str | None = None, df: DataFrame | None = None, **options) -> Result:
        """From a text, a path or a DataFrame; options as those of apply()."""
        spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        first = self.plan.steps[0]
        fmt, args = (first.op.split(".")[1], first.args) if first.op.endswith(".decode") else ("csv", {})
        if df is None:
            path = input_file or args.get("path")
            rest = {k: v for k, v in args.items() if k != "path"}
            if input is not None:
                df = files.IN_MEMORY[fmt](spark, input.decode() if isinstance(input, bytes) else input, **rest)
            elif path:
                df = files.READERS[fmt](spark, path, **rest)
            else:
                raise ValueError("no input")
        return self.apply(df, **options)


def pipeline(steps: str | list | dict | None = None, recipe: str | None = None) -> Pipeline:
    """steps: the language, a recipe's name, a JSON plan, or a list of steps and codecs."""
    if recipe:
        text = find_recipe(recipe)
        if text is None:
            raise ValueError(f"no such recipe: {recipe}")
        return Pipeline(parse_dsl(text))
    if isinstance(steps, dict):
        return Pipeline(Plan.from_json(steps))
    if isinstance(steps, str):
        if steps.lstrip().startswith("{"):
            return Pipeline(Plan.from_json(steps))
        return Pipeline(parse_dsl(find_recipe(steps) or steps))
    return Pipeline(Plan([s if isinstance(s, Step) else Step(s["op"], dict(s.get("args") or {})) for s in steps or []]))


def load_recipe(path: str) -> Pipeline:
    with open(path) as f:
        return pipeline(f.read())


def save_recipe(p: Pipeline, path: str) -> None:
    with open(path, "w") as f:
        f.write(p.to_json())


def compile_dsl(text: str) -> str:
    return parse_dsl(text).to_json()


def recipes() -> dict[str, str]:
    from .plans import RECIPES

    return dict(RECIPES)


def _codec(fmt: str, way: str):
    return lambda **args: Step(f"codec.{fmt}.{way}", {k: v for k, v in args.items() if v is not None})


codec = SimpleNamespace(
    csv=_codec("csv", "decode"), csv_decode=_codec("csv", "decode"), csv_encode=_codec("csv", "encode"),
    jsonl=_codec("jsonl", "decode"), jsonl_decode=_codec("jsonl", "decode"), jsonl_encode=_codec("jsonl", "encode"),
    text=_codec("text", "decode"), text_decode=_codec("text", "decode"), text_encode=_codec("text", "encode"),
    table_encode=_codec("table", "encode"), parquet=_codec("parquet", "decode"), parquet_encode=_codec("parquet", "encode"),
)


def expr(text: str) -> str:
    return text


def version() -> str:
    from . import __version__

    return __version__


class _Ops:
    """ops.<name>(...): steps; positional arguments in the order of the operator's own, the rest by name."""

    _POSITIONS = {
        "filter": ("expr",), "validate": ("expr",), "select": ("columns",), "reorder": ("columns",), "rename": ("mapping",), "cast": ("mapping",), "fill-null": ("mapping",),
        "trim": ("columns",), "hash": ("columns",), "unique": ("columns",), "dedup": ("columns",), "frequency": ("columns",), "fill-down": ("columns",), "unpivot": ("columns",), "stats": ("stats",),
        "head": ("n",), "tail": ("n",), "skip": ("n",), "sample": ("n",), "top": ("n", "column", "desc"), "sort": ("columns",), "grep": ("pattern", "column"), "replace": ("column", "pattern", "replacement"),
        "clip": ("column", "min", "max"), "bin": ("column", "boundaries"), "split": ("column", "delimiter", "names"), "datetime": ("column", "extract"), "date-trunc": ("column", "trunc", "result"),
        "split-data": ("ratio", "seed", "result"), "stack": ("file", "tag"), "join": ("file", "on", "how"), "group-agg": ("group_by", "aggs"), "window": ("column", "size", "func", "result"),
        "step": ("column", "func", "result"), "lead": ("column", "offset", "result"), "diff": ("column", "order", "result"), "ewma": ("column", "alpha", "result"), "anomaly": ("column", "threshold", "result"),
        "interpolate": ("column", "method"), "normalize": ("columns", "method"), "acf": ("column", "lags"), "label-encode": ("column", "result"), "onehot": ("column", "drop"), "explode": ("column", "delimiter"),
        "pivot": ("name_column", "value_column", "agg"), "flatten": (), "derive": ("columns",),
    }

    def __getattr__(self, name: str):
        key = name.rstrip("_").replace("_", "-")
        if key not in self._POSITIONS:
            raise AttributeError(name)

        def make(*args, **named) -> Step:
            out = dict(zip(self._POSITIONS[key], args)) | named
            if key == "derive" and isinstance(out.get("columns"), dict):
                out["columns"] = [{"name": n, "expr": e} for n, e in out["columns"].items()]
            return Step(key, {k: v for k, v in out.items() if v is not None})

        return make


ops = _Ops()
