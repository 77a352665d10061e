"""Readers and writers: CSV, JSON Lines, plain text, Parquet, and a Markdown table."""

from __future__ import annotations

import csv
import io
import json
import re
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import kind_of, quoted
from ..functions.text import as_text

ROW = "__row"
_DATE = r"^\d{4}-\d{1,2}-\d{1,2}$"
_TIME = r"^\d{4}-\d{1,2}-\d{1,2}[T ]\d{1,2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}(:?\d{2})?)?$"
_INT = r"^[+-]?\d{1,19}$"
_FLOAT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def scratch(spark: SparkSession) -> str:
    """A folder that the driver and all executors share: that of spark.checkpoint.dir; where it is unset a temporary one, but only if all of Spark is one process here."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.rillway.folder", None)
    if not own:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = f"file://{tempfile.mkdtemp(prefix='rillway-')}"
        spark.conf.set("spark.rillway.folder", own)
    return own


def _lines(spark: SparkSession, path: str | list[str], **options: str) -> DataFrame:
    """(value, __start, __rank, ROW): all lines of text files, empty ones too, numbered by path, then place in the file; __start: whether it is of a file's first split.

    Files are read in splits. Within a split Spark's row numbers follow the file; so a number is made of the file's rank, the split and that.
    """
    df = spark.read.options(**options).text(path)
    plain = r"^(\w+):/+"  # the two sides write schemes with one slash or three
    files = sorted({re.sub(plain, r"\1:/", f) for f in df.inputFiles()})
    if len(files) >= 1 << 18:
        raise ValueError("more than 262,143 files at once")
    meta = F.col("_metadata")
    id_ = F.monotonically_increasing_id()
    df = df.select("value", F.regexp_replace(meta["file_path"], plain, "$1:/").alias("__path"), meta["file_block_start"].alias("__at"), meta["file_block_length"].alias("__size"), id_.alias("__id"))
    if len(files) > 1:
        ranks = spark.createDataFrame([(f, k) for k, f in enumerate(files)], "__path string, __rank long")
        df = df.join(F.broadcast(ranks), "__path")  # a row a file
    else:
        df = df.withColumn("__rank", F.lit(0).cast("bigint"))
    # splits are of one size but for a file's last, which is shorter: its number comes out higher, so it stays the last
    split = F.least(F.floor(F.col("__at") / F.greatest("__size", F.lit(1))), F.lit((1 << 18) - 1)).cast("bigint")
    place = F.shiftleft("__rank", 45).bitwiseOR(F.shiftleft(split, 27)).bitwiseOR(F.col("__id").bitwiseAND(F.lit((1 << 27) - 1)))
    return df.select("value", (F.col("__at") == 0).alias("__start"), "__rank", place.alias(ROW))


def _firsts(lines: DataFrame, keep: Column) -> list[int]:
    """ROW of the first line of each file that `keep` holds for."""
    return [r.r for r in lines.where(F.col("__start") & keep).groupBy("__rank").agg(F.min(ROW).alias("r")).orderBy("__rank").collect()]


def typed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns as the narrowest type that all their values fit: int, float, date, timestamp or text.

    One aggregate over all columns; an empty text is null; a column of nulls stays text. Truth values stay texts.
    """
    if not columns:
        return df

    def tests(c):
        x = quoted(c)
        return {
            "int": x.rlike(_INT) & x.try_cast("bigint").isNotNull(),
            "float": x.rlike(_FLOAT),
            "date": x.rlike(_DATE) & x.try_cast("date").isNotNull(),
            "timestamp": (x.rlike(_TIME) | x.rlike(_DATE)) & x.try_cast("timestamp").isNotNull(),
        }

    row = df.agg(*[F.struct(F.count(quoted(c)).alias("n"), *[F.count_if(t).alias(k) for k, t in tests(c).items()]).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    new = {}
    for i, c in enumerate(columns):
        for kind, to in (("int", "bigint"), ("float", "double"), ("date", "date"), ("timestamp", "timestamp")):
            if row[i]["n"] and row[i][kind] == row[i]["n"]:
                new[c] = quoted(c).try_cast(to)
                break
    return df.withColumns(new) if new else df


def read_csv(spark: SparkSession, path: str | list[str], delimiter: str = ",", header: bool = True, infer: bool = True, **_) -> DataFrame:
    """Quoted fields may hold line breaks and white space at their ends; short rows are filled with nulls, long ones cut; a blank line is a row of nulls, before the header nothing.

    Files are read in splits. Lines with an odd number of quotes, if there are any, are joined to records by a running count along the files.
    """
    return _csv(spark, _records(spark, _lines(spark, path, lineSep="\n"), lambda: _lines(spark, path)), delimiter, header, infer)


def _records(spark: SparkSession, lines: DataFrame, anew: Callable[[], DataFrame] | None = None) -> DataFrame:
    """Lines that end with a line feed, joined where quoted fields hold more of them, without the carriage return of CR LF.

    Where a carriage return by itself ends a record, all is read by `anew`, in which every kind of break ends a line; then a break in a quoted field is a line feed.
    """
    from ..operators.base import Context
    from ..operators.sequence import counted_groups

    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    bare = F.regexp_replace("value", r"\r\z", "")
    row = lines.agg(F.bool_or(quotes % 2 == 1).alias("odd"), F.bool_or(bare.contains("\r")).alias("cr")).first()
    if row.odd:
        ctx = Context(spark, [(ROW, False)])
        lines = counted_groups(ctx, lines.withColumn("__q", quotes), "__q", ["__start", "__rank"])
    if row.cr and anew and lines.where(bare.contains("\r")).where(F.regexp_replace(bare, '"[^"]*"', "").contains("\r")).limit(1).count():
        return _records(spark, anew())
    return lines.withColumn("value", bare)


def _csv(spark: SparkSession, lines: DataFrame, delimiter: str, header: bool, infer: bool) -> DataFrame:
    text = F.trim(F.regexp_replace("value", "[ \t\r]+$", "")) != ""
    firsts = _firsts(lines, text)
    if not firsts:
        return spark.createDataFrame([], T.StructType([T.StructField(ROW, T.LongType())]))
    options = {"sep": delimiter, "escape": '"', "charToEscapeQuoteEscaping": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "nullValue": "", "emptyValue": "", "mode": "PERMISSIVE", "multiLine": "true", "maxColumns": "20480", "maxCharsPerColumn": "-1"}
    head = lines.where(F.col(ROW) == firsts[0]).first()["value"]
    cells = next(csv.reader(io.StringIO(head), delimiter=delimiter))
    names: list[str] = []
    for k, c in enumerate(cells):  # a name that stands there before, or none, gets a number
        c = (c.strip() or f"c{k}") if header else f"c{k}"
        names.append(c if c not in names else next(n for j in range(2, len(cells) + 2) if (n := f"{c}_{j}") not in names))
    fields = ", ".join(f"f{k} string" for k in range(len(names)))
    if header:  # what stands at and before the header of each file
        starts = spark.createDataFrame([(r >> 45, r) for r in firsts], "__rank long, __head long")
        lines = lines.join(F.broadcast(starts), "__rank").where(F.col(ROW) > F.col("__head"))  # a row a file
    rows = lines.select(F.when(text, F.from_csv("value", fields, options)).alias("r"), ROW)
    df = rows.select(*[F.nullif(F.col(f"r.f{k}"), F.lit("")).alias(n) for k, n in enumerate(names)], ROW)
    return typed(df, [c for c in df.columns if c != ROW]) if infer else df


def csv_rows(spark: SparkSession, text: str, delimiter: str = ",", header: bool = True, infer: bool = True, **_) -> DataFrame:
    """CSV in memory, read as a file is."""
    def lines(end: str) -> DataFrame:
        rows = [(x, True, 0, i) for i, x in enumerate(re.split(end, text))]
        if rows and not rows[-1][0]:
            rows.pop()
        return spark.createDataFrame(rows, f"value string, __start boolean, __rank long, {ROW} long")

    return _csv(spark, _records(spark, lines("\n"), lambda: lines(r"\r\n|\n|\r")), delimiter, header, infer)


def read_jsonl(spark: SparkSession, path: str | list[str], **_) -> DataFrame:
    """The columns of the first object; bad lines are skipped, nested values are JSON text."""
    return _jsonl(_lines(spark, path).select("value", ROW))


def jsonl_rows(spark: SparkSession, text: str, **_) -> DataFrame:
    lines = [(line, i) for i, line in enumerate(text.splitlines())]
    return _jsonl(spark.createDataFrame(lines, f"value string, {ROW} long"))


def _jsonl(lines: DataFrame) -> DataFrame:
    as_map = F.from_json("value", "map<string,string>")
    df = lines.where(F.trim("value").startswith("{")).withColumn("__m", as_map).where("__m is not null")
    first = df.orderBy(ROW).limit(1).collect()
    names: list[str] = list(json.loads(first[0]["value"], strict=False)) if first else []
    if not names:
        return lines.select(ROW).where("false")
    df = df.select(*[F.col("__m")[n].alias(n) for n in names], *[F.get_json_object("value", f"$['{n}']").alias(f"__j_{n}") for n in names], F.col("value").alias("__line"), ROW)
    tests = [F.struct(F.count(quoted(n)).alias("n"), F.count_if(quoted(n).rlike(_INT)).alias("int"), F.count_if(quoted(n).rlike(_FLOAT)).alias("float"), F.count_if(quoted(n).isin("true", "false")).alias("bool"), F.count_if(F.col("__line").rlike(f'"{n}"\\s*:\\s*"')).alias("text")).alias(f"c{i}") for i, n in enumerate(names)]
    row = df.agg(*tests).first()
    out = []
    for i, n in enumerate(names):
        r, c = row[i], quoted(n)
        if r["n"] and not r["text"]:
            for kind, to in (("int", "bigint"), ("float", "double"), ("bool", "boolean")):
                if r[kind] == r["n"]:
                    c = c.try_cast(to)
                    break
        out.append(c.alias(n))
    return df.select(*out, ROW)


def read_text(spark: SparkSession, path: str | list[str], **_) -> DataFrame:
    """Lines as `_line`, empty ones too, without carriage returns."""
    return _lines(spark, path).select(F.regexp_replace("value", "\r$", "").alias("_line"), ROW)


def text_rows(spark: SparkSession, text: str, **_) -> DataFrame:
    lines = text.split("\n")
    if lines and not lines[-1]:
        lines.pop()
    return spark.createDataFrame([(x.rstrip("\r"), i) for i, x in enumerate(lines)], f"_line string, {ROW} long")


def read_parquet(spark: SparkSession, path: str | list[str], **_) -> DataFrame:
    return spark.read.parquet(*([path] if isinstance(path, str) else path))


READERS = {"csv": read_csv, "jsonl": read_jsonl, "text": read_text, "parquet": read_parquet}
IN_MEMORY = {"csv": csv_rows, "jsonl": jsonl_rows, "text": text_rows}


def texts(df: DataFrame) -> DataFrame:
    """All visible columns in their text forms."""
    return df.select(*[as_text(quoted(f.name), kind_of(f.dataType)).cast("string").alias(f.name) for f in df.schema.fields if not f.name.startswith("__")])


def write(df: DataFrame, fmt: str, path: str, delimiter: str = ",", header: bool = True, mode: str = "overwrite", **_) -> None:
    """As files of one folder, each task its own."""
    plain = df.select(*[quoted(c) for c in df.columns if not c.startswith("__")])
    if fmt == "csv":
        lines = csv_lines(df, delimiter)
        head = delimiter.join(_cell(n, delimiter) for n in plain.columns)
        first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0  # of its task, and so of its file
        with_head = F.when(first, F.concat(F.lit(head + "\n"), "value")).otherwise(F.col("value")).alias("value")
        (lines.select(with_head) if header else lines).write.mode(mode).option("maxRecordsPerFile", 0).text(path)
        if header and df.sparkSession.read.text(path).isEmpty():  # no rows
            df.sparkSession.createDataFrame([(head,)], "value string").coalesce(1).write.mode("overwrite" if mode == "overwrite" else "append").text(path)
    elif fmt == "jsonl":
        plain.write.mode(mode).option("ignoreNullFields", False).json(path)
    elif fmt == "text":
        text_lines(df).write.mode(mode).text(path)
    elif fmt == "parquet":
        plain.write.mode(mode).parquet(path)
    else:
        raise ValueError(f"no such format: {fmt}")


def _cell(v: str, delimiter: str) -> str:
    return '"' + v.replace('"', '""') + '"' if any(x in v for x in (delimiter, '"', "\r", "\n")) else v


def csv_lines(df: DataFrame, delimiter: str) -> DataFrame:
    """`value`: rows as CSV. Quotes stand around a field that holds a delimiter, a quote or a break, or has white space or a control character at an end, which readers would trim."""

    def cell(c: Column) -> Column:
        quote = c.contains(F.lit(delimiter)) | c.rlike(r'["\r\n]|\A[\x00-\x20]|[\x00-\x20]\z')
        return F.coalesce(F.when(quote, F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c), F.lit(""))

    cells = texts(df)
    return cells.select(F.concat_ws(delimiter, *[cell(quoted(n)) for n in cells.columns]).alias("value"))


def text_lines(df: DataFrame) -> DataFrame:
    """`_line`, or the text columns joined by tabs, other columns blank."""
    if "_line" in df.columns:
        return df.select(F.coalesce(F.col("_line").cast("string"), F.lit("")).alias("value"))
    cols = [F.coalesce(quoted(f.name), F.lit("")) if isinstance(f.dataType, T.StringType) else F.lit("") for f in df.schema.fields if not f.name.startswith("__")]
    return df.select(F.concat_ws("\t", *cols).alias("value"))


def render(df: DataFrame, fmt: str, delimiter: str = ",", header: bool = True, max_width: int = 40, max_rows: int = 0, **_) -> str:
    """The result as one string, row by row from the driver's iterator; meant for results that a caller reads."""
    names = [c for c in df.columns if not c.startswith("__")]
    out = io.StringIO()
    if fmt == "jsonl":
        for r in df.select(F.to_json(F.struct(*[quoted(c) for c in names]), {"ignoreNullFields": "false"}).alias("v")).toLocalIterator():
            out.write(r.v + "\n")
    elif fmt == "text":
        for r in text_lines(df).toLocalIterator():
            out.write(r.value + "\n")
    elif fmt == "table":
        rows = texts(df.limit(max_rows) if max_rows else df).collect()
        cells = [[("" if v is None else v)[:max_width] for v in r] for r in rows]
        width = [max([len(n[:max_width]), *(len(r[k]) for r in cells)]) for k, n in enumerate(names)]
        line = lambda r: "| " + " | ".join(v.ljust(w) for v, w in zip(r, width)) + " |\n"
        out.write(line([n[:max_width] for n in names]))
        out.write("| " + " | ".join("-" * w for w in width) + " |\n")
        for r in cells:
            out.write(line(r))
    else:
        def line(cells) -> str:
            return delimiter.join(_cell(v, delimiter) for v in cells) + "\n"

        if header:
            out.write(line(names))
        for r in texts(df).toLocalIterator():
            out.write(line("" if v is None else v for v in r))
    return out.getvalue()
