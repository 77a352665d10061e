"""Plans over Structured Streaming.

Plans of row-by-row operators run on a streaming DataFrame unchanged; group-agg and frequency keep running totals in complete mode; unique keeps the
keys it has seen as Spark's state.

Operators along the order of rows (step, window, diff, fill-down, ewma, anomaly, label-encode, split-data, head, skip) run on each micro-batch as they do on a
table, and hand on what they have seen: sums, last values, the last few rows. Rows are ordered by the order key within a batch, and batches by
arrival. What is handed on is written beside the checkpoint, a file a batch, after the batch's result: a batch that is run again starts from the same
state and overwrites its own folder, so each row counts once.

Refused: what needs rows ahead (lead, interpolate, tail, sort and others that need the whole input), and onehot, whose columns would change.
"""

from __future__ import annotations

import datetime
import decimal
import json

from pyspark.sql import DataFrame, SparkSession

from ..api import Pipeline
from ..operators import OPS

#: Aggregates that Spark keeps as state; their sink needs output mode "complete".
AGGREGATES = ("group-agg", "group_agg", "frequency")


class StreamError(ValueError):
    pass


def transform_stream(p: Pipeline, df: DataFrame) -> tuple[DataFrame, str]:
    """(streaming DataFrame, output mode) of the plan's transforms over a streaming DataFrame, without operators along the order."""
    mode = "append"
    for s in p.plan.steps:
        if s.op not in OPS or OPS[s.op].stateless:
            continue
        if s.op in AGGREGATES and mode == "append":
            mode = "complete"
        elif s.op in ("unique", "dedup") and mode == "append":
            pass  # first arrivals, as state
        elif s.op == "sort" and mode == "complete":
            pass
        else:
            raise StreamError(f"{s.op} needs the whole input: run it as a batch")
    return p.apply(df).df, mode


def stateful_unique(df: DataFrame, columns: list[str], time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """First arrivals of each key; with a time column the state of keys older than `delay` is dropped."""
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark(columns) if time else df.dropDuplicates(columns)


def _kept(v):
    for kind, name in ((datetime.datetime, "datetime"), (datetime.date, "date")):
        if isinstance(v, kind):
            return {"$": name, "v": v.isoformat()}
    if isinstance(v, decimal.Decimal):
        return {"$": "decimal", "v": str(v)}
    raise TypeError(f"a state of {type(v).__name__}")


def _found(d: dict):
    make = {"datetime": datetime.datetime.fromisoformat, "date": datetime.date.fromisoformat, "decimal": decimal.Decimal}.get(d.get("$"))
    return make(d["v"]) if make else d


class Memory:
    """What operators hand on from batch to batch: a file a batch in a folder that only Spark's file systems need to reach."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        jvm = spark._jvm
        self.path = lambda k: jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/memory/{k}.json")
        self.fs = self.path(0).getFileSystem(spark._jsc.hadoopConfiguration())
        self.jvm = jvm

    def load(self, batch: int) -> dict:
        """The state before that batch."""
        if batch == 0:
            return {}
        at = self.path(batch - 1)
        if not self.fs.exists(at):
            raise StreamError(f"no state of batch {batch - 1}: the folder of the checkpoint is not complete")
        stream = self.fs.open(at)
        try:
            text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {int(k): v for k, v in json.loads(text, object_hook=_found).items()}

    def save(self, batch: int, state: dict) -> None:
        stream = self.fs.create(self.path(batch), True)
        try:
            stream.write(bytearray(json.dumps(state, default=_kept).encode()))
        finally:
            stream.close()
        self.fs.delete(self.path(batch - 2), False)  # only the state before a batch that may be run again is needed


def run_stream(p: Pipeline, df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", available_now: bool = True, order: list | str | None = None, **options):
    """Starts a query that writes the plan's result to path; checkpoint: a folder that all executors share.

    order: the key of plans with operators along the order; their result has a folder for each batch, and so a column `batch`.
    """
    ops = [OPS[s.op] for s in p.plan.steps if s.op in OPS]
    if any(o.stateful for o in ops):
        for o in ops:
            if not (o.stateless or o.stateful):
                raise StreamError(f"{o.name} needs the whole input: run it as a batch")
        memory = Memory(df.sparkSession, checkpoint)

        def put_next(batch: DataFrame, k: int) -> None:
            batch = batch.persist()
            state = memory.load(k)
            p.apply(batch, order=order, memory=state, **options).df.write.mode("overwrite").format(fmt).save(f"{path}/batch={k}")
            memory.save(k, state)
            batch.unpersist()

        writer = df.writeStream.foreachBatch(put_next)
    else:
        out, mode = transform_stream(p, df)
        if mode == "complete":

            def put(batch: DataFrame, _: int) -> None:
                batch.write.mode("overwrite").format(fmt).save(path)

            writer = out.writeStream.outputMode("complete").foreachBatch(put)
        else:
            writer = out.writeStream.outputMode("append").format(fmt).option("path", path)
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
