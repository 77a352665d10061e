"""Shared helpers of the training-data operators.

Everything here is bounded per task: texts are worked on in blocks of about a quarter of a
megabyte, groups arrive one after another from a sorted partition, and
intermediate tables are cut into the folder that the cluster shares.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTF-8 never holds this byte, so it separates texts that lie in one buffer.
SEP = 0xFF
BLOCK_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset a temporary one, but only if all of Spark is one process here."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if not own:
        own = spark.conf.get("spark.rillway.scratch", None)
    if not own:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = f"file://{tempfile.mkdtemp(prefix='rillway-')}"
        spark.conf.set("spark.rillway.scratch", own)
    return own


def cut(df: DataFrame) -> tuple[DataFrame, str]:
    """Write df as Parquet to the shared folder and read it back: (frame, path)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Remove a table that cut() wrote."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def as_bytes(text: Column | str) -> Column:
    """The text in UTF-8; null counts as empty."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(c.cast("string"), F.lit("")).cast("binary")


def blocks(texts: list[bytes], limit: int = BLOCK_BYTES) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(row numbers, texts) with about limit bytes each; a longer text is cut at a space near the limit."""
    rows: list[int] = []
    held: list[bytes] = []
    size = 0
    for k, t in enumerate(texts):
        at = 0
        while len(t) - at > limit:
            end = t.rfind(b" ", at + limit // 2, at + limit)
            end = at + limit if end < 0 else end
            yield np.array([k]), [t[at:end]]
            at = end
        rows.append(k)
        held.append(t[at:] if at else t)
        size += len(held[-1])
        if size >= limit:
            yield np.array(rows), held
            rows, held, size = [], [], 0
    if rows:
        yield np.array(rows), held


def _classes(pairs: str, other: int) -> np.ndarray:
    out = np.full(256, other, np.uint8)
    for k, chars in enumerate(pairs.split("\x00")):
        for c in chars:
            out[ord(c)] = k
    return out


WORD = np.zeros(256, bool)
for _r in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0xFF)):
    WORD[slice(*_r)] = True
#: A-Z to a-z and everything that is no letter, digit or non-ASCII byte to a space; SEP stays.
PLAIN = bytes(b + 32 if 0x41 <= b <= 0x5A else b if WORD[b] or b == SEP else 32 for b in range(256))
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = np.uint64(0x9E3779B97F4A7C15)
_RI = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_power: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_power.get("r", ())) < n:
        m = max(n, BLOCK_BYTES + 4096)
        for k, r in (("r", _R), ("i", _RI)):
            p = np.full(m, r, np.uint64)
            p[0] = 1
            _power[k] = np.cumprod(p)
    return _power["r"][:n], _power["i"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def words(texts: list[bytes], prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all lower-cased words, and the number of the text each stands in.

    With prefixes: a row of hashes for the words and one for their first k bytes of each k, 0 in words of k bytes or less.
    """
    buf = bytes([SEP]).join(texts).translate(PLAIN)
    a = np.frombuffer(buf, np.uint8)
    if not len(a):
        return np.zeros((1 + len(prefixes), 0) if prefixes else 0, np.uint64), np.zeros(0, np.int64)
    w = np.zeros(len(a) + 2, np.int8)
    w[1:-1] = (a != 32) & (a != SEP)
    step = np.diff(w)
    s, e = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    r, i = _powers(len(a) + 1)
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTE[a] * r[: len(a)], out=sums[1:])
    ends = np.cumsum([len(t) + 1 for t in texts])
    doc = np.searchsorted(ends, s, "right")
    h = mixed((sums[e] - sums[s]) * i[s])
    if not prefixes:
        return h, doc
    out = np.zeros((1 + len(prefixes), len(s)), np.uint64)
    out[0] = h
    for row, k in enumerate(prefixes, 1):
        at = np.flatnonzero(e - s > k)
        out[row, at] = mixed((sums[s[at] + k] - sums[s[at]]) * i[s[at]] + np.uint64(k))
    return out, doc


def grouped(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[dict[str, np.ndarray]], list[dict]], schema: str, fields: dict[str, str], parts: int | None = None) -> DataFrame:
    """fn over each group of equal keys with two rows or more, group after group from a sorted partition.

    fields: column -> "num", "list" (equal lengths in a group) or "ragged". A task holds one group
    and one batch of results at a time; the caller splits groups that could be large.
    """
    cols = list(dict.fromkeys(keys + order + list(fields)))
    base = df.select(*cols)
    base = base.repartition(parts, *keys) if parts else base.repartition(*keys)
    base = base.sortWithinPartitions(*keys, *[o for o in order if o not in keys])
    names = [f.strip().split(" ")[0] for f in schema.split(",")]

    def column(batch: pa.RecordBatch, name: str):
        c = batch.column(batch.schema.get_field_index(name))
        if fields.get(name) in ("list", "ragged"):
            return c
        return c.to_numpy(zero_copy_only=False)

    def to_numpy(parts: list, name: str):
        if fields.get(name) == "list":
            out = []
            for c in parts:
                if len(c):
                    flat = c.flatten().to_numpy(zero_copy_only=False)
                    out.append(flat.reshape(len(c), -1))
            return np.concatenate(out)
        if fields.get(name) == "ragged":
            out = []
            for c in parts:
                flat, ends = c.flatten().to_numpy(zero_copy_only=False), np.cumsum(c.value_lengths().to_numpy(zero_copy_only=False))
                out += [flat[a:z] for a, z in zip([0, *ends[:-1].tolist()], ends.tolist())]
            return out
        return np.concatenate(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {c: [] for c in cols}
        last = None
        made: list[dict] = []
        count = 0

        def close() -> None:
            nonlocal count
            if sum(len(x) for x in held[keys[0]]) > 1:
                for out in fn({c: to_numpy(held[c], c) for c in cols}):
                    made.append(out)
                    count += len(out[names[0]])
            for c in cols:
                held[c].clear()

        def flush() -> pa.RecordBatch:
            nonlocal count
            out = pa.RecordBatch.from_arrays([pa.array(np.concatenate([m[n] for m in made])) for n in names], names)
            made.clear()
            count = 0
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            values = {c: column(batch, c) for c in cols}
            k = [values[x] for x in keys]
            new = np.zeros(batch.num_rows, bool)
            new[0] = last is not None and any(x[0] != y for x, y in zip(k, last))
            for x in k:
                new[1:] |= x[1:] != x[:-1]
            at = np.flatnonzero(new)
            edges = [0, *at.tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                if a in (at[0] if len(at) else -1,) or a > 0:
                    close()
                if b > a:
                    for c in cols:
                        held[c].append(values[c][a:b])
            last = [x[-1] for x in k]
            if count > 50_000:
                yield flush()
        close()
        if made:
            yield flush()

    return base.mapInArrow(run, schema)
