"""Embedding near-dedup by spherical-cap filters.

A filter is a cap around a direction of a structured random product code: the dimensions are
turned at random and split into blocks, each block has its own random codewords, and a
direction is one codeword of every block. A vector is list-decoded to all directions
whose inner product exceeds a threshold: block by block, partial sums that cannot
reach it any more are dropped. Vectors that share a filter are compared in double precision.

A pair that shares several filters counts only in the smallest one, so each task returns
the number of new partners of each vector and spanning edges, and no pair is emitted. Filters with
more than `group_cap` vectors are cut into chunks and all pairs of chunks are compared.
Equal vectors are one class; its members count as links of one another.

The filters are random: a pair at the threshold is missed with a probability of about `miss`, a nearer one with much less: `turns_for` measures how
often a pair at the threshold shares a filter of one code, and takes as many codes, each with its own rotation, as that needs. The threshold of a
code is that of a cap with the share of the sphere it is to have, so it holds for any number of vectors.
Vectors of few dimensions (below 8) share one filter, which is exact.

Comparisons are made in single precision with a margin for its error; within the margin, in double precision.

Defined results: a vector that is null, zero, or holds null or non-finite components has no links
and is its own component; vectors of different lengths never link; a row with a null id is returned without links and component, and kept;
repeated ids of equal vectors count as links of one another, those of unlike vectors are vectors of their own; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, grouped, table
from .components import components
from .simhash import flatten


def cap_height(dim: int, share: float) -> float:
    """The height at which a cap holds that share of the unit sphere."""
    angle = np.linspace(0, np.pi, 100_001)[1:-1]
    log = (dim - 2) * np.log(np.sin(angle))
    area = np.cumsum(np.exp(log - log.max()))
    # of small shares the area is even smaller than the steps
    at = int(np.searchsorted(area, share * area[-1]))
    return math.cos(angle[min(at, len(angle) - 1)])


class ProductCode:
    """Directions made of one codeword a block; decode() lists those above the threshold.

    least: a vector whose best directions all lie below the threshold takes that many of the
    best ones, so that no vector and no tight group of vectors is without filters.
    """

    def __init__(self, dim: int, size: int, least: int, n_blocks: int = 2, seed: int = 11) -> None:
        rng = np.random.default_rng((seed, dim))
        self.least = least
        self.turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.edges = np.linspace(0, dim, n_blocks + 1).astype(int)
        self.codes = []
        for a, b in zip(self.edges, self.edges[1:]):
            c = rng.standard_normal((size, b - a))
            self.codes.append(c / np.linalg.norm(c, axis=1, keepdims=True) / math.sqrt(n_blocks))
        self.threshold = cap_height(dim, least / size**n_blocks)

    def _parts(self, unit: np.ndarray) -> list[np.ndarray]:
        y = unit @ self.turn
        return [y[:, a:b] @ c.T for (a, b), c in zip(zip(self.edges, self.edges[1:]), self.codes)]

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector number, filter id) of all exceeding directions."""
        parts = self._parts(unit)
        best = np.zeros((len(unit), 1))
        for p in parts:
            top = -np.partition(-p, min(self.least, p.shape[1]) - 1, axis=1)[:, : self.least]
            best = (best[:, :, None] + top[:, None, :]).reshape(len(unit), -1)
            best = -np.sort(-best, axis=1)[:, : self.least]
        need = np.minimum(self.threshold, best[:, -1] - 1e-12)
        most = [p.max(1) for p in parts]
        v, code, got = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit))
        for k, p in enumerate(parts):
            after = need - sum(most[k + 1 :], np.zeros(len(unit)))
            total = got[:, None] + p[v]
            i, j = np.nonzero(total >= after[v][:, None])
            v, code, got = v[i], code[i] * p.shape[1] + j, total[i, j]
        return v, code


def scaled(x: np.ndarray) -> np.ndarray:
    """x with each row divided by a power of two, so that its squares neither overflow nor vanish and no digit changes."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def turns_for(dim: int, size: int, least: int, threshold: float, miss: float, pairs: int = 300) -> int:
    """How many codes a pair at the threshold needs so that it shares no filter with a probability of `miss`."""
    if dim < 8:
        return 1
    rng = np.random.default_rng((5, dim))
    x, e = unit(rng.standard_normal((pairs, dim))), rng.standard_normal((pairs, dim))
    e = unit(e - (e * x).sum(1, keepdims=True) * x)
    y = threshold * x + math.sqrt(max(0.0, 1 - threshold**2)) * e
    shared = 0
    for t in range(3):
        code = ProductCode(dim, size, least, seed=11 + t)
        a, b = (set(zip(*(z.tolist() for z in code.decode(v)))) for v in (x, y))
        shared += len({v for v, _ in a & b})
    p = min(0.999, max(0.05, shared / (3 * pairs)))
    return max(2, math.ceil(math.log(miss) / math.log(1 - p)))


def _decoded(vectors: DataFrame, size: int, least: int, turns: dict[int, int]) -> DataFrame:
    """(cls, rep, n, v, dim, filters) of each class; filters ascending."""

    kind = np.int32 if max(turns.values(), default=1) * size**2 < 2**31 else np.int64

    def run(batches):
        codes: dict[int, list[ProductCode]] = {}
        for b in batches:
            v = b.column(3)
            lists: list = [None] * b.num_rows
            dims = np.array(pc.list_value_length(v).to_numpy(zero_copy_only=False), np.int64)
            flat, offsets = v.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(dims)])
            for d in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == d)
                if d >= 8 and d not in codes:
                    codes[d] = [ProductCode(d, size, least, seed=11 + t) for t in range(turns[d])]
                for k in range(0, len(rows), 512):
                    part = rows[k : k + 512]
                    if d < 8:
                        who, what = np.arange(len(part)), np.zeros(len(part), np.int64)
                    else:
                        x = unit(flat[offsets[part][:, None] + np.arange(d)])
                        found = [c.decode(x) for c in codes[d]]
                        who = np.concatenate([w for w, _ in found])
                        what = np.concatenate([f + t * size**2 for t, (_, f) in enumerate(found)])
                    by = np.lexsort((what, who))
                    who, what = who[by], what[by]
                    edges = np.searchsorted(who, np.arange(len(part) + 1))
                    for r, a, z in zip(part.tolist(), edges, edges[1:]):
                        lists[r] = what[a:z]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
            out = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*lists, np.zeros(0, np.int64)]).astype(kind), pa.from_numpy_dtype(kind)))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), pa.array(dims), out], ["cls", "rep", "n", "v", "dim", "filters"])

    return vectors.select("cls", "rep", "n", "v").mapInArrow(run, f"cls long, rep long, n long, v {vectors.schema['v'].dataType.simpleString()}, dim long, filters array<{'int' if kind == np.int32 else 'long'}>")


def _earlier(lists: list[np.ndarray], who: np.ndarray, f: int) -> np.ndarray:
    """0/1 rows of the filters below f that at least two of the vectors `who` share."""
    rows = np.concatenate([np.full(int((lists[w] < f).sum()), k) for k, w in enumerate(who)])
    ids = np.concatenate([lists[w][lists[w] < f] for w in who])
    values, inv, count = np.unique(ids, return_inverse=True, return_counts=True)
    keep = np.flatnonzero(count > 1)
    place = np.full(len(values), -1)
    place[keep] = np.arange(len(keep))
    ok = place[inv] >= 0
    out = np.zeros((len(who), len(keep)), np.float32)
    out[rows[ok], place[inv][ok]] = 1
    return out


def _near(x: np.ndarray, u: np.ndarray, at: slice, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows of x[at], rows of x) with a cosine of threshold or more; u: the unit vectors of x in single precision."""
    margin = 8 * x.shape[1] * np.finfo(np.float32).eps
    cos = u[at] @ u.T
    i, j = np.nonzero(cos >= threshold - margin)
    open_ = np.flatnonzero(cos[i, j] < threshold + margin)
    i = i + at.start
    ok = np.ones(len(i), bool)
    for k in range(0, len(open_), 1 << 14):
        some = open_[k : k + (1 << 14)]
        a, b = x[i[some]], x[j[some]]
        ok[some] = (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1)) >= threshold
    return i[ok], j[ok]


def _compare(threshold: float):
    def link(g: dict[str, np.ndarray]) -> list[dict]:
        x, cls, n, f = scaled(g["v"]), g["cls"], g["n"], int(g["f"][0])
        u = unit(x).astype(np.float32)
        # rows of chunk pair (a, b), a < b: only pairs across; what lies in one chunk meets in (a, a)
        side = g["mine"] if g["c1"][0] != g["c2"][0] else None
        pairs = []
        for k in range(0, len(x), 512):
            i, j = _near(x, u, slice(k, k + 512), threshold)
            ok = j < i
            if side is not None:
                ok &= side[i] != side[j]
            pairs.append((i[ok], j[ok]))
        i, j = (np.concatenate(p) for p in zip(*pairs))
        if not len(i):
            return []
        who = np.unique(np.concatenate([i, j]))
        lists = g["filters"]
        before = _earlier(lists, who, f)
        place = np.zeros(len(x), np.int64)
        place[who] = np.arange(len(who))
        if before.shape[1]:
            new = np.empty(len(i), bool)
            for k in range(0, len(i), 1 << 16):
                a, b = place[i[k : k + (1 << 16)]], place[j[k : k + (1 << 16)]]
                if len(who) <= 4096 and len(i) > len(who):
                    if not k:
                        gram = before @ before.T
                    new[k : k + (1 << 16)] = gram[a, b] == 0
                else:
                    new[k : k + (1 << 16)] = [not before[p] @ before[q] for p, q in zip(a, b)]
            i, j = i[new], j[new]
        if not len(i):
            return []
        links = np.bincount(i, n[j], len(x)) + np.bincount(j, n[i], len(x))
        label = flatten(np.arange(len(x)), i, j)
        at = np.flatnonzero(links)
        return [{"cls": cls[at], "links": links[at].astype(np.int64), "low": cls[label[at]]}]

    return link


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, miss: float = 1e-5, least: int = 2, fill: int = 256, group_cap: int = 2000) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    miss: see above; least: caps a vector falls into in each code on average, and at least; fill: vectors in a cap on average, from which the
    number of codewords follows.
    """
    spark = vectors.sparkSession
    single = dict(vectors.dtypes)[vector_col] == "array<float>"
    kind = "float" if single else "double"  # comparisons are in double precision all the same
    v = F.col(vector_col).cast(f"array<{kind}>")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.abs(x).cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.withColumn("v", F.when(F.coalesce(finite, F.lit(False)) & F.col("vec_id").isNotNull(), F.col("v")))
    rows = rows.withColumn("v", F.when(F.coalesce(norm, F.lit(0.0)) > 0, F.transform("v", lambda x: x + F.lit(0.0).cast(kind))))
    # equal vectors are one class; its number is only a name, fixed by writing it down
    plain, p0 = cut(rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")).withColumn("cls", F.monotonically_increasing_id()))
    size = max(16, math.isqrt(plain.count() * least // fill) + 1)
    turns = {r.d: turns_for(r.d, size, least, threshold, miss) for r in plain.select(F.size("v").alias("d")).distinct().collect()}
    classes, _ = cut(_decoded(plain, size, least, turns))
    drop(spark, p0)
    # only crowded caps are cut into chunks; they are written down, so that Spark knows how few they are before it deals the vectors
    crowded = classes.select("dim", F.explode("filters").alias("f")).groupBy("dim", "f").count().where(F.col("count") > group_cap)
    crowded, p1 = cut(crowded)
    dealt = classes.select("cls", "n", "v", "dim", "filters", F.explode("filters").alias("f")).join(crowded, ["dim", "f"], "left")
    chunks = F.coalesce(F.ceil(F.col("count") / F.lit(group_cap)), F.lit(1)).cast("int")
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("cls"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    dealt = dealt.withColumn("c1", F.least("mine", "other")).withColumn("c2", F.greatest("mine", "other"))
    found, _ = cut(grouped(dealt, ["dim", "f", "c1", "c2"], [], _compare(threshold), "cls long, links long, low long", {"cls": "num", "n": "num", "v": "list", "filters": "ragged", "mine": "num"}))
    drop(spark, p1)
    comp, _ = components(found.select(F.col("cls").alias("a"), F.col("low").alias("b")))
    comp = comp.select(F.col("id").alias("cls"), F.col("component").alias("label"))
    counts = found.groupBy("cls").agg(F.sum("links").alias("links"))
    of_class = classes.join(counts, "cls", "left").join(comp, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    # the smallest id of all classes with a label; a class that is alone has its own
    member = comp.union(comp.select(F.col("label").alias("cls"), "label").distinct()).join(classes.select("cls", "rep"), "cls")
    least_of = member.groupBy("label").agg(F.min("rep").alias("least"))
    of_class = of_class.join(least_of, "label", "left")
    of_class = of_class.select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
    good = rows.where("v is not null").join(of_class, "v").select("vec_id", "n_links", "component_id")
    bad = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.union(bad).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op4_embedding_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = {
    "op4_embedding_near_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
n AS (SELECT a, count(*) AS n FROM pairs GROUP BY a),
c AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(c.low, e.vec_id)) AS component_id, coalesce(e.vec_id = least(e.vec_id, coalesce(c.low, e.vec_id)), true) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.a = e.vec_id"""
}
