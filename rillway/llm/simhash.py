"""SimHash near-dedup with a Gray-order hierarchical index.

A fingerprint is the bitwise majority over the XXH64 (seed 42) of all three-word shingles.

All distinct fingerprints are sorted by Gray rank and cut into ranges. A range is an upper node of one hierarchy: it holds the masked bit
pattern that its fingerprints share. Within a range, runs of sixteen share a node of their own, these again share one, and a child keeps
only the bits that its parent does not fix. A search adds up the differing bits from the ranges down to the fingerprints, and drops a whole group once they
exceed the distance; a fingerprint is sent only to ranges that it is not dropped from.

Of two fingerprints that differ in at most `distance` bits, one half has at most distance // 2 of them. So there are two
hierarchies, the second over the codes turned by 32 bits, and each also drops groups once the differences in the upper half exceed that: exact, and
it keeps the number of ranges that a fingerprint is sent to near the number of bits that ranges fix.

The table of ranges is sent to all tasks: at most `max_ranges` rows, beyond which ranges grow. Results are spanning edges, never all
pairs of a group.

Defined results: null text is empty; a text without words has fingerprint zero and links like any
other; rows whose id is null get their fingerprint, and the component of that fingerprint (null if no row of it has an id);
repeated rows stay repeated; unlike texts with one id are two documents: each has the smallest id that it reaches itself; an empty table gives an empty
result; other columns are ignored. keep_one() keeps, of each group, the row of the smallest id (of several texts with that id the one with the
smallest hash, of several rows with that text one), and all rows without an id.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, drop, grouped, table
from .components import components

DISTANCE = 3
FAN = 16
_UPPER = np.uint64(0xFFFFFFFF00000000)


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint of a UTF-8 text."""
    w = text.lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    ends = list(accumulate(len(x) + 1 for x in w))
    starts = [0, *ends[:-1]]
    xx = xxhash.xxh64_intdigest
    if len(w) < shingle:
        hashes = [xx(joined, seed)]
    else:
        hashes = [xx(joined[a : b - 1], seed) for a, b in zip(starts, ends[shingle - 1 :])]
    n = len(hashes)
    h = np.array(hashes, np.uint64)
    total = np.zeros(64, np.int64)
    for k in range(0, n, 255 * 64):
        part = np.unpackbits(h[k : k + 255 * 64].view(np.uint8)).reshape(-1, 64)
        full = len(part) // 255 * 255
        if full:
            total += part[:full].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        if full < len(part):
            total += part[full:].sum(0, dtype=np.uint8)
    bits = np.packbits((2 * total > n).astype(np.uint8))
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp, h): fp as a signed long, h a hash of the text."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), b.column(2)], ["doc_id", "fp", "h"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("t"), F.xxhash64(as_bytes(text_col)).alias("h"))
    return rows.mapInArrow(run, "doc_id long, fp long, h long")


def gray_rank(c):
    """Position of a code in Gray order, as an expression."""
    for k in (1, 2, 4, 8, 16, 32):
        c = c.bitwiseXOR(F.shiftrightunsigned(c, k))
    return c


def gray_order(codes: np.ndarray) -> np.ndarray:
    """The places that sort codes by Gray rank."""
    for k in (1, 2, 4, 8, 16, 32):
        codes = codes ^ (codes >> np.uint64(k))
    return np.argsort(codes, kind="stable")


class GrayIndex:
    """Hierarchical index over codes (or masked patterns of groups of codes) that are sorted by Gray rank."""

    def __init__(self, values: np.ndarray, masks: np.ndarray | None = None) -> None:
        self.fps = values
        mask, value = np.full(len(values), ~np.uint64(0)) if masks is None else masks, values
        self.levels = []
        while True:
            self.levels.append([mask, value])
            if len(mask) <= FAN:
                break
            at = np.arange(0, len(mask), FAN)
            ones, both = np.bitwise_or.reduceat(value, at), np.bitwise_and.reduceat(value, at)
            mask = np.bitwise_and.reduceat(mask, at) & ~(ones ^ both)
            value = both & mask
        for low, up in zip(self.levels, self.levels[1:]):
            parent = np.arange(len(low[0])) // FAN
            low.append(low[0] & ~up[0][parent])
        self.levels[-1].append(self.levels[-1][0])

    def within(self, queries: np.ndarray, distance: int = DISTANCE, upper: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """(query number, entry number) of all pairs at that distance or less, of which `upper` or less in the upper half."""
        top = len(self.levels[-1][0])
        q = np.repeat(np.arange(len(queries), dtype=np.int32), top)
        n = np.tile(np.arange(top, dtype=np.int32), len(queries))
        far, high = np.zeros(len(q), np.uint8), np.zeros(len(q), np.uint8)
        for depth in range(len(self.levels) - 1, -1, -1):
            _, value, own = self.levels[depth]
            other = (queries[q] ^ value[n]) & own[n]
            far = far + np.bitwise_count(other)
            ok = far <= distance
            if upper < distance:
                high = high + np.bitwise_count(other & _UPPER)
                ok &= high <= upper
            ok = np.flatnonzero(ok)
            q, n, far, high = q[ok], n[ok], far[ok], high[ok]
            if not depth:
                return q, n
            size = len(self.levels[depth - 1][0])
            q, far, high = np.repeat(q, FAN), np.repeat(far, FAN), np.repeat(high, FAN)
            n = (n[:, None] * np.int32(FAN) + np.arange(FAN, dtype=np.int32)).ravel()
            if size % FAN:
                ok = np.flatnonzero(n < size)
                q, n, far, high = q[ok], n[ok], far[ok], high[ok]


def flatten(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """label after joining the nodes i and j: each label the smallest number that is reached."""
    while len(i):
        a, b = label[i], label[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        if (low == high).all():
            return label
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


#: Queries at a time: even where all of a range is near, their pairs fit.
_STEP = 256


def _linked(distance: int):
    """Spanning edges of a group: of one range with itself (a = b), or of two."""

    def link(g: dict[str, np.ndarray]) -> list[dict]:
        codes, rep, own = g["code"].view(np.uint64), g["rep"], g["own"]
        one, other = int(g["a"][0]), int(g["b"][0])
        label = np.arange(len(codes))
        mine = np.flatnonzero(own == one)
        asked = mine if one == other else np.flatnonzero(own == other)
        if not len(mine) or not len(asked):
            return []
        mine = mine[gray_order(codes[mine])]
        asked = mine if one == other else asked[gray_order(codes[asked])]
        index = GrayIndex(codes[mine])
        for k in range(0, len(asked), _STEP):
            q, n = index.within(codes[asked[k : k + _STEP]], distance, distance // 2)
            if one == other:
                ok = q + k < n
                q, n = q[ok], n[ok]
            label = flatten(label, asked[k + q], mine[n])
        at = np.flatnonzero(label != np.arange(len(codes)))
        return [{"x": rep[at], "y": rep[label[at]]}] if len(at) else []

    return link


def _ranges(fps: DataFrame, group_cap: int, max_ranges: int) -> DataFrame:
    """(turn, rng, code, rep): both turns of all fingerprints, in ranges of Gray rank of about group_cap each."""
    n = min(max_ranges, fps.count() // group_cap + 1)
    turned = F.shiftleft("fp", 32).bitwiseOR(F.shiftrightunsigned("fp", 32))
    both = fps.select("rep", F.posexplode(F.array("fp", turned)).alias("turn", "code")).withColumn("rank", gray_rank(F.col("code")))
    # a range that holds the border between the turns is two
    return both.repartitionByRange(2 * n, "turn", "rank").select("turn", (2 * F.spark_partition_id() + F.col("turn")).cast("long").alias("rng"), "code", "rep")


def links(fps: DataFrame, distance: int = DISTANCE, group_cap: int = 8192, max_ranges: int = 1 << 14) -> DataFrame:
    """Spanning edges (a, b) over rep among distinct fingerprints (fp, rep) at `distance` or less."""
    if not 0 <= distance < 16:
        raise ValueError("a distance of 0 to 15 bits")
    rows, _ = cut(_ranges(fps, group_cap, max_ranges))
    # one row a range: at most 4 * max_ranges
    found = rows.groupBy("turn", "rng").agg(F.bit_and("code").alias("all"), F.bit_or("code").alias("some")).collect()
    nodes = {}
    for turn in (0, 1):
        own = [r for r in found if r.turn == turn]
        both, some = (np.array([r[k] for r in own], np.int64).view(np.uint64) for k in ("all", "some"))
        mask = ~(both ^ some)
        order = gray_order(both)
        nodes[turn] = (np.array([r.rng for r in own], np.int64)[order], (both & mask)[order], mask[order])

    def deal(batches):
        index = {t: (rng, GrayIndex(value, mask)) for t, (rng, value, mask) in nodes.items() if len(rng)}
        for b in batches:
            turn, own, code, rep = (b.column(k).to_numpy() for k in range(4))
            for t in np.unique(turn).tolist():
                rng, tree = index[t]
                at = np.flatnonzero(turn == t)
                for k in range(0, len(at), 1024):
                    part = at[k : k + 1024]
                    q, n = tree.within(code[part].view(np.uint64), distance, distance // 2)
                    part, to = part[q], rng[n]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.minimum(own[part], to), np.maximum(own[part], to), own[part], code[part], rep[part])], ["a", "b", "own", "code", "rep"])

    dealt = rows.mapInArrow(deal, "a long, b long, own long, code long, rep long")
    out = grouped(dealt, ["a", "b"], [], _linked(distance), "x long, y long", {"own": "num", "code": "num", "rep": "num"})
    return out.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def clusters(fps: DataFrame, distance: int = DISTANCE) -> tuple[DataFrame, list[str]]:
    """(fp, label, component_id) of every distinct fingerprint of (doc_id, fp): label is one of the fingerprints that it reaches, component_id the
    smallest doc_id; and the paths to drop later."""
    reps, p1 = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found, p2 = components(links(reps.select("fp", F.col("fp").alias("rep")), distance))
    found = found.select(F.col("id").alias("fp"), F.col("component").alias("label"))
    # the label itself is not among the ids
    member = found.union(found.select(F.col("label").alias("fp"), "label").distinct()).join(reps, "fp")
    least = member.groupBy("label").agg(F.min("rep").alias("least"))
    member, p3 = cut(member.select("fp", "label").join(least, "label"))
    out = reps.join(member, "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"), F.when(F.col("label").isNull(), F.col("rep")).otherwise(F.col("least")).alias("component_id"))
    return out, [p for p in (p1, p2, p3) if p]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that is reached) of every row."""
    fps, _ = cut(fingerprints(docs, id_col, text_col).drop("h"))
    comp, _ = clusters(fps, distance)
    return fps.join(comp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """The rows of docs, of each group only one row of its smallest id; rows without an id stay."""
    spark = docs.sparkSession
    fps, p0 = cut(fingerprints(docs.where(F.col(id_col).isNotNull()), id_col, text_col))
    comp, paths = clusters(fps, distance)
    kept, _ = cut(fps.join(comp, "fp").groupBy("label").agg(F.min(F.struct("doc_id", "h")).alias("k")).select(F.col("k.doc_id").alias("__kept"), F.col("k.h").alias("__h")).distinct())
    for p in [p0, *paths]:
        drop(spark, p)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    rows = docs.where(F.col(id_col).isNotNull()).select(row.alias("__r"), F.col(id_col).cast("long").alias("__id"), F.xxhash64(as_bytes(text_col)).alias("__t"), F.xxhash64(*plain).alias("__by"))
    one = rows.join(kept, (F.col("__id") == F.col("__kept")) & (F.col("__t") == F.col("__h")), "left_semi")
    one = one.groupBy("__id", "__t").agg(F.min_by("__r", "__by").alias("__r")).select("__r.*")
    return one.unionByName(docs.where(F.col(id_col).isNull()))


def op5_simhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
