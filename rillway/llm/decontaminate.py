"""Benchmark decontamination by q-gram lemma filtering.

Texts are compared as plain characters: A-Z lower-cased, every run of other than letters, digits and
non-ASCII bytes one space; a character is a byte of the UTF-8 form. An item of length L is found in a text where the
edit distance to some stretch of it is at most `edits` * L. By the q-gram lemma such a stretch shares
at least L + 1 - q * (budget + 1) q-grams with the item, all of them on diagonals that differ by no more
than the budget.

1. A stretch must hold that many q-grams of any items at all: counted by running sums over the whole text, it leaves
   few regions.
2. There, q-grams are counted per item in diagonal bands of twice the budget that overlap by half.
3. Bands that meet the bound are verified by an alignment along the diagonals of the band and those within the budget beside it.

The lemma gives no bound to items of up to 7 and, at 8 % edits, of 13 to 15 characters: the first are sought as
whole words, the others by pieces of which one must be unchanged, and verified.

The items are sent to all tasks; their size is checked (`max_item_bytes`; a task needs about 100 times that while it sorts their q-grams). Beyond
it they are worked through in slices, each a pass over the texts whose result is written down before the next one is read.

Defined results: null text is empty; an item of which fewer than `least` characters remain, or null, matches nothing; a text that holds
an item several times gives one row for it, with the best distance; items with equal texts each give a row;
repeated documents each give rows, and so do several texts of one id; a very long text is read in overlapping pieces; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, PLAIN, SEP, as_bytes, cut, drop, table

Q = 8
_C = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22


def plain(text: bytes) -> bytes:
    return b" ".join(text.translate(PLAIN).split())


def grams(buf: bytes) -> np.ndarray:
    """The eight bytes from each position on, as one number."""
    n = len(buf) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for k in range(min(Q, n)):
        out[k::Q] = np.frombuffer(buf, "<u8", (len(buf) - k) // Q, k)
    return out


def aligned(item: bytes, text: bytes, budget: int) -> int | None:
    """Smallest edit distance between item and any stretch of text, or None above the budget.

    A row holds the cells of all diagonals on which item fits into text, and of `budget` more on both sides (there the text
    is continued by a byte that equals nothing): the cost is len(item) * (len(text) - len(item) + 2 * budget).
    """
    if item in text:
        return 0
    if len(text) + 2 * budget < len(item):
        return None
    edge = bytes([SEP]) * budget
    t = np.frombuffer(edge + text + edge, np.uint8)
    n = len(t) - len(item) + 1  # diagonals
    steps = np.arange(n)
    row = np.zeros(n, np.int64)
    for k, c in enumerate(item):
        new = row + (t[k : k + n] != c)
        np.minimum(new[:-1], row[1:] + 1, out=new[:-1])  # a character of item left out
        row = np.minimum.accumulate(new - steps) + steps  # one of text
        if row.min() > budget:
            return None
    return int(row.min())


class Items:
    """The q-grams of all items."""

    def __init__(self, items: list[tuple[int, bytes]], edits: float, least: int) -> None:
        kept = [(i, plain(t)) for i, t in items if t is not None]
        kept = [(i, t) for i, t in kept if len(t) >= max(1, least)]
        self.ids = np.array([i for i, _ in kept], np.int64)
        self.texts = [t for _, t in kept]
        self.len = np.array([len(t) for t in self.texts], np.int64)
        self.budget = np.floor(self.len * edits).astype(np.int64)
        self.need = self.len + 1 - Q * (self.budget + 1)
        self.short = self._short()
        g = [grams(t) if n > 0 else grams(b"") for t, n in zip(self.texts, self.need)]
        sizes = np.array([len(x) for x in g], np.int64)
        self.values, gram = np.unique(np.concatenate([*g, np.zeros(0, np.uint64)]), return_inverse=True)
        del g
        self.map = np.zeros(1 << _BITS, bool)
        self.map[self._slot(self.values)] = True
        # classes of items of about one length share a running sum
        order = np.argsort(self.len)
        order = order[self.need[order] > 0]
        parts = np.array_split(order, min(6, len(order))) if len(order) else []
        self.classes = [(int((self.len + self.budget)[p].max()), int(self.need[p].min())) for p in parts]
        of = np.zeros(len(self.texts), np.int64)
        for k, p in enumerate(parts):
            of[p] = k
        # the postings of a q-gram, class by class
        item = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        key = gram * max(1, len(parts)) + np.repeat(of, sizes)
        by = np.argsort(key, kind="stable")
        self.item = item[by]
        self.pos = (np.arange(len(item)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)[by]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(key, minlength=len(self.values) * max(1, len(parts))))]).astype(np.int32)

    def _short(self):
        """An automaton of the items for which the lemma gives no bound, or None; it has (item, place in it) by piece.

        Items without a budget stand as words; of others, one of budget + 1 pieces stands unchanged.
        """
        a = ahocorasick.Automaton()
        pieces: dict[str, list[tuple[int, int]]] = {}
        for it in np.flatnonzero(self.need <= 0).tolist():
            t, n = self.texts[it].decode("latin-1"), int(self.budget[it]) + 1
            cuts = [k * len(t) // n for k in range(n + 1)]
            for b, e in zip(cuts, cuts[1:]) if n > 1 else [(-1, 0)]:
                pieces.setdefault(t[b:e] if n > 1 else f" {t} ", []).append((it, b))
        for p, of in pieces.items():
            a.add_word(p, (len(p), of))
        a.make_automaton()
        return a if pieces else None

    def search_short(self, text: bytes) -> Iterator[tuple[int, int]]:
        """(item number, distance) of items for which the lemma gives no bound; text is plain and whole."""
        best: dict[int, int] = {}
        for end, (size, of) in self.short.iter(f" {text.decode('latin-1')} "):
            for it, place in of:
                if best.get(it) == 0:
                    continue
                if place < 0:
                    best[it] = 0
                    continue
                budget, start = int(self.budget[it]), end - size - place  # of the item in text
                d = aligned(self.texts[it], text[max(0, start - budget) : start + int(self.len[it]) + budget], budget)
                if d is not None:
                    best[it] = min(d, best.get(it, d))
        yield from best.items()

    @staticmethod
    def _slot(g: np.ndarray) -> np.ndarray:
        return (g * _C) >> np.uint64(64 - _BITS)

    def search(self, texts: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(text number, item number, distance); texts are plain."""
        if not len(self.values) or not texts:
            return
        buf = bytes([SEP]).join(texts)
        g = grams(buf)
        at = np.flatnonzero(self.map[self._slot(g)])
        if not len(at):
            return
        k = np.searchsorted(self.values, g[at])
        k[k == len(self.values)] = 0
        ok = self.values[k] == g[at]
        at, k = at[ok], k[ok]
        ends = np.cumsum([len(t) + 1 for t in texts])
        begins = np.concatenate([[0], ends[:-1]])
        best: dict[tuple[int, int], int] = {}
        for kind, (width, need) in enumerate(self.classes):
            # 1. enough q-grams of any items in a stretch
            ahead = np.searchsorted(at, at + width - Q + 1) - np.arange(len(at))
            starts = np.flatnonzero(ahead >= need)
            cover = np.bincount(starts, minlength=len(at) + 1) - np.bincount(starts + ahead[starts], minlength=len(at) + 1)
            keep = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
            place = k[keep] * len(self.classes) + kind
            count = self.first[place + 1] - self.first[place]
            keep, count = keep[count > 0], count[count > 0]
            if not len(keep):
                continue
            for part in np.array_split(keep, 1 + int(count.sum(dtype=np.int64)) // 4_000_000):
                if len(part) < len(keep):  # a slice: with what an item before it can reach
                    part = keep[np.searchsorted(at[keep], at[part[0]] - width) : np.searchsorted(keep, part[-1], "right")]
                self._bands(buf, at[part], k[part] * len(self.classes) + kind, begins, ends, best)
        for (doc, it), d in best.items():
            yield doc, it, d

    def _bands(self, buf, at, place, begins, ends, best):
        first = self.first[place].astype(np.int64)
        n = self.first[place + 1] - first
        p = np.repeat(at, n)
        row = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        item, pos = self.item[row].astype(np.int64), self.pos[row]
        width = 2 * self.budget[item] + 1
        diag = p - pos + len(buf)  # never negative
        # 2. bands
        found = []
        span = np.int64(4 * len(buf) + 8)
        for shift in (0, 1):
            key = item * span + (diag + shift * (width // 2 + 1)) // (width + 1)
            by = np.argsort(key)
            key = key[by]
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            count = np.diff(np.append(edge, len(key)))
            it = item[by[edge]]
            for e in np.flatnonzero(count >= self.need[it]):
                rows = by[edge[e] : edge[e] + count[e]]
                found.append((int(it[e]), int(diag[rows].min() - len(buf)), int(diag[rows].max() - len(buf)), int(p[rows].min())))
        # 3. verify
        for it, low, high, where in found:
            doc = int(np.searchsorted(ends, where, "right"))
            budget = int(self.budget[it])
            if best.get((doc, it), budget + 1) == 0:
                continue
            a = max(int(begins[doc]), low - budget)
            z = min(int(ends[doc]) - 1, high + int(self.len[it]) + budget)
            d = aligned(self.texts[it], buf[a:z], budget)
            if d is not None:
                best[doc, it] = min(d, best.get((doc, it), d))


def _blocks(texts: list[bytes], reach: int) -> Iterator[tuple[list[int], list[bytes]]]:
    rows: list[int] = []
    held: list[bytes] = []
    size = 0
    for k, t in enumerate(texts):
        t = plain(t)
        step = max(BLOCK_BYTES, 2 * reach)
        for a in range(0, max(1, len(t) - reach), step - reach):  # long texts in overlapping pieces
            rows.append(k)
            held.append(t[a : a + step])
            size += len(held[-1])
            if size >= BLOCK_BYTES:
                yield rows, held
                rows, held, size = [], [], 0
    if rows:
        yield rows, held


def _hits(found: Items, texts: list[bytes]) -> dict[tuple[int, int], int]:
    out: dict[tuple[int, int], int] = {}
    reach = int((found.len + found.budget).max()) + 1 if len(found.len) else 1
    for rows, held in _blocks(texts, reach):
        for doc, it, d in found.search(held):
            key = (rows[doc], it)
            out[key] = min(d, out.get(key, d))
    if found.short:
        for k, t in enumerate(texts):
            for it, d in found.search_short(plain(t)):
                out[k, it] = d
    return out


def item_slices(bench: DataFrame, id_col: str, text_col: str, max_item_bytes: int) -> tuple[int, Iterator[list[tuple[int, bytes]]]]:
    """(number of slices, the items in slices of about max_item_bytes each, one after another)."""
    rows = bench.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").cast("binary").alias("t")).where("t is not null")
    total = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    n = int(total // max_item_bytes) + 1
    return n, ([(r.i, bytes(r.t)) for r in rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()] for k in range(n))


_held: dict[str, Items] = {}


def _items(key: str, items: list[tuple[int, bytes]], edits: float, least: int) -> Items:
    """The index of this Python worker; it outlives a task. Only the last one is held."""
    if key not in _held:
        _held.clear()
        _held[key] = Items(items, edits, least)
    return _held[key]


def find_leaks(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", edits: float = 0.08, least: int = 1, max_item_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, item_id, distance of every item that stands in a document with at most edits * length edits."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("t"))

    def finder(items):
        key = uuid.uuid4().hex

        def run(batches):
            found = _items(key, items, edits, least)
            for b in batches:
                hits = _hits(found, b.column(1).to_pylist())
                ids = b.column(0).take(pa.array([k for k, _ in hits], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([int(found.ids[i]) for _, i in hits], pa.int64()), pa.array(list(hits.values()), pa.int64())], ["doc_id", "item_id", "distance"])

        return run

    n, slices = item_slices(bench, item_col, item_text_col, max_item_bytes)
    out = None
    for items in slices:
        part = rows.mapInArrow(finder(items), "doc_id long, item_id long, distance long")
        part = cut(part)[0] if n > 1 else part
        out = part if out is None else out.union(part)
    return out


def drop_leaks(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", edits: float = 0.08, least: int = 1, max_item_bytes: int = 4 << 20) -> DataFrame:
    """The rows of docs that hold no item; no shuffle."""

    def keeper(items, at):
        key = uuid.uuid4().hex

        def run(batches):
            found = _items(key, items, edits, least)
            for b in batches:
                hits = _hits(found, [t or b"" for t in b.column(at).cast(pa.binary()).to_pylist()])
                keep = np.ones(b.num_rows, bool)
                keep[[k for k, _ in hits]] = False
                yield b.filter(pa.array(keep))

        return run

    n, slices = item_slices(bench, item_col, item_text_col, max_item_bytes)
    before = None
    for k, items in enumerate(slices):
        docs = docs.mapInArrow(keeper(items, docs.columns.index(text_col)), docs.schema)
        if k < n - 1:
            docs, path = cut(docs)
            if before:
                drop(docs.sparkSession, before)
            before = path
    return docs


def op9_benchmark_decontamination(spark, sf_dir):
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
