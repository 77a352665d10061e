"""Quality classifier: ordinal cumulative-link regression on graded ratings.

All grades share the weights of a hashed text; ordered thresholds part them: P(grade <= k) = sigmoid(t_k - w.x).
The text is hashed into shares of words, of triples of character classes, of immediate repetitions
and a bucket for its length; x is never laid out for scoring, since w.x is a sum over the text.

The query gives expected_grade (mean over the grades) and tail_probability (that the grade is `tail` or
higher; the top grade unless set); a document is kept where the latter is 0.5 or more.

The model is fitted on at most `sample` rated documents (the smallest hashes of their ids).

Defined results: null text is empty and is scored as such; null ratings are none, of several ratings of an id
the smallest counts; with one grade or none everything is kept with probability 1; repeated rows each get a row;
an empty table gives an empty result; other columns are ignored by score() and kept by keep_good().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SEP, as_bytes, blocks, table, words

WORD_BUCKETS = 1 << 14
_CLASS = np.full(256, 13, np.uint8)
for _k, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "", " ", "\n\r\t\x0b\x0c", ".,;", "!?", "*", "$%&#", "|", "\"'()[]{}<>", "/:@\\", "", "-_=+~^`")):
    for _c in _chars:
        _CLASS[ord(_c)] = _k
_CLASS[0x80:] = 3
_CLASS[SEP] = 15
N = WORD_BUCKETS + 4096 + 1 + 32


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text number, word or not) of all tokens of a block."""
    h, doc = words(texts)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    c = _CLASS[np.frombuffer(bytes([SEP]).join(texts), np.uint8)].astype(np.int64)
    if len(c) < 3:
        c = np.zeros(0, np.int64)
    t = c[:-2] * 256 + c[1:-1] * 16 + c[2:]
    ends = np.cumsum([len(x) + 1 for x in texts])
    tri_doc = np.repeat(np.arange(len(texts)), np.diff(np.concatenate([[0], ends])))[: len(t)]
    inside = (c[:-2] != 15) & (c[1:-1] != 15) & (c[2:] != 15)
    bucket = np.concatenate([(h >> np.uint64(50)).astype(np.int64), np.full(int(again.sum()), WORD_BUCKETS + 4096), WORD_BUCKETS + t[inside]])
    who = np.concatenate([doc, doc[again], tri_doc[inside]])
    kind = np.concatenate([np.zeros(len(h) + int(again.sum()), np.int64), np.ones(int(inside.sum()), np.int64)])
    return bucket, who, kind


def _length_bucket(n_words: np.ndarray) -> np.ndarray:
    return WORD_BUCKETS + 4097 + np.minimum(31, np.log2(n_words + 1).astype(np.int64))


class Ordinal:
    """Shared weights and ordered thresholds."""

    def __init__(self, grades: list) -> None:
        self.grades = np.array(grades, float)
        self.w = np.zeros(N)
        self.t = np.arange(len(grades) - 1, dtype=float) - (len(grades) - 2) / 2

    def linear(self, texts: list[bytes]) -> np.ndarray:
        sums, sizes = np.zeros((len(texts), 2)), np.zeros((len(texts), 2))
        for rows, held in blocks(texts):
            bucket, who, kind = _tokens(held)
            n_words = np.bincount(who[(kind == 0) & (bucket < WORD_BUCKETS)], minlength=len(held))
            w = self.w[bucket]
            for k in (0, 1):
                np.add.at(sums[:, k], rows, np.bincount(who[kind == k], w[kind == k], len(held)))
            np.add.at(sizes[:, 0], rows, n_words)
            np.add.at(sizes[:, 1], rows, np.bincount(who[kind == 1], minlength=len(held)))
        return (sums / np.maximum(sizes, 1)).sum(1) + self.w[_length_bucket(sizes[:, 0])]

    def cumulative(self, s: np.ndarray) -> np.ndarray:
        """P(grade <= k) for all but the last grade."""
        return 1 / (1 + np.exp(-np.clip(self.t[None, :] - s[:, None], -35, 35)))

    def probabilities(self, s: np.ndarray) -> np.ndarray:
        c = np.hstack([np.zeros((len(s), 1)), self.cumulative(s), np.ones((len(s), 1))])
        return np.maximum(np.diff(c, axis=1), 0)

    def fit(self, doc: np.ndarray, bucket: np.ndarray, value: np.ndarray, y: np.ndarray, steps: int = 250, rate: float = 0.3, ridge: float = 1e-5) -> None:
        """y: grade numbers from 0 on. Maximum likelihood by Adam over all rows; thresholds stay ordered as sums of exponentials."""
        n, k = len(y), len(self.t)
        used, place = np.unique(bucket, return_inverse=True)
        w = np.zeros(len(used))
        a = np.concatenate([self.t[:1], np.log(np.maximum(np.diff(self.t), 1e-3))])
        m1, m2 = np.zeros(len(used) + k), np.zeros(len(used) + k)
        eye = np.tril(np.ones((k, k)))
        for step in range(1, steps + 1):
            self.t = eye @ np.concatenate([a[:1], np.exp(a[1:])])
            s = np.bincount(doc, w[place] * value, n)
            c = np.hstack([np.zeros((n, 1)), self.cumulative(s), np.ones((n, 1))])
            low, high = c[np.arange(n), y], c[np.arange(n), y + 1]
            p = np.maximum(high - low, 1e-12)
            g_low, g_high = low * (1 - low) / p, high * (1 - high) / p
            gs = (g_high - g_low) / n  # of minus log likelihood by s
            gt = np.zeros(k + 2)
            np.add.at(gt, y + 1, -g_high / n)
            np.add.at(gt, y, g_low / n)
            gt = gt[1:-1]
            ga = eye.T @ gt * np.concatenate([[1.0], np.exp(a[1:])])
            g = np.concatenate([np.bincount(place, gs[doc] * value, len(used)) + ridge * w, ga])
            m1 = 0.9 * m1 + 0.1 * g
            m2 = 0.99 * m2 + 0.01 * g * g
            move = rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
            w -= move[: len(used)]
            a -= move[len(used) :]
        self.t = eye @ np.concatenate([a[:1], np.exp(a[1:])])
        self.w[used] = w


def sparse(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, values) of each text, as linear() weighs them."""
    out = []
    for t in texts:
        count: dict[int, np.ndarray] = {}
        size = [0, 0]
        for _, held in blocks([t]):
            bucket, _, kind = _tokens(held)
            for k in (0, 1):
                part = bucket[kind == k]
                size[k] += int((part < WORD_BUCKETS).sum()) if not k else len(part)
                count[k] = count.get(k, np.zeros(N)) + np.bincount(part, minlength=N)
        x = sum(c / max(1, size[k]) for k, c in count.items()) + np.zeros(N)
        x[_length_bucket(np.array([size[0]]))] = 1
        at = np.flatnonzero(x)
        out.append((at, x[at]))
    return out


def fit(docs: DataFrame, ratings: DataFrame, rating_col: str = "quality", sample: int = 4000) -> Ordinal:
    """docs (doc_id, text), ratings (doc_id, rating_col)."""
    known = ratings.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(rating_col).cast("double").alias("y")).where("doc_id is not null and y is not null and not isnan(y)")
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"))
    # at most `sample` ids, so they can be sent to every task
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes("text").alias("t")).join(F.broadcast(few), "doc_id").select("y", "t")

    def run(batches):
        for b in batches:
            x = sparse(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([a.astype("<i4").tobytes() for a, _ in x], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in x], pa.binary())], ["y", "at", "value"])

    got = rows.mapInArrow(run, "y double, at binary, value binary").collect()
    got.sort(key=lambda r: (r.y, bytes(r.at), bytes(r.value)))
    grades = sorted({r.y for r in got})
    model = Ordinal(grades if grades else [0.0])
    if len(grades) > 1:
        at = [np.frombuffer(r.at, "<i4") for r in got]
        doc = np.repeat(np.arange(len(got)), [len(a) for a in at])
        value = np.concatenate([np.frombuffer(r.value, "<f4") for r in got]).astype(float)
        model.fit(doc, np.concatenate(at), value, np.searchsorted(grades, [r.y for r in got]))
    return model


def _judged(model: Ordinal, texts: list[bytes], tail: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """expected grade, tail probability, kept"""
    p = model.probabilities(model.linear(texts)) if len(texts) else np.zeros((0, len(model.grades)))
    high = model.grades >= (model.grades[-1] if tail is None else tail)
    tails = p[:, high].sum(1)
    return p @ model.grades, tails, tails >= 0.5


def score(docs: DataFrame, model: Ordinal, tail: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_grade, tail_probability, kept of every row."""

    def run(batches):
        for b in batches:
            e, t, k = _judged(model, b.column(1).to_pylist(), tail)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(e), pa.array(t), pa.array(k)], ["doc_id", "expected_grade", "tail_probability", "kept"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("t"))
    return rows.mapInArrow(run, "doc_id long, expected_grade double, tail_probability double, kept boolean")


def keep_good(docs: DataFrame, model: Ordinal, tail: float | None = None, text_col: str = "text") -> DataFrame:
    """The rows of docs that the classifier keeps; no shuffle."""
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            texts = [t or b"" for t in b.column(at).cast(pa.binary()).to_pylist()]
            yield b.filter(pa.array(_judged(model, texts, tail)[2]))

    return docs.mapInArrow(run, docs.schema)


def op1_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
