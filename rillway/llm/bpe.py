"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over eight bytes cuts each text where the content says so, so that passages
which documents share fall into the same chunks whatever stands before them. A task keeps chunks and words
it has encoded (two generations of bounded size): a shared chunk is encoded once and
looked up afterwards.

A chunk's words between its first and its last white space are trusted; the words that chunk edges may have cut are
joins. A join is encoded again by the tokenizer itself, as written, in a window with trusted words on both sides, until the ids of these words
come out exactly as the chunks have them; otherwise the window doubles, at last to the whole text. The
tokenizer never merges across ASCII white space, so agreement there means agreement everywhere.

Decoding starts from the ids alone.

Defined results: null text is empty and gives no tokens; special strings in a text are encoded as the tokenizer
does, whatever their case and wherever chunks end; repeated rows each get a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, table

_C = np.uint64(0x9E3779B97F4A7C15)
#: ASCII marks that the tokenizer takes as one piece; without the apostrophe and what special strings hold.
_MARKS = b'!"#$%&()*+,-./:;=?@[]^_`{}~'


def _byte_chars() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    out = {b: chr(b) for r in ((33, 126), (161, 172), (174, 255)) for b in range(r[0], r[1] + 1)}
    rest = [b for b in range(256) if b not in out]
    return out | {b: chr(256 + k) for k, b in enumerate(rest)}


_BYTE_CHARS = _byte_chars()


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def cuts(text: bytes, bits: int = 10) -> np.ndarray:
    """Where chunks end: behind each eight bytes whose hash starts with `bits` zeros."""
    n = len(text) - 7
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.empty(n, np.uint64)
    for k in range(min(8, n)):
        m = (len(text) - k) // 8
        h[k::8] = np.frombuffer(text, "<u8", m, k)
    h *= _C
    return np.flatnonzero(h < np.uint64(1 << (64 - bits))) + 8


class Kept:
    """A map with two generations: when the young one is full it becomes the old one."""

    def __init__(self, limit: int) -> None:
        self.limit, self.size, self.young, self.old = limit, 0, {}, {}

    def get(self, k):
        v = self.young.get(k)
        if v is None and (v := self.old.get(k)) is not None:
            self.put(k, v, 1)
        return v

    def put(self, k, v, size: int) -> None:
        if self.size >= self.limit:
            self.old, self.young, self.size = self.young, {}, 0
        self.young[k] = v
        self.size += size


class Coder:
    """encode() and decode() of one tokenizer file, with reuse. bits: chunks have about 2 ** bits bytes."""

    def __init__(self, path: str, words: int = 80_000, chunk_bytes: int = 8 << 20, bits: int = 10) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.bits = bits
        self.words: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.limit = words
        self.chunks, self.windows = Kept(chunk_bytes), Kept(chunk_bytes // 4)
        self.pieces = [(self.tok.id_to_token(k) or "").encode() for k in range(self.tok.get_vocab_size())]
        self.marks: dict[bytes, list[int]] = {}
        self.repaired = self.widened = 0  # joins encoded again, and windows that had to grow
        self.lower = True
        probes = [b"Word", b"the,", "\xc9t\xe9!!".encode(), b"and***", "stra\xdfe.".encode()]
        self.lower = all(self._plain(w) == self.tok.encode(w.decode(), add_special_tokens=False).ids for w in probes) and self.tok.encode("A", add_special_tokens=False).ids == self.tok.encode("a", add_special_tokens=False).ids
        if self.tok.decoder is not None:
            raise ValueError("this reuse needs a tokenizer that decodes by joining tokens with spaces")

    def _learn(self, missing: list[bytes]) -> None:
        if len(self.words) + len(missing) > self.limit:
            self.old, self.words = self.words, {}
        rest = []
        for w in missing:
            v = self.old.get(w)
            if v is None:
                got = self._plain(w) if self.lower else None
                if got is None:
                    rest.append(w)
                    continue
                v = np.array(got, "<u4").tobytes()
            self.words[w] = v
        for w, ids in zip(rest, self._tokenized(rest)):
            self.words[w] = ids

    def _tokenized(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text by the tokenizer itself."""
        out = []
        for k in range(0, len(texts), 4096):
            out += [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast([t.decode() for t in texts[k : k + 4096]], add_special_tokens=False)]
        return out

    def _plain(self, word: bytes) -> list[int] | None:
        """Ids of a word of Latin letters and at most some marks behind it, by the merges alone; None for any other.

        Normalizing leaves such letters as they are but for their case, and splitting parts them from the marks.
        """
        core = word.rstrip(_MARKS)
        if core.isalpha():
            letters = core.lower().decode()
        else:
            letters = core.decode().lower()
            if not letters.isalpha() or max(letters) > "\xff":
                return None
            letters = letters.encode().decode("latin-1").translate(_BYTE_CHARS)
        ids = [t.id for t in self.tok.model.tokenize(letters)]
        if len(core) < len(word):
            tail = word[len(core) :]
            got = self.marks.get(tail)
            if got is None:
                got = self.tok.encode(tail.decode(), add_special_tokens=False).ids
                if len(self.marks) < 10_000:
                    self.marks[tail] = got
            ids += got
        return ids

    def _word_ids(self, words: list[bytes]) -> list[bytes]:
        found = list(map(self.words.get, words))
        if None in found:
            self._learn(list({w for w, f in zip(words, found) if f is None}))
            get, old = self.words.get, self.old.get
            found = [f if f is not None else w_ if (w_ := get(w)) is not None else old(w) for w, f in zip(words, found)]
        return found

    def _chunk(self, chunk: bytes) -> tuple[bytes, list[bytes], list[bytes], bytes, bool]:
        """(head, trusted words, their ids, tail, whether there is white space): head and tail are what the edges may have cut, as written."""
        got = self.chunks.get(chunk)
        if got is None:
            words = chunk.split()
            head = b"" if chunk[:1].isspace() or not words else words.pop(0)
            if len(head) == len(chunk):
                got = (head, [], [], b"", False)
            else:
                tail = b"" if chunk[-1:].isspace() or not words else words.pop()
                # the tokenizer lower-cases itself, but not the special strings, which it looks for before
                if self.lower:
                    words = chunk[len(head) : len(chunk) - len(tail)].lower().split() if b"<" not in chunk else [w if b"<" in w else w.lower() for w in words]
                got = (head, words, self._word_ids(words), tail, True)
            self.chunks.put(chunk, got, len(chunk) * 8)
        return got

    def _joins(self, text: bytes) -> tuple[list[tuple[list[bytes], list[bytes]]], list[bytes]]:
        """(trusted parts, joins between them): the words of a part and their ids; only the first and the last part may be empty."""
        parts: list = [([], [])]
        joins: list[bytes] = []
        at, open_ = 0, b""

        def close() -> None:
            nonlocal open_
            if open_:
                if parts[-1][0] or not joins:
                    joins.append(open_)
                    parts.append(([], []))
                else:  # nothing trusted between this join and the one before
                    joins[-1] += b" " + open_
                open_ = b""

        for end in [*cuts(text, self.bits).tolist(), len(text)]:
            if at == end:
                continue
            head, words, ids, tail, space = self._chunk(text[at:end])
            at = end
            open_ += head
            if not space:  # the join goes on
                continue
            close()
            if words:
                parts[-1] = (parts[-1][0] + words, parts[-1][1] + ids) if parts[-1][0] else (words, ids)
            open_ = tail
        close()
        return parts, joins

    def encode(self, text: bytes) -> np.ndarray:
        """The ids of a UTF-8 text."""
        parts, joins = self._joins(text)
        repaired: list[bytes | None] = [None] * len(joins)
        left, size = list(range(len(joins))), 1
        while left:
            windows = [b" ".join([*parts[k][0][-size:], joins[k], *parts[k + 1][0][:size]]) for k in left]
            found = [self.windows.get(w) for w in windows]
            fresh = list({w for w, f in zip(windows, found) if f is None})
            made = dict(zip(fresh, self._tokenized(fresh)))
            for w, ids in made.items():
                self.windows.put(w, ids, len(w) * 4)
            found = [made[w] if f is None else f for w, f in zip(windows, found)]
            again = []
            for k, ids in zip(left, found):
                before, behind = b"".join(parts[k][1][-size:]), b"".join(parts[k + 1][1][:size])
                if len(ids) >= len(before) + len(behind) and ids.startswith(before) and ids.endswith(behind):
                    repaired[k] = ids[len(before) : len(ids) - len(behind)]
                elif size > max(len(parts[k][0]), len(parts[k + 1][0])):
                    return np.frombuffer(self._tokenized([text])[0], "<u4")
                else:
                    again.append(k)
            self.repaired += len(left)
            self.widened += len(again)
            left, size = again, size * 2
        out = []
        for k, (_, ids) in enumerate(parts):
            out += ids
            if k < len(joins):
                out.append(repaired[k])
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of these ids in UTF-8, special tokens too."""
        pieces = self.pieces
        return b" ".join([pieces[i] for i in ids.tolist()])


_coders: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """The coder of this Python worker; it outlives a task, so its chunks serve the next one."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids array<int>, decoded string."""
    path = path or default_path()

    def run(batches):
        c = coder(path)
        for b in batches:
            ids = [c.encode(t) for t in b.column(1).to_pylist()]
            decoded = [c.decode(x).decode() for x in ids]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
            flat = pa.array(np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int32))
            arrays = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(ends)), arrays, pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("t"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, without moving the ids and texts themselves."""
    path = path or default_path()

    def run(batches):
        c = coder(path)
        for b in batches:
            n, a, d = [], [], []
            for t in b.column(1).to_pylist():
                ids = c.encode(t)
                n.append(len(ids))
                a.append(hashlib.sha256(ids.tobytes()).hexdigest())
                d.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("t"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe_encoding(spark, sf_dir):
    return encode_digests(table(spark, sf_dir, "documents"))
