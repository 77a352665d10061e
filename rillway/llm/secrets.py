"""Secret scans, in DataFrame functions only.

Base patterns: assignments of a key name to 12 characters or more, access key ids, and runs of
16 or more lower-case hex digits. Besides, candidate strings (runs of 20 or more of A-Za-z0-9+/_=-) are
scanned with a window of `WINDOW` characters: the counts of the characters in it, packed into six longs, and the sum of c * log2(c) over them, in
whole numbers, are carried from one window to the next by what the leaving and the entering character change, so each window
costs a constant number of steps, and no rounding adds up. A candidate is a secret if a window that overlaps no placeholder reaches the
threshold of its character class, the class being that of all characters up to the next placeholder. Left out are
what consists of words of one case, capitalised or in camel case without digits, paths from / or // on whose words end in
digits at most, plain numbers and UUIDs.

Spans are kind:start:end in code points, the end exclusive, by start and then kind.

Positions come from running sums over the matches in log2(n) rounds, redacted texts from pieces of `CHUNK` characters: no
array and no text grows step by step, so long texts and long runs take time in proportion (up to that logarithm).

Defined results: null text is empty and has no spans; very long texts and runs are scanned whole; repeated rows each get a row; an empty table gives an
empty result; other columns are ignored by scan() and kept by redact().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Bits per character in the best window, by class of characters.
THRESHOLD = {"hex": 2.9, "upper": 3.5, "mixed": 3.7}
#: Windows that overlap one of these don't count.
PLACEHOLDER = r"(?i)(example|placeholder|changeme|your[_-]|x{4,}|0{4,}|1234567)=*"
#: Runs, or what is left of them between placeholders, that are words of letters, a path of words and numbers, numbers or a UUID.
LETTERS = r"^[A-Za-z_=/+-]+$"
PATH = r"^//?[A-Za-z0-9][A-Za-z0-9_=/+-]*$"
NUMBERS = r"^[0-9_=/+-]+$|^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"
#: Not so in words: a capital within one that has no small letter behind it; more than one before a small one; a digit before a letter.
NO_WORD = r"[a-z][A-Z](?![a-z])|[A-Z]{2}[a-z]"
NO_NUMBER = r"[0-9][A-Za-z]"
#: Characters of a piece of text from which redacted texts are put together.
CHUNK = 4096
#: Where the count of each ASCII character of a candidate is kept: 64 * (which long) + (its first bit); five bits hold counts up to 31.
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_SLOT = [64 * (_ALPHABET.find(chr(c)) // 12) + 5 * (_ALPHABET.find(chr(c)) % 12) if chr(c) in _ALPHABET else 64 * 5 + 55 for c in range(128)]
_ONE = 1 << 40


def let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def running(values: Column, join=lambda a, b: a + b) -> Column:
    """The sums (or other joins) of each element of array<int> and all before it, by doubling steps."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))

    def step(acc, k):
        return F.transform(acc, lambda x, i: join(x, F.coalesce(F.get(acc, i - F.call_function("shiftleft", F.lit(1), k)), F.lit(0))))

    return F.aggregate(rounds, values, step)


def _spans(text: Column, pattern: str, kind: int, found: Column, keep: Column | None = None) -> Column:
    """array<struct<start, kind, end>> of the matches `found` of pattern in text.

    The pieces between matches give the positions; keep: array<boolean> beside found.
    """
    sizes = F.transform(found, F.length)
    ends = running(F.zip_with(F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(found)), F.length), sizes, lambda p, m: p + m))
    spans = F.zip_with(ends, sizes, lambda e, m: F.struct((e - m).alias("start"), F.lit(kind).alias("kind"), e.alias("end")))
    if keep is not None:
        spans = F.transform(F.filter(F.zip_with(spans, keep, lambda s, k: F.struct(s.alias("s"), k.alias("k"))), lambda x: x["k"]), lambda x: x["s"])
    return F.when(F.size(found) > 0, spans).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))


def entropy(c: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy, in bits, of a window over the ASCII string c (all of it if it is shorter)."""
    if not 0 < window < 32:
        raise ValueError("a window of 1 to 31 characters")
    xlog = [0 if n < 2 else round(n * math.log2(n) * _ONE) for n in range(window + 2)]
    # what the n-th of equal characters adds
    gain = F.array(*[F.lit(a - b).cast("bigint") for a, b in zip(xlog, [0, *xlog])])
    slots = F.transform(F.split(c, "", -1), lambda ch: F.get(F.array(*[F.lit(x) for x in _SLOT]), F.ascii(ch)))
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).cast("bigint").alias("sum"), F.lit(2**62).cast("bigint").alias("low"), *[F.lit(0).cast("bigint").alias(f"n{j}") for j in range(6)])

    def scan(slots):
        w = F.least(F.lit(window), F.size(slots))

        def count(acc, slot):
            word = F.get(F.array(*[acc[f"n{j}"] for j in range(6)]), F.shiftright(slot, 6))
            return F.call_function("shiftright", word, slot.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(31).cast("bigint")).cast("int")

        def bit(slot, j):
            return F.when(F.shiftright(slot, 6) == j, F.call_function("shiftleft", F.lit(1).cast("bigint"), slot.bitwiseAND(F.lit(63)))).otherwise(F.lit(0).cast("bigint"))

        def step(acc, slot):  # the character at `at` enters, the one w before it leaves
            gone = F.coalesce(F.get(slots, acc["at"] - w), F.lit(-64))
            moved = acc["sum"] - F.coalesce(F.get(gain, count(acc, gone)), F.lit(0).cast("bigint")) + F.get(gain, count(acc, slot) + 1)
            total = F.when(gone == slot, acc["sum"]).otherwise(moved)
            counts = [(acc[f"n{j}"] - bit(gone, j) + bit(slot, j)).alias(f"n{j}") for j in range(6)]
            # `low` takes in the sum of the window before; the last one follows at the end
            return F.struct((acc["at"] + 1).alias("at"), total.alias("sum"), F.when(acc["at"] >= w, F.least(acc["low"], acc["sum"])).otherwise(acc["low"]).alias("low"), *counts)

        return F.aggregate(slots, zero, step, lambda acc: F.log2(w.cast("double")) - F.least(acc["low"], acc["sum"]).cast("double") / _ONE / w)

    return let(slots, scan)


def _high(c: Column) -> Column:
    """Whether a window of the string c that overlaps no placeholder reaches its threshold."""

    def part(p):
        hexa, upper = p.rlike("^[0-9a-f]+$|^[0-9A-F]+$"), p.rlike("^[0-9A-Z]+$")
        need = F.when(hexa, F.lit(THRESHOLD["hex"])).when(upper, F.lit(THRESHOLD["upper"])).otherwise(F.lit(THRESHOLD["mixed"]))
        words = (p.rlike(LETTERS) | p.rlike(PATH) & ~p.rlike(NO_NUMBER)) & ~p.rlike(NO_WORD)
        return F.when((F.length(p) < WINDOW) | p.rlike(NUMBERS) | words, F.lit(False)).otherwise(entropy(p) >= need)

    return F.exists(F.split(c, PLACEHOLDER, -1), part)


def with_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with __spans: array<struct<start, kind, end>> in order, kind as the place in KINDS."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.withColumn("__t", text)
    df = df.withColumn("__a", F.regexp_extract_all("__t", F.lit(ASSIGN), F.lit(0)))
    df = df.withColumn("__k", F.regexp_extract_all("__t", F.lit(ACCESS), F.lit(0)))
    df = df.withColumn("__h", F.regexp_extract_all("__t", F.lit(HEX), F.lit(0)))
    df = df.withColumn("__c", F.regexp_extract_all("__t", F.lit(CANDIDATE), F.lit(0)))
    long = F.transform(F.when(F.size("__a") > 0, F.regexp_extract_all("__t", F.lit(ASSIGN), F.lit(2))), lambda s: F.length(s) >= 12)
    spans = F.concat(
        _spans(F.col("__t"), ASSIGN, 0, F.col("__a"), long),
        _spans(F.col("__t"), ACCESS, 1, F.col("__k")),
        _spans(F.col("__t"), HEX, 2, F.col("__h")),
        _spans(F.col("__t"), CANDIDATE, 3, F.col("__c"), F.transform("__c", _high)),
    )
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    some = F.size("__a") + F.size("__k") + F.size("__h") + F.size("__c") > 0
    return df.withColumn("__spans", F.when(some, F.array_sort(spans)).otherwise(none)).drop("__a", "__k", "__h", "__c")


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row."""
    rows = with_spans(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    rows = rows.select("doc_id", "__spans")

    def n(kind):
        return F.size(F.filter("__spans", lambda s: s["kind"] == kind)).cast("long")

    return rows.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_joined(F.filter("__spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"), _joined(F.col("__spans")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span, or chain of overlapping spans, of text replaced by mark; n_chars follows where there is such a column."""
    # one struct holds the rows as they are, so that no name of theirs clashes
    df = with_spans(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text")))
    old = {c: F.col("row").getField(c) for c in docs.columns}
    df = df.withColumn("__pieces", F.when(F.size("__spans") > 0, F.regexp_extract_all("__t", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))))

    def between(a, b):
        """The characters from a up to b."""
        first = F.floor(a / CHUNK).cast("int")
        some = F.array_join(F.slice("__pieces", first + 1, F.floor(F.greatest(b - 1, a) / CHUNK).cast("int") - first + 1), "")
        return F.when(b > a, F.substr(some, a - first * CHUNK + 1, b - a)).otherwise(F.lit(""))

    def put(ends):
        """ends: the largest end of each span and all before it."""
        before = F.transform(ends, lambda _, i: F.coalesce(F.get(ends, i - 1), F.lit(0)))
        cuts = F.filter(F.zip_with("__spans", before, lambda s, e: F.struct(e.alias("a"), s["start"].alias("b"))), lambda x: x["b"] >= x["a"])
        kept = F.transform(cuts, lambda x: F.concat(between(x["a"], x["b"]), F.lit(mark)))
        return F.concat(F.array_join(kept, ""), between(F.element_at(ends, -1), F.length("__t")))

    clean = let(running(F.transform("__spans", lambda s: s["end"]), F.greatest), put)
    hit = F.size("__spans") > 0
    new = {text_col: F.when(hit, clean).otherwise(old[text_col].cast("string"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(hit, F.length(clean).cast(docs.schema["n_chars"].dataType)).otherwise(old["n_chars"])
    return df.select(*[new.get(c, x).alias(c) for c, x in old.items()])


def op8_secret_scans(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))
