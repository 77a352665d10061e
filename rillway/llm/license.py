"""License scans: an Aho-Corasick automaton finds identifier tags and notice phrases, a shunting-yard
parser evaluates the licence expressions behind the tags.

Words are runs of digits, letters and non-ASCII characters after lower-casing A-Z. A phrase
stands where its words follow one another, whatever stands between them.

Labels: the three base phrases give mit, apache-2 and cc-by-nc; other notices give the labels
in NOTICES; a tag (SPDX-License-Identifier) gives the lower-cased identifiers of its expression, `a with b` as
"a-with-b". Prose behind an expression in its line ends it; a tag behind which none parses gives the label "unknown".

An expression is evaluated on its postfix form, without expanding the choices: `or` offers either side, `and` asks for both. Labels that hold
whatever is chosen are required (of `or` what both sides require, of `and` what either does); the others are optional. It is permissive
if a choice holds permissive licences alone (`or`: either side, `and`: both, `with`: its licence).

score is 0 without evidence, otherwise 1 minus the product of what each label leaves open (base phrase and required label of a tag 0.1,
optional one 0.3, notice 0.4; the least of them where a label has several). permissive is null without a tag whose expression parses, else whether all such expressions are permissive.

Defined results: null text is empty: no words, no places, empty labels, score 0; very long texts are scanned whole; repeated rows
each get a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PLAIN, as_bytes, table

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
NOTICES = {
    "gnu general public license version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "boost software license": "bsl-1.0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0 universal": "cc0-1.0",
    "creative commons attribution noncommercial": "cc-by-nc",
    "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
OPEN = {"base": 0.1, "tag": 0.1, "optional": 0.3, "notice": 0.4}
#: Starts of identifiers of licences that ask for no more than a notice.
PERMISSIVE = ("0bsd", "afl", "apache", "artistic", "beerware", "blueoak", "boost", "bsd", "bsl", "cc-by-4", "cc0", "curl", "isc", "mit", "ncsa", "openssl", "pddl", "postgresql", "psf", "python", "unlicense", "upl", "wtfpl", "x11", "zlib")
_TAG_LINE = re.compile(r"spdx-license-identifier:[ \t]*((?:(?!spdx-license-identifier:)[^\r\n])*)", re.I)
_TOKEN = re.compile(r"\s*(?:([()])|([A-Za-z0-9.+:-]+))")
_NAMED = re.compile(r"(?=.*[a-z]).*[0-9-]|(?:mit|apache|bsd|isc|zlib|[al]?gpl|gfdl|mpl|epl|eupl|cddl|bsl|wtfpl|unlicense|proprietary|artistic|ncsa|postgresql|openssl|vim|ruby|python|x11|curl|beerware)$", re.I)
_RANK = {"or": 1, "and": 2, "with": 3}


def parse_expression(text: str) -> list | None:
    """The expression in postfix order by the shunting-yard algorithm, or None if it is none.

    Operators are and, or, with (in any case); with binds closest, then and, then or.
    """
    out: list = []
    ops: list[str] = []
    at, want = 0, True  # want: an identifier or "(" comes next
    text = text.strip().removesuffix("*/").removesuffix("-->").strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            return None
        at = m.end()
        paren, word = m.groups()
        if paren == "(":
            if not want:
                return None
            ops.append("(")
        elif paren == ")":
            if want:
                return None
            while ops and ops[-1] != "(":
                out.append((ops.pop(),))
            if not ops:
                return None
            ops.pop()
        elif word.lower() in _RANK:
            if want:
                return None
            k = word.lower()
            while ops and ops[-1] != "(" and _RANK[ops[-1]] >= _RANK[k]:
                out.append((ops.pop(),))
            ops.append(k)
            want = True
        else:
            if not want:
                return None
            out.append(word.lower())
            want = False
    if want or "(" in ops:
        return None
    return out + [(k,) for k in reversed(ops)]


def evaluate(postfix: list) -> list[frozenset[str]] | None:
    """The choices that an expression offers: each a set of licences that hold together."""
    stack: list = []
    for x in postfix:
        if isinstance(x, str):
            stack.append([frozenset([x])])
            continue
        b, a = stack.pop(), stack.pop()
        if x[0] == "or":
            stack.append(list(dict.fromkeys(a + b)))
        elif x[0] == "and":
            stack.append(list(dict.fromkeys(p | q for p in a for q in b)))
        else:
            if len(a) != 1 or len(b) != 1 or len(a[0]) != 1 or len(b[0]) != 1:
                return None
            stack.append([frozenset([f"{next(iter(a[0]))}-with-{next(iter(b[0]))}"])])
    return stack[0]


class Terms(NamedTuple):
    """What an expression comes to; the sets are not changed once made."""

    required: set[str]
    labels: set[str]
    permissive: bool


def evaluate_terms(postfix: list) -> Terms | None:
    """The expression evaluated from left to right, its choices not expanded; None where `with` does not join two licences."""
    stack: list[Terms] = []
    for x in postfix:
        if isinstance(x, str):
            stack.append(Terms({x}, {x}, x.startswith(PERMISSIVE)))
            continue
        b, a = stack.pop(), stack.pop()
        if x[0] == "with":
            if len(a.labels) != 1 or len(b.labels) != 1:
                return None
            both = {f"{next(iter(a.labels))}-with-{next(iter(b.labels))}"}
            stack.append(Terms(both, both, a.permissive))
        elif x[0] == "or":
            stack.append(Terms(a.required & b.required, _united(a.labels, b.labels), a.permissive or b.permissive))
        else:
            stack.append(Terms(_united(a.required, b.required), _united(a.labels, b.labels), a.permissive and b.permissive))
    return stack[0]


def _united(a: set[str], b: set[str]) -> set[str]:
    """a and b in the larger of them, so that a chain of operators costs no more than its length."""
    if len(a) < len(b):
        a, b = b, a
    return a | b if len(a) < 64 else (a.update(b) or a)


def expression_prefix(text: str) -> str:
    """The longest start of text that is an expression, or ""; text after it is prose.

    A word after a small-letter `and`, `or` or `with`, or a first word in small letters, must look like a licence. Where
    licences and operators alone fill the text, nothing parses: what they mean is open.
    """
    at, end, depth, want, prose = 0, 0, 0, True, False
    begun, last = False, ""
    while m := _TOKEN.match(text, at):
        paren, word = m.groups()
        word = (word or "").rstrip(".:-")
        stop = bool(m[2]) and len(word) < len(m[2])  # a full stop ends the expression
        if m[2] and not word:
            prose = True
            break
        operator = word.lower() in _RANK
        if paren == "(" and want:
            depth += 1
        elif paren == ")" and not want and depth:
            depth -= 1
        elif operator and not want:
            want, last = True, word
        elif word and not operator and want and (_NAMED.match(word) or (last.isupper() if last else not word.islower())):
            want, begun = False, True
        else:
            prose = paren == ")" and not want or bool(word) and not operator and not _NAMED.match(word)
            if not prose:  # licences without an operator between, up to the end or prose
                while m and (m[1] or m[2].lower() in _RANK or _NAMED.match(m[2])):
                    at = m.end()
                    m = _TOKEN.match(text, at)
                prose = bool(text[at:].strip())
            break
        at = m.end() - (len(m[2]) - len(word) if m[2] else 0)
        if begun and not want and not depth:
            end = at
        if stop:
            prose = True
            break
    return text[:end] if prose or text[at:].strip() else ""


def expression_terms(text: str) -> Terms | None:
    """What the expression that text starts with comes to; None if there is none."""
    postfix = parse_expression(text.strip().rstrip(".")) or parse_expression(expression_prefix(text))
    return evaluate_terms(postfix) if postfix else None


def expression_labels(text: str) -> set[str]:
    found = expression_terms(text)
    return found.labels if found else {"unknown"}


def automaton():
    a = ahocorasick.Automaton()
    for phrase in {**NOTICES, **BASE, TAG: ""}:
        # bytes as characters, with the space after the words before and behind
        a.add_word(f" {phrase} ", (phrase, len(phrase)))
    a.make_automaton()
    return a


def scan(text: bytes, auto) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, required, permissive of a UTF-8 text."""
    words = text.translate(PLAIN).split()
    plain = b" " + b" ".join(words) + b" "
    at, seen = 0, 0
    starts: list[int] = []
    base: set[str] = set()
    left: dict[str, float] = {}
    tags = False
    required: set[str] = set()
    permissive: bool | None = None
    for end, (phrase, size) in auto.iter(plain.decode("latin-1")):
        if phrase == TAG:
            tags = True
        elif phrase in BASE:
            begin = end - size - 1  # of the space before the first word
            if begin >= at:
                seen += plain.count(b" ", at, begin)
            else:
                seen -= plain.count(b" ", begin, at)
            at = begin
            starts.append(seen)
            base.add(BASE[phrase])
        else:
            left[NOTICES[phrase]] = OPEN["notice"]
    for k in base:
        left[k] = OPEN["base"]
    if "gpl" in left and left.keys() & {"gpl-2", "gpl-3"}:
        del left["gpl"]
    if tags:
        for m in _TAG_LINE.finditer(text.decode("utf-8", "replace")):
            found = expression_terms(m[1])
            if found is None:
                left["unknown"] = OPEN["tag"]
                continue
            required |= found.required
            permissive = found.permissive and permissive is not False
            for k in found.labels:
                left[k] = min(left.get(k, 1.0), OPEN["tag" if k in found.required else "optional"])
    score = 1.0 - float(np.prod(list(left.values()))) if left else 0.0
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(left)), score, ",".join(sorted(required)), permissive


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document; see scan()."""

    def run(batches):
        auto = automaton()
        for b in batches:
            rows = [scan(t, auto) for t in b.column(1).to_pylist()]
            cols = list(zip(*rows)) if rows else [()] * 9
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "required", "permissive"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("t"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, required string, permissive boolean")


def op2_license_scans(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents"))
