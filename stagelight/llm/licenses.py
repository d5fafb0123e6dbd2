"""Licence scan: an Aho-Corasick automaton over words finds notices and identifier tags, a shunting-yard parser evaluates tags.

Every text is lower-cased (A-Z) and cut into words; the automaton runs over the words joined by single blanks, so a phrase
matches exactly where its words stand consecutively. A tag's expression is read from the raw line after it.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import ALNUM, picked, record_batch, slices

#: Phrases of the contract; fixed values.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further notices; fixed values.
NOTICES = {
    "apache license": "apache", "licensed under the apache license version 2 0": "apache-2.0", "mit license": "mit",
    "permission is hereby granted free of charge": "mit", "bsd license": "bsd", "bsd 3 clause": "bsd-3-clause", "bsd 2 clause": "bsd-2-clause",
    "redistribution and use in source and binary forms": "bsd", "mozilla public license": "mpl", "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0", "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl",
    "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd", "cc0": "cc0",
    "public domain": "public-domain", "eclipse public license": "epl", "the unlicense": "unlicense", "copyright c": "copyright", "proprietary and confidential": "proprietary",
}
TAG = "spdx license identifier"
TAG_LINE = re.compile(rb"spdx-license-identifier[ \t]*:?[ \t]*([^\n\r]*)")
TOKEN = re.compile(r"[()]|[a-z0-9][a-z0-9.+-]*")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
#: How binding a licence is, by the start of its identifier; fixed values, 2 for others.
STRENGTH = {"mit": 0, "bsd": 0, "apache": 0, "isc": 0, "cc0": 0, "unlicense": 0, "zlib": 0, "cc-by-4": 0, "mpl": 1, "lgpl": 1, "epl": 1, "gpl": 2, "agpl": 3, "cc-by-nc": 3, "proprietary": 3}


def to_rpn(tokens: list[str]) -> list[str]:
    """Shunting yard over identifiers, and/or/with and parentheses; a stray parenthesis is dropped."""
    out, stack = [], []
    for t in tokens:
        if t in PRECEDENCE:
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[t]:
                out.append(stack.pop())
            stack.append(t)
        elif t == "(":
            stack.append(t)
        elif t == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if stack:
                stack.pop()
        else:
            out.append(t)
    return out + [t for t in reversed(stack) if t != "("]


def strength(licence: str) -> int:
    found = [p for p in STRENGTH if licence.startswith(p)]
    return STRENGTH[max(found, key=len)] if found else 2


def evaluate(expression: str) -> tuple[set[str], int] | None:
    """(identifiers, how binding the whole is): `or` leaves the freest choice, `and` the strictest, `with` eases by one.

    None for an expression without identifier or with an operator that lacks an operand. Text after the expression
    ends at the first identifier that follows another without an operator.
    """
    tokens, operand = [], False
    for t in TOKEN.findall(expression.lower()):
        if t not in PRECEDENCE and t not in "()":
            if operand:
                break
            operand = True
        elif t in PRECEDENCE:
            operand = False
        tokens.append(t)
    stack: list[tuple[set[str], int]] = []
    for t in to_rpn(tokens):
        if t not in PRECEDENCE:
            stack.append(({t}, strength(t)))
            continue
        if len(stack) < 2:
            return None
        b, a = stack.pop(), stack.pop()
        if t == "with":
            stack.append(({f"{x}-with-{y}" for x in a[0] for y in b[0]}, max(0, a[1] - 1)))
        else:
            stack.append((a[0] | b[0], (min if t == "or" else max)(a[1], b[1])))
    return stack[0] if len(stack) == 1 else None


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase in {*BASE_PHRASES, *NOTICES, TAG}:
        a.add_word(f" {phrase} ", (len(phrase) + 1, BASE_PHRASES.get(phrase), BASE_PHRASES.get(phrase) or NOTICES.get(phrase)))
    a.make_automaton()
    return a


SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("n_tags", pa.int64()), ("strictness", pa.int32()),
])


def scan(text: bytes, a: ahocorasick.Automaton) -> tuple:
    """The columns of one text after doc_id."""
    words = text.translate(ALNUM).split()
    line = b" ".join([b"", *words, b""]).decode("latin-1")
    base, labels, places, notices, tagged, at, seen = set(), set(), [], 0, False, 0, 0
    for end, (back, of_base, label) in a.iter(line):
        begin = end - back
        if label is None:
            tagged = True
            continue
        notices += 1
        labels.add(label)
        if of_base:
            seen = seen + line.count(" ", at, begin) if begin >= at else seen - line.count(" ", begin, at)
            at = begin
            places.append(seen)
            base.add(of_base)
    tags, strict = 0, None
    if tagged:
        for m in TAG_LINE.finditer(text.lower()):
            if found := evaluate(m[1].decode("utf-8", "replace")):
                tags += 1
                labels |= {re.sub(",", "", x) for x in found[0]}
                strict = max(strict or 0, found[1])
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1 - 0.5 ** (notices + 2 * tags), tags, strict


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: words, places of the base phrases, labels, a score that grows with the evidence, tags.

    `strictness` is that of the strictest tag (0 permissive to 3), NULL without one. A NULL or empty text has no words,
    no place and the labels ''. Repeated rows give repeated rows; the id may be NULL; other columns are not read.
    """

    def run(batches):
        a = automaton()
        for b in batches:
            for first, texts in slices(b.column(1)):
                rows = list(zip(*[scan(t, a) for t in texts]))
                yield record_batch(SCHEMA, doc_id=b.column(0).slice(first, len(texts)), **dict(zip(SCHEMA.names[1:], rows)))

    return picked(docs, doc_id=docs[id_col].cast("long"), text=text_col).mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_tags long, strictness int")
