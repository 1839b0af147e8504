"""License scan: one Aho-Corasick pass for notice phrases, one for identifier tags; expressions by shunting-yard.

Phrases are matched on the lower-cased words of the text, so a line break or a comma inside a phrase does not
hide it.  An ``SPDX-License-Identifier:`` tag is followed, on its line, by a licence expression with ``AND``,
``OR``, ``WITH`` and parentheses; the parser turns it into postfix order and evaluates it.

``score`` is how freely the text may be used, as its notices say: each licence has a freedom from 0 to 1, ``AND``
takes the least, ``OR`` the greatest of both sides, ``WITH`` moves a licence halfway to 1.  Several notices hold
together, so the least counts.  A text without any notice has score 0.

Edge cases: a null or empty text has no words, no labels and score 0.  A malformed expression (unbalanced
parentheses, an operator without a side) still gives the labels of its names, and scores 0.5.  Ties and repeated
rows need no rule: every row is judged alone.  Whole texts are read, in time proportional to their length.  Only doc_id and text are
read, so other columns cannot clash.  An empty table gives no rows.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strandlake.llm.batches import folded_words, map_rows, table, utf8

BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Phrases beyond the base ones and their labels.
MORE = {
    "bsd license": "bsd", "isc license": "isc", "mozilla public license": "mpl", "eclipse public license": "epl",
    "lesser general public license": "lgpl", "affero general public license": "agpl", "boost software license": "bsl-1.0",
    "creative commons attribution": "cc-by", "creative commons zero": "cc0", "public domain": "public-domain",
    "all rights reserved": "proprietary", "apache license version 2 0": "apache-2.0",
    "general public license version 2": "gpl-2.0", "general public license version 3": "gpl-3.0",
    "mozilla public license version 2 0": "mpl-2.0", "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit-style",
}
#: Freedom by the start of a label; the longest start that fits counts, other licences have 0.5.
FREEDOM = {
    "mit": 1.0, "apache": 0.95, "bsd": 1.0, "isc": 1.0, "bsl": 1.0, "cc0": 1.0, "public-domain": 1.0, "unlicense": 1.0,
    "zlib": 1.0, "cc-by": 0.9, "cc-by-nc": 0.1, "cc-by-sa": 0.5, "mpl": 0.6, "epl": 0.6, "lgpl": 0.5, "gpl": 0.3,
    "agpl": 0.2, "proprietary": 0.0, "none": 0.0,
}
TAG = b"spdx-license-identifier:"
TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+:-]+")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def freedom(label: str) -> float:
    return FREEDOM[max(fits, key=len)] if (fits := [k for k in FREEDOM if label.startswith(k)]) else 0.5


def postfix(expression: str) -> list[str] | None:
    """Shunting-yard: the expression in postfix order, lower-cased; None if its parentheses don't balance."""
    out: list[str] = []
    stack: list[str] = []
    for token in (t.lower() for t in TOKEN.findall(expression)):
        if token == "(":
            stack.append(token)
        elif token == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif token in PRECEDENCE:
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[token]:
                out.append(stack.pop())
            stack.append(token)
        else:
            out.append(token)
    while stack:
        if stack[-1] == "(":
            return None
        out.append(stack.pop())
    return out


def expression_at(text: str, first: int, end: int) -> str:
    """The tokens from ``first`` on that can belong to one expression: it ends where prose follows a name."""
    tokens, named = [], False
    for token in (m[0] for m in TOKEN.finditer(text, first, end)):
        name = token not in "()" and token.lower() not in PRECEDENCE
        if named and (name or token == "("):
            break
        tokens.append(token)
        named = name or token == ")"
    return " ".join(tokens)


def evaluate(expression: str) -> tuple[set[str], float]:
    """Labels and freedom of a licence expression."""
    names = {t.lower() for t in TOKEN.findall(expression) if t not in "()" and t.lower() not in PRECEDENCE}
    order, held = postfix(expression), []
    for token in order or ():
        if token not in PRECEDENCE:
            held.append(freedom(token))
        elif len(held) < 2:
            return names, 0.5
        else:
            right, left = held.pop(), held.pop()
            held.append((left + 1) / 2 if token == "with" else min(left, right) if token == "and" else max(left, right))
    return names, held[0] if len(held) == 1 else 0.5


def automaton(phrases) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in phrases:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, notices (phrase or expression)."""

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        phrases, tags = automaton([*BASE, *MORE]), ahocorasick.Automaton()
        tags.add_word(TAG.decode(), 1)
        tags.make_automaton()
        out: dict[str, list] = {n: [] for n in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "notices")}
        for data in utf8(batch.column("text")):
            words = folded_words(data)
            line = f" {b' '.join(words).decode()} "
            base, labels, notices, scores, places = set(), set(), set(), [], []
            at = before = 0  # blanks of the line before ``at``
            for end, phrase in phrases.iter(line):
                notices.add(phrase)
                before, at = before + line.count(" ", at, end), end
                if phrase in BASE:
                    places.append(before - phrase.count(" ") - 1)
                    base.add(BASE[phrase])
                label = BASE.get(phrase) or MORE[phrase]
                labels.add(label)
                scores.append(freedom(label))
            lower, line_end = data.lower().decode() if data else "", 0  # bytes.lower() changes A-Z only
            for end, _ in tags.iter(lower):
                line_end = lower.find("\n", end + 1) if end + 1 > line_end else line_end
                line_end = len(lower) if line_end < 0 else line_end
                expression = expression_at(lower, end + 1, line_end)
                names, score = evaluate(expression)
                if names:
                    notices.add(expression)
                    labels |= names
                    scores.append(score)
            for name, value in zip(out, (
                len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
                ",".join(sorted(labels)), float(min(scores, default=0.0)), sorted(notices)), strict=True):
                out[name].append(value)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.string())]
        return {n: pa.array(v, k) for (n, v), k in zip(out.items(), kinds, strict=True)}

    fields = [(n, T.LongType()) for n in ("n_words", "n_base", "first_word", "last_word")]
    fields += [("base_labels", T.StringType()), ("labels", T.StringType()), ("score", T.DoubleType()), ("notices", T.ArrayType(T.StringType()))]
    return map_rows(docs.select("doc_id", "text"), work, fields, ["doc_id"])


def op10_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("notices")
