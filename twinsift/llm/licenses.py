"""Licence scans: phrases and identifier tags by Aho-Corasick, expressions by shunting-yard.

A text is lower-cased in A-Z and cut into words of letters, digits and all that is not
ASCII.  One automaton over the words, joined by single spaces, finds every place of every
phrase at once.  Where it finds the words of an identifier tag, written with hyphens and a
colon, the expression behind the colon is read to the end of its line, parsed by operator
precedence (with, and, or) and evaluated: which licences it names, and which of them no choice
that satisfies it can do without.  A licence of an alternative is weaker evidence than a required
one; each label counts once, with its strongest evidence.

Null texts are read as empty: no words, no places, no labels, score 0.  An empty table gives an
empty result.  Very long texts are scanned whole.  Repeated rows are scanned each for itself.
Columns other than id and text are left out, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import blocks

#: The phrases whose places are counted, with their labels.
BASE_PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
#: Notice phrases that add labels without being counted.
NOTICE_PHRASES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "www apache org licenses license 2 0": "apache-2.0",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "isc license": "isc",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by 4 0": "cc-by",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "released into the public domain": "public-domain",
    "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
#: How sure each kind of evidence makes of its label.
REQUIRED_WEIGHT, CHOICE_WEIGHT, BASE_WEIGHT, NOTICE_WEIGHT = 0.9, 0.6, 0.7, 0.6

_SEPARATORS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 32
    for c in range(256)
)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_TAGGED = re.compile(rb"(?i)spdx-license-identifier:([^\r\n]*)")
_TOKEN = re.compile(r"[()]|[a-z0-9.+:-]+")
_BINDS = {"or": 1, "and": 2, "with": 3}


@lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    kinds = [(BASE_PHRASES, "base"), (NOTICE_PHRASES, "notice"), ({TAG: ""}, "tag")]
    for phrases, kind in kinds:
        for phrase, label in phrases.items():
            found.add_word(f" {phrase} ", (kind, label, len(phrase) + 2))
    found.make_automaton()
    return found


def parse(expression: str) -> list[str] | None:
    """An expression in postfix order by shunting-yard; None if it is not well formed."""
    output: list[str] = []
    waiting: list[str] = []
    wants_name, behind = True, ""
    for token in _TOKEN.findall(expression.lower()):
        if token == "(":
            if not wants_name or waiting[-1:] == ["with"]:
                return None
            waiting.append(token)
        elif token == ")":
            if wants_name:
                return None
            while waiting and waiting[-1] != "(":
                output.append(waiting.pop())
            if not waiting:
                return None
            waiting.pop()
        elif token in _BINDS:
            # an exception belongs to one licence, to no group of them and no other exception
            if wants_name or (token == "with" and (output[-1] in _BINDS or behind == ")" or "with" in waiting[-1:])):
                return None
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[token]:
                output.append(waiting.pop())
            waiting.append(token)
            wants_name = True
        else:
            if not wants_name:
                break  # a comment's words after the expression
            output.append(token)
            wants_name = False
        behind = token
    if wants_name or "(" in waiting:
        return None
    return output + waiting[::-1]


def evaluate(postfix: list[str]) -> tuple[set[str], set[str]]:
    """(named, required): all licences with their exceptions, and those that every choice holds.

    ``and`` requires what either side requires, ``or`` what both do.
    """
    stack: list[tuple[set[str], set[str]]] = []
    for token in postfix:
        if token not in _BINDS:
            stack.append(({token}, {token}))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            both = f"{min(left[0])} with {min(right[0])}"
            stack.append(({both}, {both}))
        else:
            stack.append((_united(left[0], right[0]), _united(left[1], right[1]) if token == "and" else left[1] & right[1]))
    return stack[0]


def _united(a: set[str], b: set[str]) -> set[str]:
    """The smaller one goes into the larger, so that long expressions cost no more than their length."""
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    a |= b
    return a


def satisfied(postfix: list[str], held: set[str]) -> bool:
    """Whether somebody who holds these licences (with their exceptions) satisfies an expression."""
    stack: list[bool | str] = []
    told = lambda x: x in held if isinstance(x, str) else x
    for token in postfix:
        if token not in _BINDS:
            stack.append(token)
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            stack.append(f"{left} with {right}")
        else:
            stack.append(told(left) and told(right) if token == "and" else told(left) or told(right))
    return told(stack[0])


def scan_text(text: str | None) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, required)."""
    raw = (text or "").encode()
    words = raw.translate(_SEPARATORS).split()
    joined = " " + b" ".join(words).decode("latin-1") + " "
    starts, base, tags, sure = [], set(), [], {}
    for end, (kind, label, size) in automaton().iter(joined):
        if kind == "tag":
            tags.append(end - size + 1)
        elif kind == "base":
            starts.append(end - size + 1)
            base.add(label)
        else:
            sure[label] = NOTICE_WEIGHT
    sure |= {x: BASE_WEIGHT for x in base}
    places: list[int] = []
    if starts:  # from characters to words: only the first and the last are asked for
        places = [joined.count(" ", 0, at) for at in (min(starts), max(starts))]
    expressions, required = [], set()
    for line in _behind_tags(raw, joined, tags):
        postfix = parse(line)
        if postfix:
            expressions.append(" ".join(postfix))
            named, needed = evaluate(postfix)
            required |= needed
            for x in named:
                sure[x] = max(sure.get(x, 0.0), REQUIRED_WEIGHT if x in needed else CHOICE_WEIGHT)
    doubt = 1.0
    for x in sorted(sure):
        doubt *= 1 - sure[x]
    return (
        len(words),
        len(starts),
        places[0] if places else None,
        places[1] if places else None,
        ",".join(sorted(base)),
        ",".join(sorted(sure)),
        1 - doubt if sure else 0.0,
        expressions,
        ",".join(sorted(required)),
    )


def _behind_tags(raw: bytes, joined: str, tags: list[int]) -> Iterator[str]:
    """The rest of its line behind each tag; ``tags`` are places among the joined words."""
    word = at = seen = 0
    found = _WORD.finditer(raw) if tags else iter(())
    for tag in tags:
        word += joined.count(" ", at, tag)
        at = tag
        while seen <= word:
            place = next(found)
            seen += 1
        if (line := _TAGGED.match(raw, place.start())) is not None:
            yield line[1].decode("utf-8", "replace").replace("*/", " ").replace("-->", " ")


SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, "
    "labels string, score double, expressions array<string>, required string"
)
_TYPES = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.string()), pa.string()]


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row its id and what ``scan_text`` finds; ``expressions`` are in postfix order."""
    kind = df.schema[id_col].dataType.simpleString()
    columns = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            rows = list(zip(*map(scan_text, batch.column(1).to_pylist())))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(list(x), t) for x, t in zip(rows, _TYPES)]],
                [id_col, *columns],
            )

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}")
