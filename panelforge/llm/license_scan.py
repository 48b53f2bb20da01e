"""License scan: an Aho-Corasick automaton finds notice phrases and identifier tags; a shunting-yard parser evaluates the
identifier expressions.

Words are runs of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased. A phrase is found where its words
stand one after the other. ``SPDX-License-Identifier:`` tags are found as the phrase ``spdx license identifier``; what
follows on the tag's line is parsed as an expression of AND, OR, WITH and parentheses.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

#: The base phrases and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further notices and their labels.
NOTICE_PHRASES = {
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "creative commons": "cc",
    "licensed under cc by": "cc",
    "cc by nc": "cc-nc",
    "cc by sa": "cc-sa",
    "cc0 1 0 universal": "cc0",
    "eclipse public license": "epl",
    "isc license": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
#: Identifier families whose terms let a text be reused without passing the same terms on.
PERMISSIVE = re.compile(r"(mit|apache|bsd|isc|zlib|unlicense|cc0|cc-by-\d|0bsd|python|postgresql)", re.I)

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_TAG_LINE = re.compile(r"SPDX[^0-9A-Za-z\n\x80-\U0010ffff]+License[^0-9A-Za-z\n\x80-\U0010ffff]+Identifier[ \t]*:[ \t]*([^\n\r]*)", re.I)
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+:\-]+")
_BINDS = {"or": 1, "and": 2, "with": 3}

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType())]
    + [T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType())]
    + [T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType())]
    + [T.StructField("permissive", T.BooleanType()), T.StructField("n_tags", T.LongType()), T.StructField("n_bad_tags", T.LongType())]
)


@dataclass(frozen=True)
class Verdict:
    """What an expression says: the identifiers that it names, and whether permissive terms can be chosen."""

    labels: frozenset[str]
    permissive: bool


def parse_expression(text: str) -> list[str]:
    """Reverse Polish form of an identifier expression by the shunting-yard method; ValueError if it isn't one.

    WITH binds tighter than AND, and AND tighter than OR; all three group to the left. What stands after the expression,
    such as a comment's end, is left out. If that is prose, operators are those in capitals only: the ``and`` in "MIT and
    more text" belongs to the prose.
    """
    tokens = _TOKEN.findall(text)
    out, rest = _postfix(tokens, str.lower)
    return out if not rest else _postfix(tokens, lambda x: x.lower() if x.isupper() else "")[0]


def _postfix(tokens: list[str], operator) -> tuple[list[str], bool]:
    """The expression that the tokens begin with, and whether others follow; ``operator`` names an operator in lower case."""
    out: list[str] = []
    held: list[str] = []
    operand_next, rest, text = True, False, " ".join(tokens)
    for token in tokens:
        word = operator(token)
        if word in _BINDS:
            if operand_next:
                raise ValueError(f"operator without a left side: {text!r}")
            while held and held[-1] != "(" and _BINDS[held[-1]] >= _BINDS[word]:
                out.append(held.pop())
            held.append(word)
            operand_next = True
        elif token == "(":
            if not operand_next:
                raise ValueError(f"parenthesis after an identifier: {text!r}")
            held.append(token)
        elif token == ")":
            if operand_next:
                raise ValueError(f"empty parentheses: {text!r}")
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                raise ValueError(f"unbalanced: {text!r}")
            held.pop()
        elif operand_next:
            out.append(token)
            operand_next = False
        else:
            rest = True
            break
    if operand_next or "(" in held:
        raise ValueError(f"incomplete: {text!r}")
    return out + held[::-1], rest


def evaluate(postfix: list[str]) -> Verdict:
    """AND needs both sides to be permissive, OR one of them; an exception after WITH leaves its licence's verdict and label."""
    stack: list[Verdict] = []
    for token in postfix:
        if token in _BINDS:
            right, left = stack.pop(), stack.pop()
            good = {"or": left.permissive or right.permissive, "and": left.permissive and right.permissive, "with": left.permissive}[token]
            stack.append(Verdict(left.labels if token == "with" else left.labels | right.labels, good))
        else:
            stack.append(Verdict(frozenset({token.lower()}), bool(PERMISSIVE.match(token))))
    return stack[0]


def automaton(phrases: dict[str, str]):
    """Finds each phrase, in words joined and surrounded by single blanks (UTF-8 bytes as Latin-1 characters)."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase in phrases:
        found.add_word(f" {phrase} ".encode().decode("latin-1"), phrase)
    found.make_automaton()
    return found


def scan_text(text: str, machine) -> tuple:
    """One text's row without its id. ``machine``: the automaton of all phrases and the tag."""
    words = text.encode("utf-8", "surrogatepass").translate(_TABLE).split()
    joined = f" {b' '.join(words).decode('latin-1')} "
    starts, base, labels, evidence, tagged = [], set(), set(), 0, False
    for end, phrase in machine.iter(joined):
        if phrase == TAG:
            tagged = True
            continue
        evidence += 1
        if phrase in BASE_PHRASES:
            starts.append(end - len(phrase) - 1)
            base.add(BASE_PHRASES[phrase])
        else:
            labels.add(NOTICE_PHRASES[phrase])
    tags, bad, permissive = 0, 0, None
    for line in _TAG_LINE.findall(text) if tagged else ():
        tags += 1
        try:
            verdict = evaluate(parse_expression(line))
        except ValueError:
            bad += 1
            continue
        evidence += 1
        labels |= {f"spdx:{x}" for x in verdict.labels}
        permissive = verdict.permissive if permissive is None else permissive and verdict.permissive
    score = 1.0 - 0.5**evidence
    first = last = None
    if starts:
        blanks = np.flatnonzero(np.frombuffer(joined.encode("latin-1"), np.uint8) == 32)
        first, last = np.searchsorted(blanks, [min(starts), max(starts)]).tolist()
    return len(words), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(base | labels)), score, permissive, tags, bad


def scan_licenses(docs: DataFrame) -> DataFrame:
    """A row for each document: words, base places (count, first and last start), labels, score, tags and their verdict.

    Null and empty texts have no words, no labels and score 0; whole texts of any length are scanned; repeated rows give
    repeated rows; only ``doc_id`` and ``text`` are read. ``score`` is 1 - 0.5 ** (notices and valid tags). ``permissive``
    is null without a valid tag, else whether every tag lets permissive terms be chosen. A tag that isn't an expression
    counts in ``n_bad_tags`` and changes nothing else.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(BASE_PHRASES | NOTICE_PHRASES | {TAG: TAG})
        for batch in (x for b in batches for x in common.slices(b)):
            rows = [scan_text(x, machine) for x in batch.column(1).to_pylist()]
            columns = zip(*rows, strict=True) if rows else [[]] * (len(SCHEMA) - 1)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.bool_(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], SCHEMA.names)

    return common.id_and_text(docs).mapInArrow(common.lean(run), SCHEMA)
