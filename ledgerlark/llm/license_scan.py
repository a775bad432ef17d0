"""License scan: Aho-Corasick over normalised words, and licence expressions by shunting-yard.

One automaton holds the notice phrases and the words of identifier tags. Texts are normalised to
lower-cased words parted by single blanks, so a phrase occurs where its words stand consecutively.
Where the words of a tag occur, a second automaton finds the places of all tags in the raw text, and
what stands after each is read as a licence expression: tokens go through a shunting-yard parser
(``WITH`` binds tighter than ``AND``, ``AND`` than ``OR``) as far as they make one, and the postfix
form is evaluated to the licences it names and to how freely the text may be used (``OR``: the freest
choice, ``AND``: the strictest part, ``WITH``: halfway between licence and 1).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm.common import LOWER, bound_batches, documents_of, raw_texts, words_of

#: Phrases whose places are counted, and the labels they give.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Further notices that give labels.
NOTICE_PHRASES = {
    "permission is hereby granted free of charge": "mit",
    "apache license 2": "apache-2",
    "licensed under apache 2": "apache-2",
    "gnu general public license version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl-3",
    "mozilla public license version 2": "mpl-2",
    "redistribution and use in source and binary forms": "bsd",
    "under the bsd license": "bsd",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "creative commons attribution noncommercial": "cc-by-nc",
    "cc0": "cc0",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution 4": "cc-by",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "free and unencumbered software released into the public domain": "unlicense",
    "boost software license version 1": "bsl-1",
    "eclipse public license": "epl",
    "under the zlib license": "zlib",
    "all rights reserved": "proprietary",
}
#: How freely text under a label may be used, from 0 (not at all) to 1.
FREEDOM = {
    "cc0": 1.0,
    "mit": 1.0,
    "bsd": 1.0,
    "isc": 1.0,
    "unlicense": 1.0,
    "zlib": 1.0,
    "bsl-1": 1.0,
    "apache-2": 0.95,
    "cc-by": 0.9,
    "mpl-2": 0.7,
    "cc-by-sa": 0.6,
    "epl": 0.6,
    "lgpl": 0.5,
    "gpl-2": 0.3,
    "gpl-3": 0.3,
    "agpl-3": 0.2,
    "cc-by-nc": 0.2,
    "cc-by-nd": 0.2,
    "proprietary": 0.0,
}
OTHER_FREEDOM = 0.4
#: Identifier, without a trailing version of up to three numbers, to label.
_LABEL_RULES = (
    (r"mit(-0)?", "mit"),
    (r"apache-2(\.0)?", "apache-2"),
    (r"(0|1|2|3)?-?bsd.*", "bsd"),
    (r"agpl-3.*", "agpl-3"),
    (r"lgpl-.*", "lgpl"),
    (r"gpl-2.*", "gpl-2"),
    (r"gpl-3.*", "gpl-3"),
    (r"mpl-2.*", "mpl-2"),
    (r"cc0.*", "cc0"),
    (r"cc-by-nc.*", "cc-by-nc"),
    (r"cc-by-nd.*", "cc-by-nd"),
    (r"cc-by-sa.*", "cc-by-sa"),
    (r"cc-by(-[0-9.]+)?", "cc-by"),
    (r"isc", "isc"),
    (r"unlicense", "unlicense"),
    (r"zlib", "zlib"),
    (r"bsl-1.*", "bsl-1"),
    (r"epl-.*", "epl"),
)
_TAG_WORDS = "spdx license identifier"
#: A tag in the raw text, in any case of letters; a colon follows.
_TAG = b"spdx-license-identifier"
_COLON = re.compile(r"\s*:")
_TOKEN = re.compile(r"[ \t]*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
_PRECEDENCE = {"OR": 1, "AND": 2, "WITH": 3}
#: What may stand behind an operator: a licence of a known family, one with a version or an ending of
#: identifiers, a reference, or an exception. Any other word goes on with the sentence.
_OPERAND = re.compile(r"(?:licenseref-|documentref-).+|[a-z0-9.+]+(?:-[a-z0-9.+]+)*-(?:[0-9][a-z0-9.+]*|only|or-later|exception)(?:-[a-z0-9.+]+)*", re.IGNORECASE)


def label_of(identifier: str) -> str:
    """Label of a licence identifier; one of no known family is its own, in lower case."""
    low = identifier.lower().rstrip("+")
    return next((label for rule, label in _LABEL_RULES if re.fullmatch(rule, low)), low)


def operand(token: str) -> bool:
    """Whether a token behind an operator is an identifier, not a word of the sentence."""
    bare = token.rstrip(".:-")
    return label_of(bare) in FREEDOM or _OPERAND.fullmatch(bare) is not None


def postfix(text: str, at: int = 0) -> list[str] | None:
    """The longest licence expression that begins at a place of ``text``, in postfix order; None if there is
    none.

    Operators are written in one case. An expression ends before a token out of place, before an operator
    that no identifier follows, and before a bracket that is not closed."""
    out: list[str] = []
    stack: list[str] = []
    depth, operand_next = 0, True
    whole: tuple[int, list[str]] | None = None
    while m := _TOKEN.match(text, at):
        token = m[1]
        word = token.upper() if token in (token.upper(), token.lower()) else token
        if token == "(":
            if not operand_next:
                break
            stack.append(token)
            depth += 1
        elif token == ")":
            if operand_next or not depth:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            depth -= 1
        elif word in _PRECEDENCE:
            if operand_next:
                break
            while stack and stack[-1] != "(" and _PRECEDENCE[stack[-1]] >= _PRECEDENCE[word]:
                out.append(stack.pop())
            stack.append(word)
            operand_next = True
        else:
            if not operand_next or stack and stack[-1] in _PRECEDENCE and not operand(token):
                break
            out.append(token.rstrip(".:-"))
            operand_next = False
        if not depth and not operand_next:
            # What is out stays as it is; what is stacked here are a few operators.
            whole = len(out), stack[:]
        at = m.end()
    return None if whole is None else out[: whole[0]] + whole[1][::-1]


def evaluate(tokens: list[str]) -> tuple[set[str], float]:
    """Labels that a postfix expression names (exceptions are none), and its freedom."""
    stack: list[tuple[set[str], float]] = []
    for token in tokens:
        if token not in _PRECEDENCE:
            label = label_of(token)
            stack.append(({label}, FREEDOM.get(label, OTHER_FREEDOM)))
            continue
        (right, free_right), (left, free_left) = stack.pop(), stack.pop()
        if token == "WITH":
            stack.append((left, (free_left + 1) / 2))
        else:
            stack.append((left | right, (min if token == "AND" else max)(free_left, free_right)))
    return stack[0]


@dataclass
class Found:
    n_words: int = 0
    places: list[int] = field(default_factory=list)
    base_labels: set[str] = field(default_factory=set)
    labels: set[str] = field(default_factory=set)
    expressions: list[str] = field(default_factory=list)
    score: float = 0.0


@cache
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrases, kind in ((NOTICE_PHRASES, "notice"), (BASE_PHRASES, "base"), ({_TAG_WORDS: ""}, "tag")):
        for phrase, label in phrases.items():
            found.add_word(f" {phrase} ", (kind, label, len(phrase) + 1))
    found.make_automaton()
    return found


@cache
def tags() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word(_TAG.decode(), len(_TAG))
    found.make_automaton()
    return found


def tag_ends(text: str) -> Iterator[int]:
    """Where the expression of each tag begins, behind its colon."""
    for end, _ in tags().iter(text.encode(errors="replace").translate(LOWER).decode(errors="replace")):
        if m := _COLON.match(text, end + 1):
            yield m.end()


def scan(raw: bytes | None) -> Found:
    """What one text holds. Null and empty texts hold nothing and score 0."""
    words = words_of(raw)
    out = Found(n_words=len(words))
    if not words:
        return out
    line = b" ".join((b"", *words, b"")).decode(errors="replace")
    frees: list[float] = []
    counted, before, tagged = 0, 0, False
    for end, (kind, label, length) in automaton().iter(line):
        if kind == "tag":
            tagged = True
            continue
        out.labels.add(label)
        frees.append(FREEDOM[label])
        if kind == "base":
            # Ends never fall, and phrases are short: blanks are counted from the last place on.
            start = end - length
            before += line.count(" ", counted, start) if start >= counted else -line.count(" ", start, counted)
            counted = start
            out.places.append(before)
            out.base_labels.add(label)
    if tagged:
        text = raw.decode(errors="replace")
        for at in tag_ends(text):
            if tokens := postfix(text, at):
                labels, free = evaluate(tokens)
                out.labels |= labels
                out.expressions.append(" ".join(tokens))
                frees.append(free)
    out.score = min(frees, default=0.0)
    return out


_TYPE = "struct<n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base_labels:string,labels:string,expressions:array<string>,score:double>"
_ARROW = pa.struct(
    [(n, pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")]
    + [("base_labels", pa.string()), ("labels", pa.string()), ("expressions", pa.list_(pa.string())), ("score", pa.float64())]
)


def _licences(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        out = []
        for x in map(scan, raw_texts(batch)):
            out.append(
                {
                    "n_words": x.n_words,
                    "n_base": len(x.places),
                    "first_word": min(x.places, default=None),
                    "last_word": max(x.places, default=None),
                    "base_labels": ",".join(sorted(x.base_labels)),
                    "labels": ",".join(sorted(x.labels)),
                    "expressions": x.expressions,
                    "score": x.score,
                }
            )
        yield pa.array(out, _ARROW)


def find_licences(documents: DataFrame, *, text: str = "text") -> DataFrame:
    """Add ``licences`` to every row: counts and places of base phrases, labels, tag expressions in
    postfix order and a score, the freedom of the strictest notice or tag (0 where there is none).
    Null and empty texts hold nothing; repeated rows are read one by one; other columns stay, but a
    column ``licences`` is replaced. An empty table stays empty."""
    bound_batches(documents)
    return documents.withColumn("licences", F.arrow_udf(_licences, _TYPE)(F.col(text)))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_licences(documents_of(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", *[F.col(f"licences.{c}").alias(c) for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")])
