"""License scans: one Aho-Corasick pass finds identifier tags and notice phrases; a shunting-yard parser reads the
licence expression that follows a tag.

A text's words are runs of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased. The automaton runs
over the words, with one space between them, so a phrase is found where its words stand one after another, whatever
stands between them. An expression is read from the text itself, from the tag to the end of its line: operands are
licence identifiers, operators are ``and``, ``or`` and ``with`` (in this order of falling room: with, and, or), brackets
group. The longest well-formed beginning counts. It is evaluated to a permission from 0 to 1: of alternatives the freest
counts, of joined parts the strictest, an exception adds to its licence.

Columns: n_words; n_base, first_word and last_word (places of the base phrases, words from 0); base_labels; labels;
score (how sure it is that the text states a licence: 1 minus the product of the doubts left by each kind of evidence
and label); permission (of all licences found, the strictest; null without any); findings (kind, label, word, and
the byte range in the text's UTF-8).

Edge cases: null text is empty; a text without words has none and score 0; repeated rows give a row each; an empty table
gives an empty result; extra columns are ignored; null ids are carried through. A text is read whole, however long:
memory is some ten times a single longest text. Nothing is shuffled.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, sliced, text_bytes

#: Words of a phrase and its label. Fixed values.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Sentences that licences are known by, beyond their names.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "boost",
    "isc license": "isc",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "released into the public domain": "public-domain",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution share alike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons zero": "cc0",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0 1 0": "cc0",
    "all rights reserved": "reserved",
}

#: Tags that an expression follows; after the exact one, identifiers that aren't known count too.
TAGS = {"spdx license identifier": True, "license expression": True, "license": False, "licence": False, "licensed under": False}

#: How free a licence leaves its user. An identifier belongs to the longest name that begins it.
PERMISSION = {
    "0bsd": 1.0, "afl": 0.9, "agpl": 0.2, "apache": 0.9, "artistic": 0.7, "boost": 1.0, "bsd": 0.9, "bsl": 1.0, "cc-by": 0.8, "cc-by-nc": 0.1,
    "cc-by-nc-nd": 0.05, "cc-by-nc-sa": 0.1, "cc-by-nd": 0.1, "cc-by-sa": 0.4, "cc0": 1.0, "epl": 0.5, "gfdl": 0.3, "gpl": 0.3, "isc": 0.9,
    "lgpl": 0.5, "mit": 0.9, "mpl": 0.6, "ofl": 0.7, "postgresql": 0.9, "psf": 0.9, "public-domain": 1.0, "python": 0.9, "reserved": 0.0,
    "unlicense": 1.0, "upl": 0.9, "wtfpl": 1.0, "zlib": 0.9,
}
OTHER, OTHER_PERMISSION, EXCEPTION = "other", 0.1, 0.3

#: How much doubt a kind of evidence removes.
EVIDENCE = {"expression": 0.95, "phrase": 0.8, "notice": 0.7}

BINDS = {"or": 1, "and": 2, "with": 3}

_WORD_TABLE = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i > 127 else 32 for i in range(256))
_AFTER_TAG = re.compile(rb"[\"']?[ \t]*[:=][ \t]*[\"']?")
_TOKEN = re.compile(rb"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.+\-]*)")

SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
          "permission double, findings array<struct<kind:string,label:string,word:long,begin:long,end:long>>")


def _well_formed(tokens: list[str]) -> int:
    """How many of the tokens the longest well-formed beginning has."""
    depth, want, length = 0, True, 0
    for k, token in enumerate(tokens):
        if want:
            if token == "(":
                depth += 1
            elif token == ")" or token in BINDS:
                break
            else:
                want = False
        elif token == ")":
            if depth == 0:
                break
            depth -= 1
        elif token in BINDS:
            want = True
        else:
            break
        if not want and depth == 0:
            length = k + 1
    return length


def postfix(tokens: list[str]) -> list[str]:
    """The longest well-formed beginning of an expression in postfix order; empty if there is none."""
    out, waiting = [], []
    for token in tokens[: _well_formed(tokens)]:
        if token == "(":
            waiting.append(token)
        elif token == ")":
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
        elif token in BINDS:
            while waiting and waiting[-1] != "(" and BINDS[waiting[-1]] >= BINDS[token]:
                out.append(waiting.pop())
            waiting.append(token)
        else:
            out.append(token)
    return out + waiting[::-1]


def label_of(identifier: str) -> str | None:
    """The known licence that an identifier names, without its version."""
    for end in range(min(len(identifier), max(map(len, PERMISSION))), 0, -1):
        if identifier[:end] in PERMISSION and (end == len(identifier) or identifier[end] in "-.+v0123456789"):
            return identifier[:end]
    return None


def evaluate(order: list[str]) -> tuple[set[str], float] | None:
    """Labels and permission of an expression in postfix order; None where ``with`` follows anything but a licence."""
    labels, stack = set(), []
    for token in order:
        if token not in BINDS:
            label = label_of(token)
            stack.append((token, label or OTHER, PERMISSION.get(label, OTHER_PERMISSION)))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            if left[0] is None or right[0] is None:
                return None
            labels.add(left[1])
            stack.append((None, None, min(1.0, left[2] + EXCEPTION)))
        else:
            labels |= {x[1] for x in (left, right) if x[0] is not None}
            stack.append((None, None, (max if token == "or" else min)(left[2], right[2])))
    if not stack:
        return None
    if stack[0][0] is not None:
        labels.add(stack[0][1])
    return labels, stack[0][2]


def expression_after(text: bytes, at: int, exact: bool) -> tuple[set[str], float, int] | None:
    """Labels, permission and end of the expression that a tag ending at this byte brings, if it brings one."""
    begin = _AFTER_TAG.match(text, at)
    if begin is None:
        return None
    tokens, ends, at = [], [], begin.end()
    while (m := _TOKEN.match(text, at)) is not None:
        tokens.append(m.group(1).decode("ascii").lower())
        at = m.end()
        ends.append(at)
    n = _well_formed(tokens)
    found = evaluate(postfix(tokens))
    if found is None or (OTHER in found[0] and not exact):
        return None
    return *found, ends[n - 1]


def automaton(phrases: dict[str, str] = BASE, notices: dict[str, str] = NOTICES, tags: dict[str, bool] = TAGS) -> ahocorasick.Automaton:
    """One automaton for all of them, over bytes that are read as Latin-1."""
    out: dict[str, list] = {}
    for kind, table in (("phrase", phrases), ("notice", notices), ("tag", tags)):
        for words, value in table.items():
            key = " " + " ".join(words.encode().translate(_WORD_TABLE).decode("latin-1").split(" ")) + " "
            out.setdefault(key, []).append((kind, value))
    made = ahocorasick.Automaton()
    for key, values in out.items():
        made.add_word(key, (len(key), len(key.split()), values))
    made.make_automaton()
    return made


class Words:
    """The words of some texts, one space between them, a newline before each text."""

    def __init__(self, texts: list[bytes]):
        raw = b"".join(x for t in texts for x in (b"\n ", t, b" "))
        self.edges = np.cumsum([0] + [len(t) + 3 for t in texts])
        wide = np.frombuffer(raw.translate(_WORD_TABLE), dtype=np.uint8).copy()
        wide[self.edges[:-1]] = 10
        gap = wide <= 32
        self.begins = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
        self.ends = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
        keep = np.concatenate(([True], (wide[1:] != 32) | (wide[:-1] != 32))) if len(wide) else np.zeros(0, dtype=bool)
        narrow = wide[keep]
        self.text = narrow.tobytes().decode("latin-1")
        self.starts = np.flatnonzero((narrow[:-1] <= 32) & (narrow[1:] > 32)) + 1
        self.first = np.searchsorted(self.begins, self.edges)

    def found(self, machine: ahocorasick.Automaton):
        """text, word in it, byte range in it, values - for each place of each phrase."""
        for end, (size, n, values) in machine.iter(self.text):
            word = int(np.searchsorted(self.starts, end - size + 2))
            text = int(np.searchsorted(self.first, word, side="right")) - 1
            base = int(self.edges[text]) + 2
            yield text, word - int(self.first[text]), int(self.begins[word]) - base, int(self.ends[word + n - 1]) - base, values


def _rows(texts: list[bytes], machine: ahocorasick.Automaton) -> list[tuple]:
    words = Words(texts)
    findings: dict[int, list] = {}
    strictest: dict[int, float] = {}
    for text, word, begin, end, values in words.found(machine):
        for kind, value in values:
            if kind != "tag":
                hits, permission = [(kind, value, word, begin, end)], PERMISSION[value] if value in PERMISSION else OTHER_PERMISSION
            else:
                brought = expression_after(texts[text], end, value)
                if brought is None:
                    continue
                hits, permission = [("expression", x, word, begin, brought[2]) for x in sorted(brought[0])], brought[1]
            findings.setdefault(text, []).extend(hits)
            strictest[text] = min(strictest.get(text, 1.0), permission)
    out = []
    for text, n in enumerate(np.diff(words.first).tolist()):
        hits = findings.get(text, [])
        base = [h for h in hits if h[0] == "phrase"]
        doubt = 1.0
        for kind, _ in sorted({h[:2] for h in hits}):
            doubt *= 1 - EVIDENCE[kind]
        out.append((n, len(base), min((h[2] for h in base), default=None), max((h[2] for h in base), default=None), ",".join(sorted({h[1] for h in base})),
                    ",".join(sorted({h[1] for h in hits})), 1 - doubt, strictest.get(text), [dict(zip(("kind", "label", "word", "begin", "end"), h)) for h in hits]))
    return out


_FINDING = pa.list_(pa.struct([("kind", pa.string()), ("label", pa.string()), ("word", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())]))
_TYPES = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()] * 2 + [_FINDING]
_NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "permission", "findings"]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = BASE, notices: dict[str, str] = NOTICES,
         tags: dict[str, bool] = TAGS) -> DataFrame:
    """A row for each row of docs. Labels hold no comma, phrases are words in lower case."""

    def run(tables):
        machine = automaton(phrases, notices, tags)
        for t in sliced(tables, 1):
            buf, edges = text_bytes(t.column(1))
            raw = buf.tobytes()
            rows = _rows([raw[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())], machine)
            yield pa.record_batch([t.column(0), *(pa.array(c, kind) for c, kind in zip(zip(*rows), _TYPES))] if rows else
                                  [t.column(0), *(pa.array([], kind) for kind in _TYPES)], _NAMES)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), SCHEMA)
