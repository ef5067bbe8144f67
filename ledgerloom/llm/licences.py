"""Licence scan: an Aho-Corasick automaton finds identifier tags and notice phrases in the words of a text, and a
shunting-yard parser evaluates the and/or/with expressions behind identifier tags.

A text is lower-cased (A-Z only) and its words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ are joined by single spaces, so a phrase
matches across any punctuation or line break. Every licence has a permissiveness from 0 (all rights reserved) to 1
(public domain). A name is a family, perhaps a version (with or without v, behind a dash or not), and perhaps a + or
-or-later, which allow later versions of the same family. In an expression `or` takes the greater, `and` the smaller, and
`with` lets a known exception raise the licence before it by a share of its distance to 1; an unknown exception changes
nothing. The score of a text is the smallest value it holds, 1.0 where it holds none.

Defined cases: a null or empty text has no words, no labels and the score 1.0; an expression that cannot be parsed
counts as its known names joined by `and`; unknown names get 0.5 and no label; repeated rows and ids are each judged;
other columns of the input are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame

from ledgerloom.llm.common import bounded_batches, per_text

# The base phrases and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Further notice phrases and the labels they give.
NOTICE_PHRASES = {
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "apache license": "apache",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "eclipse public license": "epl",
    "isc license": "isc",
    "the unlicense": "unlicense",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "cc0": "cc0",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "public domain": "public-domain",
    "artistic license": "artistic",
    "boost software license": "boost",
    "zlib license": "zlib",
    "postgresql license": "postgresql",
    "python software foundation license": "psf",
    "sil open font license": "ofl",
    "common development and distribution license": "cddl",
    "european union public licence": "eupl",
    "do what the fuck you want to public license": "wtfpl",
    "server side public license": "sspl",
    "business source license": "busl",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
}
TAG = "spdx license identifier"
# How permissive each label is.
PERMISSIVE = {
    "public-domain": 1.0, "cc0": 1.0, "unlicense": 1.0, "mit": 0.9, "isc": 0.9, "bsd": 0.9, "apache": 0.85, "cc-by": 0.8, "cc-by-sa": 0.5,
    "mpl": 0.6, "epl": 0.6, "lgpl": 0.5, "gpl": 0.3, "agpl": 0.2, "cc-by-nd": 0.2, "cc-by-nc": 0.1, "reserved": 0.0,
    "boost": 0.95, "zlib": 0.95, "postgresql": 0.9, "psf": 0.9, "wtfpl": 1.0, "artistic": 0.7, "ofl": 0.7, "cddl": 0.6, "eupl": 0.4, "sspl": 0.1, "busl": 0.1,
    "cc-by-nc-sa": 0.1, "cc-by-nc-nd": 0.05,
}
# Names in identifiers that are not the label itself.
NAMES = {"bsl": "boost", "python": "psf", "apache-license": "apache", "expat": "mit", "x11": "mit", "0bsd": "bsd", "mit-0": "mit", "cc-pddc": "public-domain", "cc0": "cc0", "clpartistic": "artistic", "ncsa": "mit"}
# By which share of its distance to 1 an exception raises a licence: those that allow linking, and those that free what a tool puts out.
EXCEPTIONS = {
    "classpath-exception-2.0": 0.2, "linux-syscall-note": 0.2, "openvpn-openssl-exception": 0.2, "u-boot-exception-2.0": 0.2, "wxwindows-exception-3.1": 0.2, "fltk-exception": 0.2,
    "ocaml-lgpl-linking-exception": 0.2, "qt-gpl-exception-1.0": 0.2, "universal-foss-exception-1.0": 0.2, "ecos-exception-2.0": 0.2, "llvm-exception": 0.2, "swift-exception": 0.2,
    "gcc-exception-2.0": 0.5, "gcc-exception-3.1": 0.5, "bison-exception-2.2": 0.5, "autoconf-exception-2.0": 0.5, "autoconf-exception-3.0": 0.5, "font-exception-2.0": 0.5, "bootloader-exception": 0.5, "libtool-exception": 0.5,
}
UNKNOWN, NOTHING = 0.5, 1.0
KEEPS_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: The tag in the raw text, and what may stand behind it on its line.
TAG_LINE = re.compile(r"spdx-license-identifier[ \t]*:[ \t]*([^\n\r]*)", re.I)
EXPRESSION = re.compile(r"[A-Za-z0-9.+-]+|[()]|[^ \t]")
SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, expressions array<string>, score double"


@lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    """One automaton of all phrases, as words between spaces (one character per UTF-8 byte)."""
    out = ahocorasick.Automaton()
    for phrase in {*BASE_PHRASES, *NOTICE_PHRASES, TAG}:
        out.add_word(f" {phrase} ", phrase)
    out.make_automaton()
    return out


#: What may follow a family: a version, its words, and what allows later versions.
TAIL = re.compile(r"(?:-?v?(?P<version>\d+(?:\.\d+)*))?(?P<words>(?:-[a-z0-9.]+)*?)(?P<later>\+|-or-later)?")


def parsed(name: str) -> tuple[str, str, bool] | None:
    """(family, version, later versions too) of a licence name such as GPL-2.0-only, GPLv2+, MIT or CC-BY-SA-4.0; None for an unknown one."""
    name = name.lower()
    for known in sorted({*PERMISSIVE, *NAMES}, key=len, reverse=True):
        if name.startswith(known) and (m := TAIL.fullmatch(name, len(known))):
            return NAMES.get(known, known), m["version"] or "", bool(m["later"])
    return None


@lru_cache(10_000)
def family(name: str) -> str | None:
    """The label of a licence name."""
    found = parsed(name)
    return found[0] if found else None


def evaluate(expression: str) -> tuple[float, set[str], str]:
    """Value, labels and the postfix form of a licence expression, by the shunting-yard method."""
    rank, out, waiting, needs_name = {"or": 1, "and": 2, "with": 3}, [], [], True
    tokens, sound = EXPRESSION.findall(expression), True
    for token in tokens:
        low = token.lower()
        if low in rank:
            sound &= not needs_name
            while waiting and waiting[-1] != "(" and rank[waiting[-1]] >= rank[low]:
                out.append(waiting.pop())
            waiting.append(low)
            needs_name = True
        elif token == "(":
            if not needs_name:
                break
            waiting.append(token)
        elif token == ")":
            if "(" not in waiting or needs_name:
                break
            while (top := waiting.pop()) != "(":
                out.append(top)
        elif re.fullmatch(r"[A-Za-z0-9.+-]+", token) and needs_name:
            out.append(token)
            needs_name = False
        else:  # prose after the expression
            break
    sound &= not needs_name and "(" not in waiting
    names = [t for t in out if t not in rank]
    labels = {f for t in names if (f := family(t))}
    values = lambda t: PERMISSIVE.get(family(t) or "", UNKNOWN)
    out += reversed(waiting)
    if not sound:
        names = [t for t in names if t.lower() not in EXCEPTIONS]
        return min(map(values, names), default=UNKNOWN), labels, " ".join([*names, *["and"] * (len(names) - 1)])
    stack: list[tuple[float, str]] = []
    for token in out:
        if token not in rank:
            stack.append((values(token), token.lower()))
            continue
        (right, name), (left, _) = stack.pop(), stack.pop()
        stack.append((max(left, right) if token == "or" else min(left, right) if token == "and" else left + (1 - left) * EXCEPTIONS.get(name, 0.0), ""))
    return stack[0][0], labels, " ".join(out)


def scan_text(text: str | None) -> tuple:
    """The values of SCHEMA for one text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").translate(KEEPS_WORDS).split()
    joined = f" {b' '.join(words).decode('latin-1')} "
    base, labels, base_labels, first, last, n_base, word, at, tagged = [], set(), set(), None, None, 0, 0, 0, False
    for end, phrase in automaton().iter(joined):
        if phrase in BASE_PHRASES:
            start = end - len(phrase) - 1
            base.append(start)
            base_labels.add(BASE_PHRASES[phrase])
        tagged |= phrase == TAG
        if phrase in NOTICE_PHRASES:
            labels.add(NOTICE_PHRASES[phrase])
    for start in sorted(base):
        word += joined.count(" ", at, start)
        at = start
        first, last, n_base = (word if first is None else first), word, n_base + 1
    labels |= base_labels
    value, expressions = min((PERMISSIVE[x] for x in labels), default=NOTHING), []
    if tagged:
        for m in TAG_LINE.finditer(text):
            v, found, postfix = evaluate(m[1])
            if postfix:
                expressions.append(postfix)
                labels |= found
                value = min(value, v)
    return len(words), n_base, first, last, ",".join(sorted(base_labels)), ",".join(sorted(labels)), expressions, value


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and what the scan found; first_word and last_word are word numbers from 0, null where no base phrase stands."""
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", per_text(scan_text, SCHEMA)("text").alias("_found")).select("doc_id", "_found.*")
