"""Labels and scores of the licence scan, held against a plain recursive reader."""

import random
import re

import pytest

from ledgerloom.llm import licences


@pytest.mark.parametrize(
    "name, expected",
    [
        ("GPL-2.0-only", ("gpl", "2.0", False)),
        ("GPLv2+", ("gpl", "2", True)),
        ("LGPL-2.1-or-later", ("lgpl", "2.1", True)),
        ("gpl", ("gpl", "", False)),
        ("Apache-2.0", ("apache", "2.0", False)),
        ("Apache2", ("apache", "2", False)),
        ("BSD-3-Clause", ("bsd", "3", False)),
        ("BSL-1.0", ("boost", "1.0", False)),
        ("BUSL-1.1", ("busl", "1.1", False)),
        ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa", "4.0", False)),
        ("CC-BY-4.0", ("cc-by", "4.0", False)),
        ("CC0-1.0", ("cc0", "1.0", False)),
        ("0BSD", ("bsd", "", False)),
        ("MITIGATION", None),
        ("LicenseRef-mine", None),
    ],
)
def test_names(name, expected):
    assert licences.parsed(name) == expected


def value_of(name):
    found = licences.parsed(name)
    return licences.PERMISSIVE[found[0]] if found else 0.5


def reader(tokens):
    """A recursive reader of sound expressions: or over and over with, the loosest last."""

    def either():
        value = both()
        while tokens and tokens[0].lower() == "or":
            tokens.pop(0)
            value = max(value, both())
        return value

    def both():
        value = one()
        while tokens and tokens[0].lower() == "and":
            tokens.pop(0)
            value = min(value, one())
        return value

    def one():
        if tokens[0] == "(":
            tokens.pop(0)
            value = either()
            assert tokens.pop(0) == ")"
        else:
            value = value_of(tokens.pop(0))
        while tokens and tokens[0].lower() == "with":
            tokens.pop(0)
            value += (1 - value) * licences.EXCEPTIONS.get(tokens.pop(0).lower(), 0)
        return value

    return either()


def made(rng, depth=0):
    if depth > 3 or rng.random() < 0.4:
        name = rng.choice(["MIT", "GPL-2.0-only", "GPLv3+", "Apache-2.0", "CC-BY-NC-4.0", "Unheard-1.0", "LGPL-2.1-or-later"])
        return name if rng.random() < 0.7 else f"{name} {rng.choice(['WITH', 'with'])} {rng.choice(['Classpath-exception-2.0', 'GCC-exception-3.1', 'Own-exception'])}"
    parts = [made(rng, depth + 1) for _ in range(rng.randint(2, 3))]
    return f" {rng.choice(['AND', 'or', 'And', 'OR'])} ".join(f"({p})" if rng.random() < 0.6 else p for p in parts)


def test_expressions_against_a_recursive_reader():
    rng = random.Random(1)
    for _ in range(2000):
        text = made(rng)
        names = [t for t in re.findall(r"[A-Za-z0-9.+-]+", text) if t.lower() not in ("and", "or", "with")]
        value, labels, _ = licences.evaluate(text)
        assert value == pytest.approx(reader(licences.EXPRESSION.findall(text))), text
        assert labels == {f[0] for n in names if (f := licences.parsed(n))}


def test_exceptions():
    alone, linked, put_out, own = (licences.evaluate(f"GPL-3.0-or-later{x}")[0] for x in ("", " WITH Classpath-exception-2.0", " WITH GCC-exception-3.1", " WITH Nobody-knows"))
    assert alone == own == 0.3 and linked == pytest.approx(0.44) and put_out == pytest.approx(0.65)
    assert licences.evaluate("GPL-2.0 WITH") == (0.3, {"gpl"}, "GPL-2.0")


def test_labels_and_scores_by_brute_force(spark):
    """Phrases are found word by word, tags line by line."""
    phrases = licences.BASE_PHRASES | licences.NOTICE_PHRASES
    rng = random.Random(2)
    texts = [None, "", "SPDX-License-Identifier:", "spdx license identifier MIT"]
    for _ in range(200):
        parts = []
        for _ in range(rng.randint(1, 8)):
            phrase = rng.choice([*phrases, "nothing", "MIT", "license", "by"])
            parts.append(rng.choice([phrase, phrase.upper(), phrase.replace(" ", "-"), phrase.replace(" ", ",\n ")]))
            if rng.random() < 0.2:
                parts.append(f"\n// SPDX-License-Identifier: {made(rng)}\n")
        texts.append(rng.choice([" ", "; ", "\n"]).join(parts))

    def expected(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        labels = {x for p, x in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()}
        score = min((licences.PERMISSIVE[x] for x in labels), default=1.0)
        for line in re.findall(r"(?i)spdx-license-identifier[ \t]*:[ \t]*([^\n\r]*)", text or ""):
            if tokens := licences.EXPRESSION.findall(line):
                value, found, _ = licences.evaluate(line) if tokens[-1] in (";", ",") else (reader(tokens), {f[0] for t in licences.EXPRESSION.findall(line) if (f := licences.parsed(t))}, "")
                labels, score = labels | found, min(score, value)
        return ",".join(sorted(labels)), pytest.approx(score)

    rows = licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.labels, r.score) == expected(texts[r.doc_id]), texts[r.doc_id]
