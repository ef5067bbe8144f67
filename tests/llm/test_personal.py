"""Discovery of unseen identifiers: recall and precision on planted ones, whole results against plain Python, odd inputs."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from ledgerloom.llm import personal


def card(rng):
    head = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return next(head + d for d in "0123456789" if personal.luhn(head + d))


#: How people lead to identifiers, and forms that the fixed patterns know and don't.
LEADS = {
    "phone": ("call me on", "my mobile is", lambda r: f"+1 ({r.randint(200, 999)}) 555-{r.randint(1000, 9999)}", lambda r: f"({r.randint(200, 999)}) 555-{r.randint(1000, 9999)}"),
    "email": ("mail me at", "write to address", lambda r: f"u{r.randint(1, 10**6)}@mail{r.randint(1, 9)}.example.com", lambda r: f"u{r.randint(1, 10**6)}@localhost"),
    "card": ("charge my card", "card number is", card, lambda r: (c := card(r))[:15] + str((int(c[15]) + 1) % 10)),
}


def planted(rng, n):
    """(text, seeds, unseen): random words, some with a lead and an identifier, numbers elsewhere that are none."""
    word = lambda: rng.choice("the of and a to is in that it was as for on be at by this have from or one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after".split())
    texts, unseen = [], []
    for i in range(n):
        words, marks = [word() for _ in range(rng.randint(20, 40))], []
        for _ in range(rng.randint(0, 2)):
            kind = rng.choice(list(LEADS))
            first, second, known, other = LEADS[kind]
            new = rng.random() < 0.15
            value = (other if new else known)(rng)
            at = rng.randint(0, len(words))
            words[at:at] = [f"{rng.choice((first, second))} {value}"]
            if new:
                marks.append((kind, value))
        if rng.random() < 0.5:  # no identifiers: order numbers and the like, after any word
            words.insert(rng.randint(0, len(words)), rng.choice([f"order {rng.randint(10**15, 10**16 - 1)}", f"{rng.randint(10**15, 10**16 - 1)}", f"room ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"]))
        text = " ".join(words)
        texts.append((i, text))
        unseen += [(i, f"{kind}:{text.index(value)}:{text.index(value) + len(value)}") for kind, value in marks]
    return texts, set(unseen)


def test_recall_and_precision(spark):
    texts, unseen = planted(random.Random(5), 1500)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    added = set()
    for r in personal.find(df).collect():
        base = Counter(r.base.split(","))
        added |= {(r.doc_id, s) for s in r.spans.split(",") if s and not base[s]}
    assert len(unseen) > 150
    right = len(added & unseen)
    assert right / len(unseen) >= 0.95, (right, len(unseen))
    assert right / len(added) >= 0.95, sorted(added - unseen)[:5]


def brute(rows):
    """spans of find(), in plain Python, from what extract() holds of each text."""
    found = [(i, personal.extract_several(t)) for i, t in rows]
    kinds, of, seeds = {}, defaultdict(set), {}
    for _, (_, _, tokens) in found:
        for _, _, kind, contexts, value in tokens:
            for c in contexts:
                kinds[c, value] = max(kind, kinds.get((c, value), -1))
    for (c, v), k in kinds.items():
        of[c].add(v)
        if k >= 0:
            seeds[v] = min(k, seeds.get(v, 9))
    scores = {v: (k, 1.0) for v, k in seeds.items()}
    for _ in range(personal.ROUNDS):
        good = {}
        for c, values in of.items():
            s = [scores[v] for v in values if v in scores]
            confidence = sum(x for _, x in s) / (len(values) + personal.PRIOR)
            votes = [sum(x for k, x in s if k == kind) for kind in range(4)]
            if sum(x >= 0.5 for _, x in s) >= personal.MIN_SUPPORT and confidence >= personal.MIN_CONFIDENCE / 2:
                good[c] = (votes.index(max(votes)), confidence)
        reached = defaultdict(list)
        for c, v in kinds:
            if c in good and v not in seeds:
                reached[v].append(good[c])
        scores = {v: (min(k for k, _ in cs), 1 - np.prod([1 - 0.99 * x for _, x in cs])) for v, cs in reached.items()} | {v: (k, 1.0) for v, k in seeds.items()}
    marks = {c: k for c, (k, x) in good.items() if x >= personal.MIN_CONFIDENCE}
    out = []
    for i, (counts, base, tokens) in found:
        spans = {}
        for start, end, kind, contexts, _ in tokens:
            if kind < 0 and (hit := [marks[c] for c in contexts if c in marks]):
                spans[start, end] = min(hit)
        added = []
        for (start, end), kind in sorted(spans.items(), key=lambda x: (x[0][0], -x[0][1], x[1])):
            if added and start < added[-1][2]:
                added[-1] = (added[-1][0], added[-1][1], max(added[-1][2], end))
            else:
                added.append((start, kind, end))
        text = lambda ss: ",".join(f"{personal.KINDS[k]}:{a}:{b}" for a, k, b in ss)
        out.append((i, *counts, text(base), text(sorted([*base, *added]))))
    return Counter(out)


def got(df):
    return Counter((r.doc_id, *(r[f"n_{k}"] for k in personal.KINDS), r.base, r.spans) for r in personal.find(df).collect())


def test_spans_by_brute_force(spark, docs, texts):
    """On planted texts, and on the odd documents (long text, repeated rows, nulls, clashing columns) with kinds that tie."""
    rows, _ = planted(random.Random(6), 400)
    expected = brute(rows)
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == expected and any(r[5] != r[6] for r in expected)
    rng = random.Random(8)
    ties = [(700 + n, f"send it over {card(rng) if n % 2 else f'+1 (743) 555-{1000 + n}'} today please {'#' * (n % 3)}") for n in range(12)] + [(720, "send it over (743) 555-3824 today please"), (720, "send it over (743) 555-3824 today please"), (721, "send it over " + "9" * 500 + "1" * 15_000 + " today please")]
    extra = spark.createDataFrame(ties, "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(extra)
    clash = both.withColumns({c: both["doc_id"] for c in ("x", "p", "packed", "tokens", "new", "key", "counts", "base", "added", "spans", "rest")})
    assert got(clash) == brute([*texts, *ties])
    out = personal.redact(clash)
    assert out.columns == clash.columns and out.count() == clash.count()
    assert {r.tokens for r in out.where("doc_id = 720").collect()} == {720}


def test_one_word_is_no_reason():
    """A word like 'the' before numbers carries scores, but only contexts of several words may mark."""
    contexts = personal.contexts_of("4111111111111112", "the", "was", far=("of", "in"))
    assert [c for c in contexts if not c.startswith("\t")] == ["the _d16", "the _~#14", "_d16 was", "_~#14 was"]
    assert not any(c.startswith("\t") for w in ("|", "^", "--") for c in personal.contexts_of("4111111111111112", w, w, far=(w, w)))
    assert [re.sub("_.d16|_d16", "_", c[1:]) for c in contexts if c.startswith("\t") and "~" not in c] == ["of the _", "_ was in", "the _ was"]
