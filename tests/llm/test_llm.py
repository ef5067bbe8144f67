"""The operators of the llm subpackage against brute force, round trips and held-out accuracy, with nulls, empties, long and repeated texts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import chat, compression, embeddings, licences, links, minhash, mixing, packing, passages, personal, text_rules
from ledgerloom.llm import queries as llm_queries
from ledgerloom.llm.common import table

SF = "/root/testdata/sf0.001"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def classes_of(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_near_duplicates(spark, docs, texts):
    got = minhash.classes(docs).collect()
    assert len(got) == len(texts)
    seen = Counter(w for _, t in texts for w in set(words(t)))

    def vector(t):
        w, out = words(t), Counter()
        idf = [1 + np.log((1 + len(texts)) / (1 + seen[x])) for x in w]
        size = min(5, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            out[tuple(w[i : i + size])] += sum(idf[i : i + size]) / size
        return out

    def similar(a, b):
        both = sum(min(x, b[s]) for s, x in a.items() if s in b)
        return both / (sum(a.values()) + sum(b.values()) - both)

    vectors = [vector(t) for _, t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if vectors[i] and vectors[j] and similar(vectors[i], vectors[j]) >= 0.8]
    comp = classes_of(range(len(texts)), pairs)
    members = defaultdict(list)
    for n, (i, t) in enumerate(texts):
        members[comp[n]].append(i)
    low = lambda ids: min((-1 if i is None else i) for i in ids)
    expected = Counter((i, low(members[comp[n]])) for n, (i, t) in enumerate(texts))
    assert Counter((r.doc_id, -1 if r.class_id is None else r.class_id) for r in got) == expected
    assert sum(r.kept for r in got) == len(set(comp.values()))


def test_similarities_use_exact_frequencies(spark):
    """More words than counters: links by a document frequency of each word, computed here."""
    common = [f"c{n}" for n in range(100)]
    fill = spark.range(12).selectExpr("id + 1000 as doc_id", "concat_ws(' ', '" + " ".join(common) + "', concat_ws(' ', transform(sequence(0, 300000), x -> concat('f', id, '_', x)))) as text")
    pairs = []
    for k in range(4):
        rare = [f"r{k}_{n}" for n in range(40)]
        pairs += [common + [f"{s}{k}_{n}" for n in range(7)] for s in "ab"]  # rare words differ
        pairs += [rare + common[10 * k : 10 * k + 8], rare + common[99 : 91 - k : -1][:8]]  # common words differ
    docs = spark.createDataFrame([(n, " ".join(w)) for n, w in enumerate(pairs)], "doc_id long, text string").unionByName(fill)
    held = [set(r.text.split()) for r in docs.collect()]
    seen = Counter(w for h in held for w in h)

    def vector(w):
        idf = [1 + np.log((1 + len(held)) / (1 + seen[x])) for x in w]
        out = Counter()
        for i in range(len(w) - 4):
            out[tuple(w[i : i + 5])] += sum(idf[i : i + 5]) / 5
        return out

    def similar(a, b):
        both = sum(min(x, b[s]) for s, x in a.items())
        return both / (sum(a.values()) + sum(b.values()) - both)

    vectors = [vector(w) for w in pairs]
    near = {(i, j): similar(vectors[i], vectors[j]) for i in range(len(pairs)) for j in range(i + 1, len(pairs))}
    assert sum(x >= 0.8 for x in near.values()) >= 4 and all(near[4 * k, 4 * k + 1] < 0.78 for k in range(4))
    expected = classes_of(range(len(pairs)), [p for p, x in near.items() if x >= 0.8])
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert {n: got[n] for n in range(len(pairs))} == expected and all(got[n] == n for n in range(1000, 1012))


def test_near_duplicate_filter(docs, texts):
    kept = minhash.filter_documents(docs)
    assert kept.columns == docs.columns
    assert kept.count() == minhash.classes(docs).where("kept").count()
    assert {r.kept for r in kept.collect()} == {"other"}


def test_samples_estimate_similarity():
    rng = np.random.default_rng(0)
    a, w = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64)), None
    w = rng.random(len(a)) * 5 + 1
    b, v = a[60:], w[60:]
    agree = (minhash.samples([a], [w]) == minhash.samples([b], [v])).mean()
    assert abs(agree - minhash.similarity((a, w), (b, v))) < 0.2
    assert (minhash.samples([a], [w]) == minhash.samples([a], [w])).all()


def test_mixing_reaches_its_targets(spark):
    rng = random.Random(1)
    rows = [(rng.randint(1, 200), p) for _ in range(300) for p in [[0.9, 0.05, 0.05], [0.1, 0.85, 0.05], [0.2, 0.1, 0.7]][: rng.randint(1, 3)]]
    df = spark.createDataFrame(rows, "tokens long, p array<double>")
    steps = mixing.fit_rates(df, [0.6, 0.2, 0.2])
    out = df.withColumn("r", mixing.rate(steps)).selectExpr("min(r)", *(f"sum(r * tokens * p[{i}]) / sum(tokens)" for i in range(3))).first()
    assert out[0] >= 0 and out[1:] == pytest.approx((0.6, 0.2, 0.2), abs=2e-3)


def test_mixing_of_documents(docs, labels, texts):
    out = mixing.mix(docs, mixing.domains(labels))
    rows = out.collect()
    assert len(rows) == len(texts)
    assert all(abs(r.p_clean + r.p_toxic + r.p_junk - 1) < 1e-9 and r.rate >= 0 and abs(r.copies - r.rate) < 1 for r in rows)
    again = mixing.resample(docs, mixing.domains(labels))
    assert again.columns == docs.columns


def brute_facts(t):
    t = t or ""
    w = words(t)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    c = Counter(windows)
    hit = {k for i, x in enumerate(windows) if c[x] > 1 for k in range(i, i + 5)}
    lines, dup, seen = t.split("\n"), 0, set()
    for x in lines:
        dup += bool(words(x)) and x in seen
        seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)


def test_quality_facts(spark, docs, labels, texts):
    got = text_rules.judge(docs, text_rules.fit(docs, labels)).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == Counter((i, *brute_facts(t)) for i, t in texts)
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed and r.rule is None)


def test_rules_are_learned_on_labels():
    rng = np.random.default_rng(0)
    x = {"a": rng.random(3000), "b": rng.random(3000)}
    bad = (x["a"] > 0.7) & (x["b"] <= 0.4)
    rules = text_rules.learn_rules(x, bad)
    hit = np.any([r.covers(x) for r in rules], axis=0)
    assert (hit & bad).sum() > 0.85 * bad.sum() and (hit & ~bad).sum() < 0.02 * hit.sum()
    assert text_rules.learn_rules(x, np.zeros(3000, dtype=bool)) == []


def test_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((60, 16))
    v = np.concatenate([base, base[:20] + rng.standard_normal((20, 16)) * 0.04, base[:5]]).astype(np.float32)
    label = np.arange(len(v)) % 20 % 2
    rows = [(n, x.tolist(), int(k)) for n, (x, k) in enumerate(zip(v, label))]
    odd = [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [1.0, None] * 8, 1), (1003, [float("nan")] * 16, 0), (1004, v[0].tolist(), None), (1005, [1.0], 0), (7, v[7].tolist(), int(label[7]))]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").repartition(3)
    got = embeddings.deduplicate(df).collect()
    pair = [(2000, [1.0, 2.0, 2.0], 1), (2001, [1.0, 2.0, 2.1], 1), (2002, [1.0, 2.0, 2.0], 0)]  # another length, and a lone one above
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in embeddings.deduplicate(df.unionByName(spark.createDataFrame(pair, df.schema))).collect() if r.vec_id >= 2000) == Counter([(2000, 1, 2000), (2001, 1, 2000), (2002, 0, 2002)])
    good = [(i, np.array(x, dtype=float), k) for i, x, k in rows + odd[-1:]]
    x = np.stack([g[1] / np.linalg.norm(g[1]) for g in good])
    near = (x @ x.T >= embeddings.THRESHOLD) & (np.array([g[2] for g in good])[:, None] == np.array([g[2] for g in good])[None])
    np.fill_diagonal(near, False)
    comp = classes_of(range(len(good)), list(zip(*np.nonzero(near))))
    expected = Counter((good[n][0], int(near[n].sum()), min(good[m][0] for m in comp if comp[m] == comp[n])) for n in range(len(good)))
    expected += Counter((o[0], 0, o[0]) for o in odd[:-1])
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == expected
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_blocks_hold_every_pair_once(spark):
    df = spark.createDataFrame([(n % 3, n) for n in range(100)] + [(9, 1000)], "bucket long, node long")
    rows = links.in_units(df, ["bucket"], "node", block=8).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r._bucket, r._left, r._right].append(r)
    met = {tuple(sorted((a.node, b.node))) for g in groups.values() for a in g for b in g if a.node < b.node}
    assert met >= {(a, b) for a in range(100) for b in range(a + 1, 100) if a % 3 == b % 3}
    assert max(map(len, groups.values())) <= 40


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(n, n + 1) for n in range(400, 450)]
    got = {r.node: r.root for r in links.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    assert got == {n: r for n, r in classes_of(nodes, edges).items()}


def test_compression_classifier(spark):
    out = llm_queries.op5_compression_classifier(spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").where("held_out")
    right = out.agg(F.avg((F.col("quality") == (F.col("score") >= 0.5).cast("int")).cast("double"))).first()[0]
    assert right >= 0.85


def test_compression_of_odd_texts(docs, labels, texts, empty):
    rows = compression.score_documents(docs, compression.fit(docs, labels)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert compression.score_documents(docs, compression.fit(empty, labels)).first().score == pytest.approx(0.5)


def test_repeated_passages(docs, texts):
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in passages.remove_recurring(docs).collect())
    every = [words(t) for _, t in texts]
    count = Counter(tuple(w[i : i + 35]) for w in every for i in range(len(w) - 34))
    expected = Counter()
    for (doc, _), w in zip(texts, every):
        gone = {k for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for k in range(i, i + 35)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        expected[doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    assert got == expected


def test_packing(spark, docs, texts):
    from tokenizers import Tokenizer

    rows = packing.pack(docs, length=512).collect()
    t = Tokenizer.from_file(packing.default_tokenizer())
    expected = Counter()
    for doc, text in texts:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for n, at in enumerate(range(0, len(ids), 512)):
            part = ids[at : at + 512]
            expected[doc, n, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 512
    assert len(bins) <= 1.05 * sum(r.length for r in rows) / 512 + 1


def test_word_encoder_is_the_tokenizer():
    from tokenizers import Tokenizer

    path, rng = packing.default_tokenizer(), random.Random(4)
    t, encode = Tokenizer.from_file(path), packing.WordEncoder(path)
    letters = [*"aéÀ'’s t\n\t\x1c\x85\xa0́ΣσςİßµªŉǅȺ12½²<|>漢字👍🏼가‍-.*_", "<|endoftext|>", "'re", "'LL"]
    for _ in range(4000):
        s = "".join(rng.choice(letters) for _ in range(rng.randint(0, 20)))
        assert encode(s) == np.array(t.encode(s, add_special_tokens=False).ids, dtype="<u4").tobytes(), repr(s)


def test_local_search_improves_best_fit():
    rng = np.random.default_rng(0)
    for low, high in ((900, 1900), (1, 4096), (1300, 1500)):
        lengths = rng.integers(low, high, 400)
        before = packing.best_fit(lengths, 4096)
        after = packing.local_search(lengths, before, 4096)
        fill = lambda b: np.bincount(b, weights=lengths)
        assert fill(after).max() <= 4096 and (fill(after) ** 2).sum() >= (fill(before) ** 2).sum()
        assert len(set(after)) <= len(set(before))


def test_local_search_empties_bins():
    """From bins in order of arrival to the lower bound."""
    lengths = np.minimum(np.random.default_rng(1).lognormal(6, 1, 4000).astype(np.int64) + 1, 4095)
    start = packing.next_fit(lengths, 4096)
    after = packing.local_search(lengths, start, 4096)
    bound = -(-lengths.sum() // 4096)
    assert len(set(start)) > 1.1 * bound and len(set(after)) <= 1.003 * bound and np.bincount(after, weights=lengths).max() <= 4096


def test_other_tokenizers_encode_whole_texts(tmp_path):
    import json
    import os

    from tokenizers import Tokenizer

    folder = os.path.dirname(packing.default_tokenizer())
    for path in (f"{folder}/byte_bpe_50k.json", str(tmp_path / "changed.json")):
        if path.startswith(str(tmp_path)):
            settings = json.load(open(packing.default_tokenizer()))
            settings["normalizer"] = None
            json.dump(settings, open(path, "w"))
        t, encode = Tokenizer.from_file(path), packing.WordEncoder(path)
        for text in ("Some  Text\n here, and\tthere's more", "", None):
            assert not encode.by_word and encode(text) == np.array(t.encode(text or "", add_special_tokens=False).ids, dtype="<u4").tobytes()


@pytest.mark.parametrize(
    "text, base, labels, first, last, n",
    [
        ("Licensed CC-BY. All rights\nReserved! general public license", "cc-by,gpl,reserved", "cc-by,gpl,reserved", 1, 6, 3),
        ("all rights reserved all rights reserved", "reserved", "reserved", 0, 3, 2),
        ("call rights reserved", "", "", None, None, 0),
        ("SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0", "", "apache,gpl,mit", None, None, 0),
        (None, "", "", None, None, 0),
    ],
)
def test_licences(text, base, labels, first, last, n):
    found = licences.scan_text(text)
    assert (found[4], found[5], found[2], found[3], found[1]) == (base, labels, first, last, n)
    assert 0 <= found[7] <= 1


def test_licence_expressions():
    assert licences.evaluate("MIT OR GPL-3.0-only AND Apache-2.0") == (0.9, {"mit", "gpl", "apache"}, "MIT GPL-3.0-only Apache-2.0 and or")
    assert licences.evaluate("GPL-2.0 WITH Classpath-exception-2.0")[0] == pytest.approx(0.44)
    assert licences.evaluate("(MIT")[0] == 0.9 and licences.evaluate("")[1] == set()


def test_licence_scan_by_brute_force(docs, texts):
    def brute(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = sorted(i for p in licences.BASE_PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        return len(w), len(at), at[0] if at else None, at[-1] if at else None

    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word) for r in licences.scan(docs).collect()) == Counter((i, *brute(t)) for i, t in texts)


def brute_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m)) <= 19 and personal.luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m)) <= 15]
    return sorted(out)


def test_personal_patterns():
    rng = random.Random(1)
    parts = ["a", "@", ".", "1", "25", "300", "+", "-", " ", "(", "4111111111111111", "_b", "x@y.z", "1.2.3.4", "é"]
    for _ in range(20_000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert personal.base_spans(t) == brute_spans(t), t


def test_unseen_identifiers_are_found(spark):
    known = [(n, f"call mobile 4{n:03d}11111111111{n % 10} now") for n in range(40)]
    known = [(n, t) for n, t in known if brute_spans(t)] + [(100 + n, f"reach x{n}@mail.example.com today") for n in range(5)]
    cards = [f"4{n:014d}" for n in range(400) if personal.luhn(f"4{n:014d}")][:12]
    seeds = [(200 + n, f"my account {c} thanks") for n, c in enumerate(cards)]
    unseen = [(300, "my account 412345678901234 thanks"), (301, "the parcel 412345678901234x9 went"), (302, None)]
    df = spark.createDataFrame(known + seeds + unseen, "doc_id long, text string")
    rows = {r.doc_id: r for r in personal.find(df).collect()}
    assert rows[300].base == "" or rows[300].n_card == 1
    assert rows[300].spans == "card:11:26" and rows[302].spans == ""
    out = {r.doc_id: r.text for r in personal.redact(df).collect()}
    assert out[300] == "my account <CARD> thanks" and out[302] is None and "<EMAIL>" in out[100]


def test_whole_spans_give_contexts(spark):
    """Spans of several tokens and e-mails without digits teach the words beside them; candidates may be several tokens too."""
    cards = [" ".join(re.findall("....", f"4{n:015d}")) for n in range(200) if personal.luhn(f"4{n:015d}")][:6]
    names = ["anna", "bert", "carl", "dora", "emil", "fritz"]
    seeds = [t for n in range(6) for t in (f"call me on +1 (743) 555-{3000 + n} x{n}", f"pay with {cards[n]} y{n}", f"mail me at {names[n]}@mail.example.com z{n}")]
    unseen = ["call me on (743) 555-3824 tomorrow", "pay with 4111 1111 1111 1112 soon", "mail me at gerd@localhost then", "room (743) 555-3824 was 4111 1111 1111 1112 wide"]
    df = spark.createDataFrame([*enumerate(seeds), *enumerate(unseen, 100)], "doc_id long, text string")
    rows = {r.doc_id: r.spans for r in personal.find(df).collect()}
    assert [rows[n] for n in range(100, 104)] == ["phone:11:25", "card:9:28", "email:11:25", ""]
    out = {r.doc_id: r.text for r in personal.redact(df).collect()}
    assert out[100] == "call me on <PHONE> tomorrow" and out[101] == "pay with <CARD> soon" and out[103] == unseen[3]
    _, _, tokens = personal.extract("so call (+1 (743) 555-3824), please")
    assert [t[3][0] for t in tokens] == ["call _+d1 (d3) d3-d4"] and tokens[0][3][2].startswith("_+d1 (d3) d3-d4 please")


def test_chat_matches_duckdb(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "hi <|im_end|>"), (1, 2, "bot", None), (1, 2, "bot", None), (1, None, None, "é👍"), (2, 0, "system", "x"), (None, 70, "user", "late"), (None, 1, "amy", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    conversations = df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"})  # noqa: F841  read by name below
    expected = duckdb.sql(chat.ORACLE_SQL)
    out = chat.perspectives(df.withColumn("part", F.lit("clash")))
    assert Counter(map(tuple, out.select(*expected.columns).collect())) == Counter(expected.fetchall())


def test_empty_tables(spark, empty, labels):
    none = spark.createDataFrame([], labels.schema)
    assert minhash.near_duplicates(empty).count() == 0
    assert mixing.mix(empty, mixing.domains(none)).count() == 0
    assert text_rules.judge(empty, text_rules.fit(empty, none)).count() == 0
    assert text_rules.filter_documents(empty, []).columns == empty.columns
    assert embeddings.deduplicate(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert compression.score_documents(empty, compression.fit(empty, none)).count() == 0
    assert passages.remove_recurring(empty).count() == 0
    assert packing.pack(empty).count() == 0
    assert licences.scan(empty).count() == 0
    assert personal.find(empty).count() == 0
    assert chat.perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "personal_data", "source_mixing", "packing"]
    docs = table(spark, SF, "documents")
    rules = text_rules.fit(docs, table(spark, SF, "labels"))
    kept = text_rules.judge(docs, rules).where("kept")
    first = corpus_pipeline.quality_rules(spark, docs, SF)
    assert first.columns == docs.columns and first.count() == kept.count()
    second = corpus_pipeline.near_duplicates(spark, first, SF)
    assert second.count() == minhash.near_duplicates(first).where("kept").count()
    out = corpus_pipeline.run(spark, SF)
    assert set(out.columns) >= {"doc_id", "piece", "sequence_id", "offset"} and out.count() > 0


def test_repeated_passages_of_common_anchors(docs, texts):
    """With anchors of more than one segment cut into windows the result is the same."""
    rows = lambda most: Counter(map(tuple, passages.remove_recurring(docs, most=most).collect()))
    assert rows(1) == rows(2_000)


def test_words_that_differ_have_different_hashes(spark):
    """Two long words of two letters, arranged so that any polynomial modulo a power of two takes them for one."""
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    rest = [f"r{n}" for n in range(40)]
    df = spark.createDataFrame([(1, " ".join([a, *rest[:36]])), (2, " ".join([b, *rest[:33], "x", "y", "z"]))], "doc_id long, text string")
    assert {r.doc_id: (r.n_words, r.n_removed) for r in passages.remove_recurring(df).collect()} == {1: (37, 0), 2: (37, 0)}


def test_mixing_by_brute_force(docs, labels, texts):
    """Posteriors, rates and copies of every document, computed one by one; and no other rates come closer to the targets."""
    import xxhash

    labelled = mixing.domains(labels)
    model = mixing.fit(docs, labelled)

    def posterior(t):
        at = [xxhash.xxh3_64_intdigest(w.encode()) % mixing.COUNTERS for w in words(t)]
        k = len(model.ratios)
        x = [sum(model.ratios[d][c] for c in at) / len(at) for d in range(k)] + [max(model.ratios[d][c] for c in at) for d in range(k)] if at else [0.0] * 2 * k
        z = [sum(a * model.weights[i][d] for i, a in enumerate([*x, 1.0])) for d in range(k)]
        e = [np.exp(v - max(z)) for v in z]
        return [v / sum(e) for v in e]

    rows = mixing.mix(docs, labelled).collect()
    expected = defaultdict(list)
    for i, t in texts:
        expected[i, len(words(t))].append(posterior(t))
    for r in rows:
        assert any(np.allclose([r.p_clean, r.p_toxic, r.p_junk], p, atol=1e-9) for p in expected[r.doc_id, r.tokens])
        assert 0 <= r.rate <= mixing.MAX_RATE and r.copies in (int(r.rate), int(r.rate) + 1)
    p, t = np.array([[r.p_clean, r.p_toxic, r.p_junk] for r in rows]), np.array([r.tokens for r in rows], dtype=float)
    goal = np.array(list(mixing.TARGETS.values())) * t.sum()
    miss = lambda x: float((((x * t) @ p - goal) ** 2).sum())
    x = np.ones(len(rows))
    step = 1 / np.linalg.norm(p * t[:, None], 2) ** 2
    for _ in range(20_000):  # projected gradient on all rates, one by one
        x = np.clip(x - step * (p @ (((x * t) @ p) - goal)) * t, 0, mixing.MAX_RATE)
    assert miss(np.array([r.rate for r in rows])) <= miss(x) + (0.05 * t.sum()) ** 2
    again = Counter(r.doc_id for r in mixing.resample(docs, labelled).collect())
    taken = Counter()
    for r in rows:
        taken[r.doc_id] += int(np.floor(r.rate + 1))
    assert all(n <= taken[i] for i, n in again.items())


def test_compression_scores_by_brute_force(docs, labels, texts):
    import zstandard

    model = compression.fit(docs, labels)
    rows = compression.score_documents(docs, model).collect()
    made = [zstandard.ZstdCompressionDict(d) for d in (model.good, model.bad)] if model.good and model.bad else None

    def difference(t):
        raw = (t or "").encode()
        if not made or not raw:
            return 0.0
        good, bad = (sum(len(zstandard.ZstdCompressor(level=compression.LEVEL, dict_data=d, write_content_size=False, write_dict_id=False).compress(raw[i : i + compression.BLOCK])) for i in range(0, len(raw), compression.BLOCK)) for d in made)
        return (bad - good) / (bad + good)

    expected = Counter((i, round(1 / (1 + np.exp(-(model.slope * difference(t) + model.offset))), 6)) for i, t in texts if len(t or "") < 5_000)
    got = Counter((r.doc_id, round(r.score, 6)) for r in rows)
    assert not expected - got


def test_contexts_by_brute_force(spark):
    """Rounds over the graph of contexts and values, in plain Python."""
    rng = random.Random(7)
    cards = [f"4{n:015d}" for n in range(4000) if personal.luhn(f"4{n:015d}")]
    lead = ["card", "number", "pay", "ref", "x" * 80 + "1", "x" * 80 + "2"]
    rows = []
    for n in range(300):
        value = rng.choice(cards) if rng.random() < 0.5 else f"{rng.randint(10**5, 10**9)}"
        rows.append((n, f"my {rng.choice(lead)} {value} {rng.choice(['thanks', 'now', 'is'])} and {rng.choice(lead)} {rng.choice(cards)} ok"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.context, r.kind) for r in personal.confident_contexts(personal.extracted(df)).collect()}

    kinds = {}
    for _, t in rows:
        for _, _, kind, contexts, value in personal.extract(t)[2]:
            for c in contexts:
                kinds[c, value] = max(kind, kinds.get((c, value), -1))
    seeds = {}
    for (_, v), k in kinds.items():
        if k >= 0:
            seeds[v] = min(k, seeds.get(v, 9))
    scores = {v: (k, 1.0) for v, k in seeds.items()}
    of = defaultdict(set)
    for c, v in kinds:
        of[c].add(v)
    for n in range(personal.ROUNDS):
        found = {}
        for c, values in of.items():
            s = [scores[v] for v in values if v in scores]
            confidence = sum(x for _, x in s) / (len(values) + personal.PRIOR)
            votes = [sum(x for k, x in s if k == kind) for kind in range(4)]
            if sum(x >= 0.5 for _, x in s) >= personal.MIN_SUPPORT and confidence >= personal.MIN_CONFIDENCE / 2:
                found[c] = (votes.index(max(votes)), confidence)
        reached = defaultdict(list)
        for c, v in kinds:
            if c in found and v not in seeds:
                reached[v].append(found[c])
        scores = {v: (min(k for k, _ in cs), 1 - np.prod([1 - 0.99 * x for _, x in cs])) for v, cs in reached.items()} | {v: (k, 1.0) for v, k in seeds.items()}
    assert got == {(c, k) for c, (k, x) in found.items() if x >= personal.MIN_CONFIDENCE} != set()


def test_licence_labels_by_brute_force(docs, texts):
    names = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    rng = random.Random(3)
    extra = [(500 + n, " ".join(rng.choice(["CC", "by", "BY-", "General Public\nLicense", "all rights", "reserved", "word", "é"]) for _ in range(30))) for n in range(40)]
    more = docs.sparkSession.createDataFrame(extra, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))

    def labels_of(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return ",".join(sorted({x for p, x in names.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()}))

    got = licences.scan(more).collect()
    assert Counter((r.doc_id, r.base_labels) for r in got) == Counter((i, labels_of(t)) for i, t in [*extra, *texts])
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)


def test_pipeline_stages_by_brute_force(spark, docs, texts, labels, tmp_path):
    """Every stage on the odd documents, each against plain Python over its own input; columns with clashing names stay."""
    import corpus_pipeline

    folder = f"file://{tmp_path}"
    labels.write.parquet(f"{folder}/labels.parquet")
    step = lambda name, df: dict(corpus_pipeline.STAGES)[name](spark, df, folder)
    key = lambda r: (r.doc_id, r.text)

    rules = text_rules.fit(docs, labels)
    first = step("quality_rules", docs).cache()
    judged = Counter(i for i, t in texts if not (len(words(t)) < 10 or 100 * brute_facts(t)[4] > 20 * len(words(t))))
    assert first.columns == docs.columns and {r.kept for r in first.collect()} == {"other"}
    got = Counter(r.doc_id for r in first.collect())
    assert not got - judged and (rules or got == judged)

    second = step("near_duplicates", first).cache()
    classes = minhash.near_duplicates(first).collect()  # held against brute force by test_near_duplicates
    assert second.count() == len({(r.class_id, r.class_id is None) for r in classes}) and not Counter(map(key, second.collect())) - Counter(map(key, first.collect()))

    spans = {r.doc_id: r.spans for r in personal.find(second).collect()}
    third = step("personal_data", second).cache()
    before = {r.doc_id: r.text for r in second.collect()}
    for r in third.collect():
        t, out, at = before[r.doc_id], [], 0
        for kind, a, b in (x.split(":") for x in filter(None, spans[r.doc_id].split(","))):
            out += [t[at : int(a)], f"<{kind.upper()}>"] if int(a) >= at else []
            at = max(at, int(b))
        assert r.text == "".join([*out, t[at:]]) and r.n_chars == len(r.text)

    fourth = step("source_mixing", third).cache()
    copies = {r.doc_id: r.rate for r in mixing.mix(third, mixing.domains(labels)).collect()}
    taken = Counter(map(key, fourth.collect()))
    assert all(taken[key(r)] in (int(copies[r.doc_id]), int(copies[r.doc_id]) + 1) for r in third.collect()) and fourth.columns == docs.columns

    last = step("packing", fourth).collect()
    encode = packing.WordEncoder(packing.default_tokenizer())
    expected = Counter((r.doc_id, *p) for r in fourth.collect() for p in packing.cut(r.text, encode))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in last) == expected

    nothing = docs.limit(0)
    for name in ("quality_rules", "near_duplicates", "personal_data", "source_mixing", "packing"):
        assert step(name, nothing).count() == 0
