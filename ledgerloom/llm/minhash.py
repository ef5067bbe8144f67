"""Near-duplicate texts by improved consistent weighted sampling over TF-IDF shingles.

A shingle is SHINGLE consecutive words (all words of a shorter text); its weight is its count in the text times the
mean inverse document frequency of its words. Document frequencies are counted over all documents, for each word (a
64-bit hash of it). Similarities are computed with these. The samples, which only find candidates, are drawn with the
exact frequencies of the COMMON most frequent words and one mean weight for all others, so what every task needs for
them has a fixed size. Consistent weighted sampling draws HASHES samples of each text; two texts agree in a sample with
the probability of their weighted Jaccard similarity under these weights. Samples are banded: texts that agree on a whole
band meet in a bucket (two of similarity 0.8 meet nowhere with a probability of 2e-5).

Texts with equal words are one node from the start. In a bucket, cut into blocks of bounded size, a pair whose samples
agree often enough is a candidate (one of similarity 0.8 falls short with a probability of 1e-4). Candidates make groups.
In a group the exact weighted Jaccard similarity of whole texts is computed for candidate pairs, likeliest first, and
what is joined already is not compared again: first inside blocks of bounded size that all hold the group's smallest
node as well, so a group of copies costs about one comparison per text; then, for groups that are still in pieces,
between all blocks, so no candidate that could join two classes is skipped.

Defined cases: a null or empty text is a class of its own; equal rows are one class, of which one row is kept; the class
of a text is its smallest doc_id (null before all); a very long text is one row of its own size; other columns, whatever
their names, are kept by `filter_documents`.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import ascii_words, bounded_batches, drop_written, plain, squeezed, written
from ledgerloom.llm.links import components, groups_of, in_units, join_counted
from ledgerloom.llm.shingles import in_portions, mixed, runs, signed, word_hashes_of

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 16, 3
HASHES = BANDS * ROWS
#: Of HASHES samples so many agree in a candidate pair.
AGREE = 28
TABLE_BITS = 15
#: The most frequent words, whose frequencies every task holds, and the words whose partial counts a task holds at once.
COMMON, HELD = 50_000, 1_000_000
#: What gives inverse document frequencies for word hashes.
Weights = Callable[[np.ndarray], np.ndarray]


@lru_cache(1)
def sampling_tables() -> list[tuple[np.ndarray, ...]]:
    """For each sample: an odd multiplier that picks a table row from a shingle's hash, and the sample's random variables by row."""
    rng = np.random.default_rng(20_240_229)
    out = []
    for _ in range(HASHES):
        size = 2**TABLE_BITS
        r, c, beta = rng.gamma(2, 1, size), rng.gamma(2, 1, size), rng.random(size)
        out.append((np.uint64(rng.integers(2**62) * 2 + 1), *(x.astype(np.float32) for x in (1 / r, beta, r, np.log(c) + r * beta - r))))
    return out


def weighted_shingles_of(texts: list[str | None], idf: Weights) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted shingle hashes and their weights for each of some texts."""
    words, counts = word_hashes_of(texts)
    value = idf(words)
    begin = np.cumsum(counts) - counts
    whole = counts >= SHINGLE
    n = max(len(words) - SHINGLE + 1, 0)
    hashes = runs(words, SHINGLE)
    mean = sum(value[i : i + n] for i in range(SHINGLE)) / SHINGLE
    # runs inside a text, sorted text by text
    order = [np.argsort(hashes[b : b + c]) + b for b, c in zip(begin[whole].tolist(), (counts[whole] - SHINGLE + 1).tolist())]
    order = np.concatenate([np.zeros(0, dtype=np.int64), *order])
    hashes, mean = hashes[order], mean[order]
    bounds = np.cumsum(np.r_[0, counts[whole] - SHINGLE + 1])
    fresh = np.ones(len(order) + 1, dtype=bool)
    fresh[1:-1] = hashes[1:] != hashes[:-1]
    fresh[bounds] = True
    first = np.flatnonzero(fresh)
    weights = mean[first[:-1]] * np.diff(first)
    hashes, cuts = hashes[first[:-1]], np.searchsorted(first, bounds)
    of = iter(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
    out = []
    for b, c, enough in zip(begin.tolist(), counts.tolist(), whole.tolist()):
        if enough:
            i, j = next(of)
            out.append((hashes[i:j], weights[i:j]))
        else:  # all words of a short text
            out.append((runs(words[b : b + c], c), np.atleast_1d(value[b : b + c].mean())) if c else (np.zeros(0, dtype=np.uint64), np.zeros(0)))
    return out


def weighted_shingles(text: str | None, idf: Weights) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingle hashes of a text and their weights."""
    return weighted_shingles_of([text], idf)[0]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity: the sum of smaller weights over the sum of greater ones."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    whole = a[1].sum() + b[1].sum() - both
    return float(both / whole) if whole else 0.0


def samples(shingles: list[np.ndarray], weights: list[np.ndarray]) -> np.ndarray:
    """The samples of several texts (none empty) as 32-bit numbers, one row per text."""
    sizes = np.array([len(x) for x in shingles])
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    key, log_w = np.concatenate(shingles), np.log(np.concatenate(weights)).astype(np.float32)
    of = np.repeat(np.arange(len(sizes)), sizes)
    out = np.empty((len(sizes), HASHES), dtype=np.uint32)
    # memory that all samples share: asking for it anew costs more than the arithmetic
    at, (step, x, log_a) = np.empty(len(key), dtype=np.uint64), np.empty((3, len(key)), dtype=np.float32)
    with np.errstate(over="ignore"):
        for h, (odd, inverse, beta, r, constant) in enumerate(sampling_tables()):
            np.right_shift(np.multiply(key, odd, out=at), np.uint64(64 - TABLE_BITS), out=at)
            row = signed(at)
            np.multiply(log_w, np.take(inverse, row, out=x, mode="clip"), out=step)
            np.floor(np.add(step, np.take(beta, row, out=x, mode="clip"), out=step), out=step)
            np.multiply(np.take(r, row, out=x, mode="clip"), step, out=x)
            np.subtract(np.take(constant, row, out=log_a, mode="clip"), x, out=log_a)
            hits = np.flatnonzero(log_a == np.minimum.reduceat(log_a, starts)[of])
            chosen = hits[np.searchsorted(hits, starts)]
            out[:, h] = mixed(key[chosen] * np.uint64(2 * h + 3) + step[chosen].astype(np.int64).view(np.uint64)) >> np.uint64(32)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each text."""
    bands = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), bands.shape[:2])
    with np.errstate(over="ignore"):
        for i in range(ROWS):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, i])
    return key


def distinct_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words of each text as signed hashes, and the number of the text each is of."""
    words, counts = word_hashes_of(texts)
    words, of = signed(words), np.repeat(np.arange(len(texts)), counts)
    order = np.lexsort((words, of))
    words, of = words[order], of[order]
    fresh = np.ones(len(words), dtype=bool)
    fresh[1:] = (words[1:] != words[:-1]) | (of[1:] != of[:-1])
    return words[fresh], of[fresh]


def summed(words: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each word once, with the sum of its counts."""
    found, at = np.unique(np.concatenate(words), return_inverse=True)
    return found, np.bincount(at, np.concatenate(counts), minlength=len(found)).astype(np.int64)


def document_frequencies(docs: DataFrame) -> DataFrame:
    """A written table: word (its hash), n: in how many documents it stands. Tasks count what they read before anything is shuffled."""

    def tally(batches):
        words, counts, size = [], [], 0
        for pdf in batches:
            for texts in in_portions(pdf["text"]):
                found, n = np.unique(distinct_words(texts)[0], return_counts=True)
                words, counts, size = [*words, found], [*counts, n], size + len(found)
                if size > HELD:
                    found, n = summed(words, counts)
                    if len(found) > HELD // 2:
                        yield pd.DataFrame({"word": found, "n": n})
                        found, n = found[:0], n[:0]
                    words, counts, size = [found], [n], len(found)
        if size:
            found, n = summed(words, counts)
            yield pd.DataFrame({"word": found, "n": n})

    return written(docs.select("text").mapInPandas(tally, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "frequencies")


def common_words(frequencies: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The COMMON most frequent words, sorted by hash, and their frequencies."""
    top = frequencies.orderBy(F.desc("n"), "word").limit(COMMON).toPandas().sort_values("word")
    return top["word"].to_numpy(dtype=np.int64), top["n"].to_numpy(dtype=np.int64)


def looked_up(words: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The values of words among sorted keys, 0 for those that are not there."""
    if not len(keys):
        return np.zeros(len(words), dtype=np.int64)
    at = np.minimum(np.searchsorted(keys, words), len(keys) - 1)
    return np.where(keys[at] == words, values[at], 0)


def mean_weight(frequencies: DataFrame, common: tuple[np.ndarray, np.ndarray], total: int) -> float:
    """The mean inverse document frequency of the occurrences of all words that are no more frequent than the common ones."""
    most = int(common[1].min()) if len(common[1]) else 0
    idf = 1 + F.log((1.0 + total) / (1.0 + F.col("n")))
    return frequencies.where(F.col("n") <= most).agg(F.sum(idf * F.col("n")) / F.sum("n")).first()[0] or 1.0


def draw_weights(common: tuple[np.ndarray, np.ndarray], mean: float, total: int) -> Weights:
    """Inverse document frequencies for drawing samples: exact for common words, the mean for all others."""

    def weigh(words: np.ndarray) -> np.ndarray:
        n = looked_up(signed(words), *common)
        return np.where(n > 0, 1 + np.log((1 + total) / (1 + n)), mean)

    return weigh


def rare_words(texts: DataFrame, frequencies: DataFrame, common) -> DataFrame:
    """A written table: node, its words that are not common (word) and their frequencies (seen)."""

    def rare(batches):
        for pdf in batches:
            begin = 0
            for part in in_portions(map(plain, pdf["packed"])):
                words, of = distinct_words(part)
                left = looked_up(words, *common.value) == 0
                yield pd.DataFrame({"node": pdf["node"].to_numpy()[begin + of[left]], "word": words[left]})
                begin += len(part)

    pairs = texts.select("node", "packed").mapInPandas(rare, "node long, word long").join(frequencies, "word")
    of_node = pairs.groupBy("node").agg(F.collect_list(F.struct("word", "n")).alias("rare"))
    return written(of_node.select("node", F.col("rare.word").alias("word"), F.col("rare.n").alias("seen")), "rare")


def exact_weights(common: tuple[np.ndarray, np.ndarray], word, seen, total: int) -> Weights:
    """Inverse document frequencies of a text's words, from the common ones and those of its own."""
    word, seen = (np.asarray([] if x is None else x, dtype=np.int64) for x in (word, seen))
    order = np.argsort(word)
    word, seen = word[order], seen[order]

    def weigh(words: np.ndarray) -> np.ndarray:
        n = looked_up(signed(words), *common) + looked_up(signed(words), word, seen)
        if not n.all():
            raise ValueError("a word without a document frequency")
        return 1 + np.log((1 + total) / (1 + n))

    return weigh


def signatures(docs: DataFrame, common, mean: float, total: int) -> DataFrame:
    """A written table: row, doc_id, key (hash of the text), word_key (of its words; null without words), signature, bands."""

    def sign(text: pd.Series) -> pd.DataFrame:
        out, idf = [], draw_weights(common.value, mean, total)
        for texts in in_portions(text):
            found = weighted_shingles_of(texts, idf)
            worded = [n for n, (s, _) in enumerate(found) if len(s)]
            rows = [[None, None, None] for _ in texts]
            if worded:
                signature = samples([found[n][0] for n in worded], [found[n][1] for n in worded])
                for n, sig, bands in zip(worded, signature, signed(band_keys(signature))):
                    rows[n] = [xxhash.xxh3_128_hexdigest(b" ".join(ascii_words(texts[n]))), sig.tobytes(), bands]
            out += rows
        return pd.DataFrame(out, columns=["word_key", "signature", "bands"])

    made = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("key"), F.pandas_udf(sign, "word_key string, signature binary, bands array<long>")("text").alias("x"))
    return written(made.select("row", "doc_id", "key", "x.*"), "signatures")


def spanning(agree: np.ndarray, near: np.ndarray) -> list[tuple[int, int]]:
    """Edges of the spanning forest of `near` with the greatest agreement; it grows from the node that agrees most with all, so copies hang on their original."""
    weight = np.where(near, agree, 0)
    sums, best, parent = weight.sum(axis=1), np.zeros(len(near), dtype=np.int64), np.full(len(near), -1)
    left, out = sums > 0, []
    while left.any():
        at = int(np.where(left, best, -1).argmax())
        if best[at] == 0:
            at = int(np.where(left, sums, -1).argmax())
        else:
            out.append((int(parent[at]), at))
        left[at] = False
        better = left & (weight[at] > best)
        best[better], parent[better] = weight[at][better], at
    return out


def agreement(signatures: list[bytes]) -> np.ndarray:
    """In how many samples each pair agrees."""
    sig = np.frombuffer(b"".join(signatures), dtype=np.uint32).reshape(len(signatures), HASHES)
    if len(sig) <= 32:
        return (sig[:, None] == sig[None]).sum(axis=2, dtype=np.int16)
    out = np.zeros((len(sig), len(sig)), dtype=np.int16)
    for column in sig.T:
        out += column[:, None] == column[None, :]
    return out


def edges_frame(node: np.ndarray, edges: list[tuple[int, int]]) -> pd.DataFrame:
    i, j = np.array(edges, dtype=np.int64).reshape(-1, 2).T
    return pd.DataFrame({"a": np.minimum(node[i], node[j]), "b": np.maximum(node[i], node[j])})


def candidates(units: DataFrame) -> DataFrame:
    """a, b: a spanning forest of each bucket's pairs that agree in AGREE samples."""

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node").reset_index(drop=True)
        signature, node, out = pdf["signature"].tolist(), pdf["node"].to_numpy(), []
        for g in groups_of(pdf, "_bucket", "_left", "_right"):
            agree = agreement([signature[k] for k in g])
            near = agree >= AGREE
            np.fill_diagonal(near, False)
            if near.any():
                out += [(g[i], g[j]) for i, j in spanning(agree, near)]
        return edges_frame(node, out).drop_duplicates()

    return units.groupBy("_unit").applyInPandas(find, "a long, b long").distinct()


def verified(units: DataFrame, common, total: int) -> DataFrame:
    """a, b: pairs whose weighted Jaccard similarity reaches the threshold, enough of them to join all that any such candidate joins. Pairs that agree most come first, and what is joined already (equal labels) is not compared."""

    def check(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node").reset_index(drop=True)
        signature, packed, word, seen = (pdf[c].tolist() for c in ("signature", "packed", "word", "seen"))
        node, label, out = pdf["node"].to_numpy(), pdf["label"].to_numpy(), []
        for g in groups_of(pdf, "_bucket", "_left", "_right"):
            agree = np.triu(agreement([signature[k] for k in g]), 1)
            i, j = np.nonzero(agree >= AGREE)
            order = np.argsort(-agree[i, j], kind="stable")
            shingles, root = {}, np.unique(label[g], return_inverse=True)[1]
            for x, y in zip(i[order].tolist(), j[order].tolist()):
                if root[x] == root[y]:
                    continue
                for n in (x, y):
                    if n not in shingles:
                        shingles[n] = weighted_shingles(plain(packed[g[n]]), exact_weights(common.value, word[g[n]], seen[g[n]], total))
                if similarity(shingles[x], shingles[y]) >= THRESHOLD:
                    out.append((g[x], g[y]))
                    root[root == root[y]] = root[x]
        return edges_frame(node, out)

    return units.groupBy("_unit").applyInPandas(check, "a long, b long").distinct()


def with_smallest(groups: DataFrame, block: int = 256, unit: int = 1_000) -> DataFrame:
    """node, label (itself), _bucket, _left, _right, _unit: each group cut into blocks that all hold its smallest node."""
    sizes = groups.groupBy("group").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.min("node").alias("least"))
    sized = groups.join(sizes, "group")
    own = sized.where("node <> least").select("group", "node", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int").alias("_left"))
    first = sizes.select("group", F.col("least").alias("node"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_left"))
    rows = own.unionByName(first)
    units = max(1, groups.count() // unit)
    return rows.select("node", F.col("node").alias("label"), F.xxhash64("group").alias("_bucket"), "_left", F.col("_left").alias("_right"), F.pmod(F.xxhash64("group", "_left"), F.lit(units)).alias("_unit"))


def joined(groups: DataFrame, weighed: DataFrame, common, total: int) -> DataFrame:
    """A written table: node, root, for the groups (node, group) what verified candidates join."""
    content = weighed.select("node", "signature", "packed", "word", "seen")
    edges = written(verified(with_smallest(groups).join(content, "node"), common, total), "verified")
    labels = written(groups.join(components(edges), "node", "left").select("node", "group", F.coalesce("root", "node").alias("label")), "labels")
    pieces = labels.groupBy("group").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("group")
    left = written(labels.join(pieces, "group"), "pieces")
    if left.isEmpty():
        return labels.select("node", F.col("label").alias("root"))
    blocks = in_units(left, ["group"], "node", unit=1_000).drop("group")
    return written(components(written(edges.unionByName(verified(blocks.join(content, "node"), common, total)), "verified")), "roots")


def classes(docs: DataFrame) -> DataFrame:
    """row, doc_id, key, class_id and kept for every document, where kept marks one row of each class."""
    bounded_batches(docs.sparkSession)
    spark, total = docs.sparkSession, docs.count()
    frequencies = document_frequencies(docs)
    top = common_words(frequencies)
    common = spark.sparkContext.broadcast(top)  # COMMON words at most
    rows = signatures(docs, common, mean_weight(frequencies, top, total), total)
    worded = rows.where("word_key is not null")
    firsts = written(worded.groupBy("word_key").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("n")).select("word_key", "n", F.col("first.row").alias("node"), F.col("first.doc_id").alias("node_id")), "nodes")
    nodes = written(worded.join(firsts.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("node"), "doc_id", "key", "signature", "bands"), "nodes")

    members = in_units(nodes.select("node", F.posexplode("bands").alias("band", "value")), ["band", "value"], "node")
    units = members.join(nodes.select("node", "signature"), "node").drop("band", "value")
    pairs = written(candidates(units), "pairs")

    # texts that candidates join, directly or not, are one group; inside it every candidate pair is verified
    groups = written(components(pairs).withColumnRenamed("root", "group"), "groups")
    wanted = nodes.join(groups, "node").select("node", "signature", F.col("doc_id").alias("of"), F.col("key").alias("at"))
    packed = docs.select("doc_id", F.xxhash64("text").alias("key"), F.pandas_udf(squeezed, "binary")("text").alias("packed"))
    found = packed.join(wanted, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("at")))
    texts = written(found.groupBy("node").agg(F.any_value("signature").alias("signature"), F.any_value("packed").alias("packed")), "texts")
    drop_written(nodes)
    weighed = texts.join(rare_words(texts, frequencies, common), "node", "left")
    drop_written(frequencies)
    roots = joined(groups, weighed, common, total)
    drop_written(texts)

    rooted = firsts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = rooted.groupBy("root").agg(F.min(F.struct("node_id", "node")).alias("best"))
    of = rooted.join(best, "root").select("word_key", F.col("best.node_id").alias("class_id"), F.col("best.node").alias("keeper"))
    known = join_counted(worded.select("row", "doc_id", "key", "word_key"), written(of, "classes"), ["word_key"], firsts.select("word_key", "n"))
    judged = known.select("row", "doc_id", "key", "class_id", (F.col("row") == F.col("keeper")).alias("kept"))
    alone = rows.where("word_key is null").select("row", "doc_id", "key", F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"))
    return judged.unionByName(alone)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, kept: one row per document."""
    return classes(docs).select("doc_id", "class_id", "kept")


def filter_documents(docs: DataFrame) -> DataFrame:
    """One document of each class, with all columns; a text without words stays. Here texts go through the join as they are: to squeeze them and back would keep two Python workers for every task."""
    judged = written(classes(docs), "judged")
    of_key = judged.groupBy(F.col("doc_id").alias("of"), F.col("key").alias("at")).agg(F.count_if("kept").alias("kept"), F.count("*").alias("rows"))
    same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("at"))
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", F.xxhash64("text").alias("key"))
    left = keyed.join(written(of_key.where("kept = 0").select("of", "at"), "dropped"), same, "left_anti")
    # rows that repeat a kept one exactly: all but one go
    repeated = written(of_key.where("kept > 0 and kept < rows").select("of", "at"), "repeated")
    if not repeated.isEmpty():
        again = left.join(repeated, same, "left_semi").groupBy("doc_id", "key").agg(F.any_value("row").alias("row"))
        left = left.join(repeated, same, "left_anti").unionByName(again.select("row", "doc_id", "key"))
    return left.select("row.*")
