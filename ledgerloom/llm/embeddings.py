"""Near-duplicate vectors by iterative quantisation.

Equal vectors with equal labels are one node from the start. Vectors are scaled to length 1 and the mean of a bounded sample
is subtracted, so that codes are balanced wherever the vectors lie. Rotations learned on the sample turn what is left into
bits (each rotation alternates between the signs of the rotated sample and the rotation that brings the sample closest to
them). The bits are cut into keys, one Hamming table per key: two vectors meet where they agree on a whole key, and are
candidates if the bits of their codes differ in no more places than those of two vectors at the threshold do. How many that are follows from
both distances to the mean, as does the angle that the mean sees between them (MARGIN standard deviations are allowed).
Only codes go through the tables. Candidates make groups, and the members of a group, cut into blocks of bounded size, are
compared with their original vectors in double precision. Key width and number of tables are those with the least work at
which a pair at the threshold meets nowhere with a probability of MISS at most, if its bits differ independently and its
vectors are no nearer to the mean than all but a hundredth of the sample. Vectors so near to the mean that it may see
linked ones at a right angle also meet, in one more bucket, all that can be linked to them.

Only vectors with equal labels and equal lengths are compared; each of the LENGTHS commonest lengths has a mean and
rotations of its own, the others have random rotations about the origin. Defined cases: vectors that are null, empty,
zero, or hold null or non-finite components link with nothing, as do those with a null label; repeated rows are vectors of
their own; the component of a vector is the smallest vec_id it reaches. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import drop_written, written
from ledgerloom.llm.links import components, forest, groups_of, in_units, join_counted

THRESHOLD, MISS, MARGIN = 0.98, 0.001, 5.0
#: At most so many vectors (picked by a hash of what they hold) learn the rotations, for so many lengths; every vector is indexed.
SAMPLE, LENGTHS, ROUNDS = 10_000, 16, 30
#: The share of the sample that may be nearer to the mean than the tables are made for; and what looking up a table costs, in comparisons of codes.
NEARER, LOOKUP = 0.01, 64
#: Bits of a code that candidates are judged by; keys may need more bits, which no row carries.
CODE_BITS = 512


def apart(threshold: float) -> float:
    """The distance between two vectors of length 1 whose cosine is the threshold."""
    return math.sqrt(2 - 2 * threshold)


def differing(a, b, threshold: float = THRESHOLD):
    """The share of bits in which two vectors at the threshold differ, if they lie at distances a and b from the mean; -1 where vectors so far apart from each other can't be linked."""
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where((a > 0) & (b > 0), (a * a + b * b - (2 - 2 * threshold)) / (2 * a * b), -1.0)
    return np.where(np.abs(a - b) > apart(threshold) + 1e-6, -1.0, np.arccos(np.clip(cosine, -1, 1)) / np.pi)


def tables_for(count: int, share: float, miss: float = MISS) -> tuple[int, int]:
    """(bits of a key, number of tables) for so many vectors, if two at the threshold differ in this share of their bits."""

    def tables(bits: int) -> int:
        agree = (1 - share) ** bits
        return 1 if agree >= 1 else math.ceil(math.log(miss) / math.log1p(-agree)) if agree > 1e-9 else 10**12

    bits = min(range(63), key=lambda b: tables(b) * (LOOKUP + count / 2**b))
    return bits, tables(bits)


def most_different(bits: int, share):
    """In how many of so many bits two candidates may differ, if vectors at the threshold differ in this share of them."""
    return np.ceil(bits * share + MARGIN * np.sqrt(bits * np.clip(share * (1 - share), 0, 1)))


def learn_rotation(x: np.ndarray, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """Principal axes of x, turned until the signs of the turned x are close to it."""
    _, axes = np.linalg.eigh(x.T @ x)
    rng = np.random.default_rng(seed)
    turn, _ = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))
    v = x @ axes
    for _ in range(rounds):
        left, _, right = np.linalg.svd(v.T @ np.where(v @ turn >= 0, 1.0, -1.0))
        turn = left @ right
    return axes @ turn


def learn(x: np.ndarray, bits: int) -> np.ndarray:
    """A matrix with one column per bit, for vectors from which the mean was subtracted."""
    turns = [learn_rotation(x, n) for n in range(-(-bits // x.shape[1]))]
    return np.concatenate(turns, axis=1)[:, :bits] if turns else np.zeros((x.shape[1], 0))


def unlearned(length: int, bits: int) -> np.ndarray:
    """Random rotations for vectors of a rare length."""
    rng = np.random.default_rng(length)
    turns = [np.linalg.qr(rng.standard_normal((length, length)))[0] for _ in range(-(-bits // length))]
    return np.concatenate(turns, axis=1)[:, :bits] if turns else np.zeros((length, 0))


class Index:
    """Means, rotations, and the shape of the tables, learned on a sample."""

    def __init__(self, sample: list[np.ndarray], count: int, threshold: float = THRESHOLD):
        """sample: for each of some lengths an array of vectors; count: how many vectors there are."""
        units = {x.shape[1]: unit_rows(pd.Series(list(x))) for x in sample if len(x) > 1}
        self.threshold, self.means = threshold, {n: x.mean(axis=0) for n, x in units.items()}
        centred = {n: x - self.means[n] for n, x in units.items()}
        near = [float(np.quantile(np.linalg.norm(x, axis=1), NEARER)) for x in centred.values()]
        share = max([float(differing(np.float64(r), np.float64(r), threshold)) for r in [*near, 1.0]])
        self.bits, self.tables = tables_for(count, share)
        self.turns = {n: learn(x, self.bits * self.tables) for n, x in centred.items()}

    def place(self, v: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        """For vectors of one length: their bits, and their distances to the mean."""
        x = unit_rows(v)
        n = x.shape[1]
        known = n in self.turns
        y = x - self.means[n] if known else x
        return y @ (self.turns[n] if known else unlearned(n, self.bits * self.tables)) >= 0, np.linalg.norm(y, axis=1)

    def near(self, code: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Which codes (rows of bits) are candidates of each other, given their vectors' distances to the mean."""
        own = code.astype(np.float32)
        ones = own.sum(axis=1)
        different = ones[:, None] + ones[None, :] - 2 * (own @ own.T)
        share = differing(far[:, None], far[None, :], self.threshold)
        return (share >= 0) & (different <= most_different(code.shape[1], share))


def usable(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two written tables: row, vec_id, node (null where the vector links with nothing); and the nodes: node, label, v, copies."""
    v = F.col("embedding")
    number = v.cast("array<double>")
    bad = F.exists(number, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    norm = F.sqrt(F.aggregate(number, F.lit(0.0), lambda acc, c: acc + c * c))
    good = F.when(v.isNotNull() & (F.size(v) > 0) & ~bad & F.col("label").isNotNull() & (norm > 0) & (norm < float("inf")), v)
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", good.alias("v"))
    # two hashes with different seeds, 128 bits, tell vectors apart
    rows = written(rows.withColumns({"h": F.xxhash64("label", "v"), "i": F.xxhash64(F.lit(7), "v")}), "vectors")
    same = rows.where("v is not null").groupBy("label", "h", "i").agg(F.min("row").alias("node"), F.count("*").alias("copies"), F.any_value("v").alias("v"))
    nodes = written(same, "nodes")
    keys = ["label", "h", "i"]
    of = join_counted(rows.where("v is not null").select("row", "vec_id", *keys), nodes.select(*keys, "node"), keys, nodes.select(*keys, F.col("copies").alias("n")))
    rest = rows.where("v is null").select("row", "vec_id", F.lit(None).cast("long").alias("node"))
    known = written(of.select("row", "vec_id", "node").unionByName(rest), "members")
    drop_written(rows)
    return known, nodes.select("node", "label", "v", "copies", F.xxhash64("v").alias("h"))


def unit_rows(v) -> np.ndarray:
    x = np.array(v.tolist(), dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fitted(nodes: DataFrame, threshold: float) -> Index:
    lengths = [r.n for r in nodes.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(LENGTHS).collect()]
    sample = nodes.where(F.size("v").isin(lengths)).orderBy("h", "node").limit(SAMPLE).select("v").toPandas()["v"]
    arrays = [np.array(x, dtype=np.float64) for n in lengths if (x := [v for v in sample if len(v) == n])]
    return Index(arrays, nodes.count(), threshold)


def codes(nodes: DataFrame, index: Index) -> DataFrame:
    """A written table: node, label, length, code (the first CODE_BITS bits, packed), keys (one for each table) and far, the distance to the mean."""
    shared = nodes.sparkSession.sparkContext.broadcast(index)  # LENGTHS models of bits * tables columns

    def place(v: pd.Series) -> pd.DataFrame:
        size, code, keys, far = v.map(len).to_numpy(), np.empty(len(v), dtype=object), np.empty(len(v), dtype=object), np.zeros(len(v))
        for n in np.unique(size).tolist():
            at = np.flatnonzero(size == n)
            signs, far[at] = shared.value.place(v.iloc[at])
            numbers = signs.reshape(len(at), index.tables, index.bits) @ (1 << np.arange(index.bits, dtype=np.int64))
            for k, packed, key in zip(at, np.packbits(signs[:, :CODE_BITS], axis=1), numbers):
                code[k], keys[k] = packed.tobytes(), key
        return pd.DataFrame({"code": code, "keys": keys, "far": far})

    found = nodes.select("node", "label", F.size("v").alias("length"), F.pandas_udf(place, "code binary, keys array<long>, far double")("v").alias("x"))
    return written(found.select("node", "label", "length", "x.*"), "codes")


def candidates(indexed: DataFrame, index: Index) -> DataFrame:
    """a, b: pairs that meet in a table and whose codes are near, a spanning forest of each bucket's."""
    shared, bits = indexed.sparkSession.sparkContext.broadcast(index), min(index.bits * index.tables, CODE_BITS)
    tables = indexed.select("node", "label", "length", "code", "far", F.posexplode("keys").alias("at", "key"))
    core = apart(index.threshold) / math.sqrt(2)
    if not indexed.where(F.col("far") <= core).isEmpty():
        around = indexed.where(F.col("far") <= core + apart(index.threshold))
        tables = tables.unionByName(around.select("node", "label", "length", "code", "far", F.lit(-1).alias("at"), F.lit(0).cast("long").alias("key")))
    members = in_units(tables, ["label", "length", "at", "key"], "node")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out, node, far = [], pdf["node"].to_numpy(), pdf["far"].to_numpy()
        code = pdf["code"].tolist()
        for g in groups_of(pdf, "_bucket", "_left", "_right"):
            own = np.unpackbits(np.frombuffer(b"".join(code[k] for k in g), dtype=np.uint8).reshape(len(g), -1), axis=1)[:, :bits]
            near = shared.value.near(own, far[g])
            np.fill_diagonal(near, False)
            if near.any():
                out += [(node[g[i]], node[g[j]]) for i, j in forest(near)]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64").drop_duplicates()

    return members.select("node", "code", "far", "_bucket", "_left", "_right", "_unit").groupBy("_unit").applyInPandas(compare, "a long, b long").distinct()


def links(nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """node, other, n. Where other is null, n counts the vectors linked to node's (copies counted); else the two are linked, and these pairs join all that the links join."""
    index = fitted(nodes, threshold)
    indexed = codes(nodes, index)
    pairs = written(candidates(indexed, index), "pairs")
    drop_written(indexed)
    groups = written(components(pairs).withColumnRenamed("root", "group"), "groups")
    drop_written(pairs)
    blocks = in_units(groups, ["group"], "node", unit=250).drop("group")
    payload = blocks.join(nodes.select("node", "label", "v", "copies"), "node")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out, node, block, copies, label = [], pdf["node"].to_numpy(), pdf["_block"].to_numpy(), pdf["copies"].to_numpy(), pd.factorize(pdf["label"])[0]
        for g in groups_of(pdf, "_bucket", "_left", "_right"):
            x = unit_rows(pdf["v"].iloc[g])
            near = (x @ x.T >= threshold) & (label[g][:, None] == label[g][None, :])
            np.fill_diagonal(near, False)
            if pdf["_left"].iat[g[0]] != pdf["_right"].iat[g[0]]:
                near &= block[g][:, None] != block[g][None, :]
            degree = near @ copies[g]
            out += [(node[g[k]], None, degree[k]) for k in np.flatnonzero(degree)]
            out += [(node[g[a]], node[g[b]], 0) for a, b in forest(near)]
        return pd.DataFrame(out, columns=["node", "other", "n"]).astype({"node": "int64", "other": "Int64", "n": "int64"})

    return written(payload.groupBy("_unit").applyInPandas(compare, "node long, other long, n long"), "links")


def deduplicate(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per vector."""
    members, nodes = usable(vectors)
    found = links(nodes, threshold)
    degrees = found.where("other is null").groupBy("node").agg(F.sum("n").alias("n"))
    roots = components(found.where("other is not null").select("node", F.col("other")), "node", "other")
    least = members.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    placed = least.join(degrees, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = written(placed, "rooted")
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of = written(placed.join(smallest, "root").select("node", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "components")
    linked = join_counted(members.where("node is not null"), of, ["node"], nodes.select("node", F.col("copies").alias("n")))
    none = F.lit(None)
    alone = members.where("node is null").withColumns({"component_id": none.cast(linked.schema["component_id"].dataType), "n_links": none.cast("long")})
    out = linked.unionByName(alone)
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
