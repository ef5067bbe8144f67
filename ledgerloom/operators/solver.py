"""Allocating debits to credits in many-to-many vouchers.

The larger side drives. Drivers are taken by ascending amount; each is covered either by whole buckets that sum to it or
by whole buckets and a part of one more, in a fixed order, and what is left of the buckets goes to the next driver. A
second search first pairs equal amounts. The work is in whole cents. Sets of buckets with a given sum are found by halves
(subsets.py), and what the last driver can take is counted, not listed: only taking all that is left can be a solution.

The work is bounded by a number of visited nodes and of tried sets of buckets, not by a clock, so results are the same
everywhere. Spark deals the distinct ledgers over tasks. A ledger that one search does not finish is dealt again: the
first driver's ways become rows, each is searched with a budget of its own, and the results are merged in the order of the
ways, so they do not depend on how many tasks there are. A ledger that needs more still has the status budget and the
solutions found until then; who asks for whole searches has them go on without a budget, for each ledger and start in a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from math import inf

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.config import SENSITIVE
from ledgerloom.functions import scalars as S
from ledgerloom.operators import subsets
from ledgerloom.operators.subsets import FEW, chosen_of, chosen_without, count_summing, every_sum, summing_to
from ledgerloom.shared import numbered, written

MAX_SOLUTIONS, MAX_NODES = 200, 20_000
#: Sets of buckets that one search may try, for all its drivers together (a second or two).
MAX_TRIED = 2_000_000
#: Ways of the first driver that are searched one by one where one search was not enough.
MAX_BRANCHES = 400
LINKS = "array<struct<d_subject:string,d_sign:string,c_subject:string,c_sign:string,cents:long>>"
Key = tuple[str, str]
Side = list[tuple[Key, int]]
Way = dict[Key, int]


class Spent(Exception):
    """The budget is used up."""


class Budget:
    def __init__(self, nodes: float, tried: float = MAX_TRIED):
        self.nodes, self.tried, self.spent = nodes, tried, False

    def use(self, nodes: int = 0, tried: int = 0) -> None:
        self.nodes -= nodes
        self.tried -= tried
        if self.nodes < 0 or self.tried < 0:
            self.spent = True
            raise Spent

    def sets(self, n: int) -> None:
        self.use(tried=n)


@lru_cache(10_000)
def _sensitive(key: Key) -> bool:
    return any(w in key[0] for w in SENSITIVE)


def _part_of(key: Key, target: int, bucket: tuple[Key, int], within: bool) -> tuple[int, int, tuple[int, ...]]:
    """The least and the greatest amount that a driver may take of a bucket it does not take whole, and amounts in between that it may not."""
    name, room = bucket
    lo, hi, but = -10 * abs(target), 10 * abs(target), (0,)
    if within:
        lo, hi = (max(lo, 1), min(hi, room - 1)) if room > 0 else (max(lo, room + 1), min(hi, -1))
    elif _sensitive(name):
        lo, hi = (max(lo, -room), min(hi, room - 1)) if room > 0 else (max(lo, room + 1), min(hi, -1))
    else:
        but = (0, room)
    if _sensitive(key):
        lo, hi = (max(lo, 1), hi) if target > 0 else (lo, min(hi, -1))
    return lo, hi, but


def _whole(key: Key, target: int, buckets: Side) -> list[int]:
    """The buckets that a driver may take whole: a sensitive account takes none of the opposite sign."""
    return [k for k, (_, x) in enumerate(buckets) if not _sensitive(key) or target * x >= 0]


def covers(key: Key, target: int, buckets: Side, budget: Budget, within: bool = False) -> Iterator[Way]:
    """Ways to cover a driver's target, whole buckets first. With `within`, no more than a bucket holds is taken of it."""
    if len(buckets) <= subsets.FEW:
        yield from _covers_few(key, target, buckets, budget, within)
        return
    whole = _whole(key, target, buckets)
    take = lambda places: {buckets[k][0]: buckets[k][1] for k in places}
    for chosen in summing_to([buckets[k][1] for k in whole], target, target, 1, budget.sets):
        yield take(whole[c] for c in chosen)
    for i, bucket in enumerate(buckets):
        lo, hi, but = _part_of(key, target, bucket, within)
        others = [k for k in whole if k != i]
        for chosen in summing_to([buckets[k][1] for k in others], target - hi, target - lo, 0, budget.sets):
            part = target - sum(buckets[others[c]][1] for c in chosen)
            if part not in but:
                yield take(others[c] for c in chosen) | {bucket[0]: part}


def _covers_few(key: Key, target: int, buckets: Side, budget: Budget, within: bool) -> Iterator[Way]:
    """covers() where the sums of all sets of buckets are listed at once."""
    n, not_whole, tried = len(buckets), 0, 0
    sums = every_sum([x for _, x in buckets])
    if _sensitive(key):
        not_whole = sum(1 << k for k, (_, x) in enumerate(buckets) if target * x < 0)
    if target in sums:
        for at, (mask, chosen) in enumerate(chosen_of(n, 1), 1):
            if sums[mask] == target and not mask & not_whole:
                budget.sets(at - tried)
                tried = at
                yield {buckets[k][0]: buckets[k][1] for k in chosen}
    budget.sets(2**n - 1 - tried)
    for i, bucket in enumerate(buckets):
        (lo, hi, but), name, tried = _part_of(key, target, bucket, within), bucket[0], 0
        for at, (mask, chosen) in enumerate(chosen_without(n, i), 1):
            part = target - sums[mask]
            if lo <= part <= hi and part not in but and not mask & not_whole:
                budget.sets(at - tried)
                tried = at
                way = {buckets[k][0]: buckets[k][1] for k in chosen}
                way[name] = part
                yield way
        budget.sets(2 ** (n - 1) - tried)


def _count_last(target: int, left: Side) -> tuple[int, int] | None:
    """count_covers() of a driver that takes all that is left, where all of it has the driver's sign: only all of it is whole, and of an account that is not sensitive every part is allowed with every set of the others but all of them."""
    if not (all(x > 0 for _, x in left) if target > 0 else all(x < 0 for _, x in left)):
        return None
    return 1, 1 + (2 ** (len(left) - 1) - 1) * sum(not _sensitive(name) for name, _ in left)


def count_covers(key: Key, target: int, buckets: Side, budget: Budget) -> tuple[int, int]:
    """How many ways covers() has, of whole buckets only, and in all."""
    whole = _whole(key, target, buckets)
    if len(whole) <= FEW // 2:
        return _count_few(key, target, buckets, whole, budget)
    full = count_summing([buckets[k][1] for k in whole], [(target, target)], budget.sets)[0] - (target == 0)
    n = full
    for i, bucket in enumerate(buckets):
        lo, hi, but = _part_of(key, target, bucket, False)
        not_these = {x for x in but if lo <= x <= hi}
        ranges = [(target - hi, target - lo), *((target - x, target - x) for x in not_these)]
        every, *less = count_summing([buckets[k][1] for k in whole if k != i], ranges, budget.sets)
        n += every - sum(less)
    return full, n


def _count_few(key: Key, target: int, buckets: Side, whole: list[int], budget: Budget) -> tuple[int, int]:
    """count_covers() where all sums of what may be taken whole are listed at once."""
    values = [buckets[k][1] for k in whole]
    sums = every_sum(values)
    budget.sets(len(sums))
    full = n = sums.count(target) - (target == 0)
    for i, bucket in enumerate(buckets):
        lo, hi, but = _part_of(key, target, bucket, False)
        own = sums
        if i in whole:
            at = whole.index(i)
            own = every_sum(values[:at] + values[at + 1 :])
        budget.sets(len(own))
        for s in own:
            part = target - s
            if lo <= part <= hi and part not in but:
                n += 1
    return full, n


def _left(buckets: Side, way: Way) -> Side:
    taken = way.get
    return [(k, rest) for k, x in buckets if (rest := x - taken(k, 0))]


class Search:
    """Depth-first allocations of drivers (ascending) to buckets (ascending), up to `most` raw results or until the budget is spent.

    A raw result is an allocation that leaves buckets whose sum is 0; kept are those that leave a cent at most of every
    bucket, with their number among the raw ones.
    """

    def __init__(self, most: int, budget: Budget, within: bool = False):
        self.most, self.budget, self.within = most, budget, within
        self.raw, self.kept = 0, []

    def run(self, drivers: Side, buckets: Side, path: list[Way] | None = None) -> "Search":
        """path: the ways of drivers that were covered before; buckets are what these leave."""
        self.drivers, path = drivers, list(path or [])
        given = len(path)
        try:
            self.budget.use(nodes=1)
            if given == len(drivers):
                self._found(path, buckets)
                return self
            levels = [self._ways(path, buckets)]
            while levels and self.raw < self.most:
                left, ways = levels[-1]
                way = next(ways, None)
                if way is None:
                    levels.pop()
                    del path[given + len(levels) - 1 :]
                    continue
                path[given + len(levels) - 1 :] = [way]
                self.budget.use(nodes=1)
                if len(path) == len(drivers):
                    self._found(path, _left(left, way))
                else:
                    levels.append(self._ways(path, _left(left, way)))
        except Spent:
            pass
        return self

    def _found(self, path: list[Way], left: Side) -> None:
        if sum(x for _, x in left) == 0:
            if all(abs(x) <= 1 for _, x in left):
                self.kept.append((self.raw, list(path)))
            self.raw += 1

    def _ways(self, path: list[Way], left: Side) -> tuple[Side, Iterator[Way]]:
        """What is left and the ways of the next driver in it."""
        key, target = self.drivers[len(path)]
        rest, last = sum(x for _, x in left), len(path) == len(self.drivers) - 1
        if self.within:
            ahead = [t for _, t in self.drivers[len(path) :]]
            # the drivers ahead take at least so much of the buckets of either sign, as no bucket is over-drawn
            if sum(max(t, 0) for t in ahead) > sum(max(x, 0) for _, x in left) or sum(min(t, 0) for t in ahead) < sum(min(x, 0) for _, x in left) or rest != sum(ahead):
                return left, iter(())
            return left, iter([dict(left)] if len(_whole(key, target, left)) == len(left) else []) if last else covers(key, target, left, self.budget, True)
        if last and left and all(abs(x) > 1 for _, x in left):
            self._last(path, key, target, left, rest)
            return left, iter(())
        return left, covers(key, target, left, self.budget)

    def _last(self, path: list[Way], key: Key, target: int, left: Side, rest: int) -> None:
        """The last driver, where no bucket holds a cent only: of its ways only all that is left, taken whole, can be kept; it is the last of those of whole buckets."""
        balanced = rest == target
        full, n = balanced and target and _count_last(target, left) or count_covers(key, target, left, self.budget)
        seen = min(n, self.most - self.raw) if balanced else n
        reached = min(seen, self.budget.nodes)
        if balanced:
            if len(_whole(key, target, left)) == len(left) and full <= reached:
                self.kept.append((self.raw + full - 1, [*path, dict(left)]))
            self.raw += reached
        self.budget.use(nodes=seen)


def _ascending(side: dict[Key, int]) -> Side:
    return sorted(side.items(), key=lambda kv: kv[1])


def tracks(debits: dict[Key, int], credits: dict[Key, int]) -> tuple[bool, list[tuple[Side, Side, dict[Key, Way]]]]:
    """Whether credits drive, and the searches: drivers, buckets and what is locked beforehand. The second starts from drivers and buckets of equal amount; without such pairs it would be the first once more, and there is none."""
    swapped = len(credits) > len(debits)
    drivers, buckets = (credits, debits) if swapped else (debits, credits)
    locked: dict[Key, Way] = {}
    free = dict(buckets)
    for key, amount in _ascending(drivers):
        if (equal := next((b for b, x in free.items() if x == amount), None)) is not None:
            locked[key] = {equal: amount}
            del free[equal]
    searches = [(_ascending(drivers), _ascending(buckets), {})]
    if locked:
        searches.append((_ascending({k: x for k, x in drivers.items() if k not in locked}), _ascending(free), locked))
    return swapped, searches


def _links(debits: dict[Key, int], swapped: bool, drivers: Side, path: list[Way], locked: dict[Key, Way]) -> list[tuple[Key, Key, int]]:
    """(debit key, credit key, cents), debits in the order of the ledger."""
    ways = dict(zip((k for k, _ in drivers), path)) | locked
    if swapped:
        return [(d, c, x) for d in debits for c, way in ways.items() if (x := way.get(d))]
    return [(d, c, x) for d in debits if d in ways for c, x in ways[d].items() if x]


def _sides(ledger) -> tuple[dict[Key, int], dict[Key, int]]:
    sides: dict[str, dict[Key, int]] = {"D": {}, "C": {}}
    for e in ledger:
        if int(e["cents"]):
            sides[e["side"]][e["subject"], e["sign"]] = int(e["cents"])
    return sides["D"], sides["C"]


def balanced(debits: dict[Key, int], credits: dict[Key, int]) -> bool:
    """Drivers are covered exactly, so buckets end up empty only if both sides have the same sum."""
    return sum(debits.values()) == sum(credits.values())


def solve(debits: dict[Key, int], credits: dict[Key, int], most: int = MAX_SOLUTIONS, nodes: int = MAX_NODES, within: bool = False) -> tuple[list[list[tuple[Key, Key, int]]], str]:
    """Solutions as lists of (debit key, credit key, cents), and solved, no_solution or budget."""
    debits, credits = ({k: x for k, x in side.items() if x} for side in (debits, credits))
    swapped, searches = tracks(debits, credits)
    out, seen, spent = [], set(), False
    for drivers, buckets, locked in searches:
        budget = Budget(nodes)
        found = Search(2 * most, budget, within).run(drivers, buckets)
        spent |= budget.spent
        for _, path in found.kept:
            links = _links(debits, swapped, drivers, path, locked)
            if len(out) < most and (mark := frozenset(links)) not in seen:
                seen.add(mark)
                out.append(links)
    return out, "budget" if spent else "solved" if out else "no_solution"


LINK_TYPE = pa.list_(pa.struct([("d_subject", pa.string()), ("d_sign", pa.string()), ("c_subject", pa.string()), ("c_sign", pa.string()), ("cents", pa.int64())]))


def _link_arrays(found: list[list[tuple[Key, Key, int]]]) -> pa.ListArray:
    """Solutions as one Arrow column, built from flat lists."""
    flat = [x for links in found for x in links]
    fields = [[d[0] for d, _, _ in flat], [d[1] for d, _, _ in flat], [c[0] for _, c, _ in flat], [c[1] for _, c, _ in flat], [x for _, _, x in flat]]
    arrays = [pa.array(f, t.type) for f, t in zip(fields, LINK_TYPE.value_type)]
    offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(arrays, fields=list(LINK_TYPE.value_type)))


def _batch(columns: list[tuple[str, pa.DataType]], rows: list[tuple], links: list) -> pa.RecordBatch:
    arrays = [pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(columns)]
    return pa.RecordBatch.from_arrays([*arrays, _link_arrays(links)], names=[*(c for c, _ in columns), "links"])


def solutions(vl: DataFrame, most: int = MAX_SOLUTIONS, nodes: int = MAX_NODES, within: bool = False, branches: int = MAX_BRANCHES, whole: bool = False) -> DataFrame:
    """ledger_key, status, n (0-based order found; null without solution), links: for every distinct ledger of voucher_ledgers().

    A written table. `within` never takes more of a bucket than it holds, and cuts branches that would have to. With
    branches = 0 a ledger that one search does not finish stays as it is. whole: such a ledger is searched to the end
    instead, however long that takes, so no status is budget.
    """
    # searches take long for their few bytes, so they are dealt over as many tasks as a shuffle has, however small;
    # equal keys have equal ledgers; arrays as keys are hashed, as a value of an aggregate they would be sorted
    tasks = int(vl.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ledgers = vl.select("ledger_key", "ledger").repartition(tasks, "ledger_key").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [("ledger_key", pa.string()), ("status", pa.string()), ("n", pa.int64())]
        for batch in batches:
            rows, links = [], []
            for key, ledger in zip(batch.column("ledger_key").to_pylist(), batch.column("ledger").to_pylist()):
                sides = _sides(ledger)
                found, status = solve(*sides, most, nodes, within) if balanced(*sides) else ([], "no_solution")
                rows += [(key, status, n) for n in range(len(found))] or [(key, status, None)]
                links += found or [[]]
                if len(rows) > 10_000:
                    yield _batch(columns, rows, links)
                    rows, links = [], []
            yield _batch(columns, rows, links)

    found = written(ledgers.mapInArrow(run, f"ledger_key string, status string, n long, links {LINKS}"), "solutions")
    hard = found.where("status = 'budget'").select("ledger_key").distinct()
    if not (branches or whole) or hard.isEmpty():
        return found
    return found.where("status <> 'budget'").unionByName(_dealt(ledgers.join(hard, "ledger_key", "left_semi"), most, nodes, within, None if whole else branches))


def _dealt(ledgers: DataFrame, most: int, nodes: int, within: bool, branches: int | None) -> DataFrame:
    """solutions() of ledgers that one search does not finish: the first driver's ways are rows, each is searched on its own. branches None: no budget, so a search stops at its `most` results or its end, and is one row."""
    ways = "array<struct<subject:string,sign:string,cents:long>>"

    def first_ways(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, ledger in zip(pdf["ledger_key"], pdf["ledger"]):
                for track, (drivers, buckets, locked) in enumerate(tracks(*_sides(ledger))[1]):
                    found, complete = [], True
                    if branches is None:
                        rows.append((key, ledger, track, 0, True, None))
                        continue
                    if drivers:
                        try:
                            for way in islice(covers(*drivers[0], buckets, Budget(nodes), within), branches + 1):
                                found.append([(*k, x) for k, x in way.items()])
                        except Spent:
                            complete = False
                        complete &= len(found) <= branches
                    elif locked:
                        found = [[]]  # nothing is left to search
                    rows += [(key, ledger, track, n, complete, way) for n, way in enumerate(found[:branches])] or [(key, ledger, track, None, complete, None)]
            yield pd.DataFrame(rows, columns=["ledger_key", "ledger", "track", "branch", "complete", "way"]).astype({"branch": "Int64"})

    kind = ledgers.schema["ledger"].dataType.simpleString()
    listed = written(ledgers.mapInPandas(first_ways, f"ledger_key string, ledger {kind}, track int, branch long, complete boolean, way {ways}"), "branches")
    spread = listed.repartition(F.col("ledger_key"), F.col("track"), F.col("branch"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [("ledger_key", pa.string()), ("track", pa.int32()), ("branch", pa.int64()), ("complete", pa.bool_()), ("spent", pa.bool_()), ("raw", pa.int64()), ("at", pa.int64())]
        for batch in batches:
            for r in batch.to_pylist():
                debits, credits = _sides(r["ledger"])
                swapped, searches = tracks(debits, credits)
                drivers, buckets, locked = searches[r["track"]]
                budget, found = Budget(nodes) if branches is not None else Budget(inf, inf), None
                if r["branch"] is not None:
                    way = {(e["subject"], e["sign"]): e["cents"] for e in r["way"] or []}
                    found = Search(2 * most, budget, within).run(drivers, _left(buckets, way), [way] if way else [])
                head = (r["ledger_key"], r["track"], r["branch"], r["complete"], budget.spent, found.raw if found else 0)
                kept = found.kept if found else []
                rows = [(*head, None), *((*head, at) for at, _ in kept)]
                yield _batch(columns, rows, [[], *(_links(debits, swapped, drivers, path, locked) for _, path in kept)])

    raw = written(spread.mapInArrow(search, f"ledger_key string, track int, branch long, complete boolean, spent boolean, raw long, at long, links {LINKS}"), "searched")
    # at most `branches` rows for each of the two searches of a ledger
    w = Window.partitionBy("ledger_key", "track").orderBy("branch")
    each = raw.where("at is null").withColumn("before", F.sum("raw").over(w) - F.col("raw"))
    seen = F.col("before") < 2 * most
    open_end = each.groupBy("ledger_key", "track").agg((F.bool_or(F.col("spent") & seen) | (~F.bool_and("complete") & (F.sum("raw") < 2 * most))).alias("open"))
    status = open_end.groupBy("ledger_key").agg(F.bool_or("open").alias("open"))
    kept = raw.where("at is not null").join(each.select("ledger_key", "track", "branch", "before"), ["ledger_key", "track", "branch"])
    kept = kept.where(F.col("before") + F.col("at") < 2 * most).withColumn("place", F.struct("track", "branch", "at"))
    mark = F.array_sort("links")  # the same links in another order are the same solution
    once = kept.groupBy("ledger_key", mark.alias("mark")).agg(F.min("place").alias("place"), F.min_by("links", "place").alias("links"))
    n = F.row_number().over(Window.partitionBy("ledger_key").orderBy("place")) - 1
    first = once.withColumn("n", n.cast("long")).where(F.col("n") < most).select("ledger_key", "n", "links")
    out = status.join(first, "ledger_key", "left")
    of = F.when(F.col("open"), "budget").when(F.col("n").isNull(), "no_solution").otherwise("solved")
    return out.select("ledger_key", of.alias("status"), "n", F.coalesce("links", F.array().cast(LINKS)).alias("links"))


def violations(vl: DataFrame, s: DataFrame) -> DataFrame:
    """In how many places solutions do not give an account of their ledger its amount, but for a cent; one row.

    What a solution gives each account is summed in its own row. Solutions of a ledger that give the same are counted
    before they meet their ledger, and right ones all give the same.
    """
    links = F.col("links")

    def side(name: str, p: str) -> Column:
        keys = F.array_distinct(F.transform(links, lambda l: F.struct(l[f"{p}_subject"].alias("subject"), l[f"{p}_sign"].alias("sign"))))
        cents = lambda k: F.aggregate(F.filter(links, lambda l: (l[f"{p}_subject"] == k["subject"]) & (l[f"{p}_sign"] == k["sign"])), F.lit(0).cast("long"), lambda acc, l: acc + l["cents"])
        return F.transform(keys, lambda k: F.struct(F.lit(name).alias("side"), k["subject"].alias("subject"), k["sign"].alias("sign"), cents(k).alias("cents")))

    given = s.select("ledger_key", F.array_sort(F.concat(side("D", "d"), side("C", "c"))).alias("given")).groupBy("ledger_key", "given").agg(F.count("*").alias("solutions"))
    same = lambda a, b: (a["side"] == b["side"]) & (a["subject"] == b["subject"]) & (a["sign"] == b["sign"])
    of = lambda k: F.aggregate(F.filter("given", lambda g: same(g, k)), F.lit(0).cast("long"), lambda acc, g: acc + g["cents"])
    wrong = F.size(F.filter("ledger", lambda e: F.abs(e["cents"] - of(e)) > 1)) + F.size(F.filter("given", lambda g: ~F.exists("ledger", lambda e: same(e, g)) & (F.abs(g["cents"]) > 1)))
    both = vl.select("ledger_key", "ledger").distinct().join(given, "ledger_key")
    return both.agg(F.coalesce(F.sum(wrong * F.col("solutions")), F.lit(0).cast("long")).alias("violations"))


def occam_scores(s: DataFrame) -> DataFrame:
    """s with score: 100, less one for each link, less the extra links of split keys (5 a link on the side with more keys, debits if equal, 1 on the other; twice that for hard accounts)."""
    links = F.col("links")
    per_key = lambda p: F.transform(F.array_distinct(F.transform(links, lambda l: F.struct(l[f"{p}_subject"].alias("s"), l[f"{p}_sign"].alias("g")))), lambda k: F.struct(k["s"].alias("s"), F.size(F.filter(links, lambda l: (l[f"{p}_subject"] == k["s"]) & (l[f"{p}_sign"] == k["g"]))).alias("n")))
    keyed = s.withColumns({"_d": per_key("d"), "_c": per_key("c")})
    penalty = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, k: acc + (k["n"] - 1) * S.bone_multiplier(k["s"]))
    debit_drives = F.size("_d") >= F.size("_c")
    score = 100.0 - F.size("links") - penalty("_d") * F.when(debit_drives, 5).otherwise(1) - penalty("_c") * F.when(debit_drives, 1).otherwise(5)
    return keyed.withColumn("score", S.round2(score)).drop("_d", "_c")


MEMORY = 0.5


def ranked(s: DataFrame) -> DataFrame:
    """s with total (score weighted by the constant memory of 0.5), rank from 1 (best first, in the order found where equal) and last, the ledger's greatest rank."""
    w = Window.partitionBy("ledger_key")
    scored = occam_scores(s.where("n is not null"))
    return scored.withColumns({"memory": F.lit(MEMORY), "total": S.round2(F.col("score") * (1 + 0.5 * MEMORY)), "rank": F.row_number().over(w.orderBy(F.desc("score"), "n")), "last": F.count("*").over(w)})


def plan_table(vl: DataFrame, r: DataFrame, patterns: DataFrame) -> DataFrame:
    """One header row per pattern and ranked solution of its sample voucher, and one row per link; option is "pattern-solution", the best is marked x on all its rows.

    Patterns are numbered by how often they occur.
    """
    counted = numbered(written(patterns, "patterns"), "p", F.desc("n"), F.col("pattern"))
    sample = counted.join(vl.select(F.col("voucher").alias("sample"), "ledger_key"), "sample").select("p", "pattern", F.col("n").alias("n_vouchers"), "ledger_key")
    plans = sample.join(r, "ledger_key").withColumn("option", F.concat_ws("-", F.col("p").cast("string"), F.col("rank").cast("string")))
    mark = F.when(F.col("rank") == 1, "x").otherwise("")
    none = lambda kind: F.lit(None).cast(kind)
    head = plans.select("pattern", "option", mark.alias("mark"), "score", "memory", "total", F.lit(0).alias("row"), none("string").alias("subject"), none("string").alias("contra"), none("double").alias("amount"))
    links = plans.select("pattern", "option", mark.alias("mark"), F.posexplode("links").alias("i", "l"))
    body = links.select("pattern", "option", "mark", none("double").alias("score"), none("double").alias("memory"), none("double").alias("total"), (F.col("i") + 1).alias("row"), F.col("l.d_subject").alias("subject"), F.col("l.c_subject").alias("contra"), (F.col("l.cents") / 100.0).alias("amount"))
    return head.unionByName(body)


def plan_selection(plan: DataFrame) -> DataFrame:
    """pattern, choice: the solution number of the last option marked x (any case, spaces around it)."""
    chosen = plan.where(F.lower(F.trim("mark")) == "x")
    last = chosen.groupBy("pattern").agg(F.max_by("option", F.struct(F.split_part("option", F.lit("-"), F.lit(2)).try_cast("int"), "row")).alias("option"))
    return last.select("pattern", F.split_part("option", F.lit("-"), F.lit(2)).try_cast("int").alias("choice"))


def choose(vl: DataFrame, r: DataFrame, selection: DataFrame | None = None, s: DataFrame | None = None, keep: tuple[str, ...] = (), what: dict[str, Column] | None = None) -> DataFrame:
    """voucher, links, status: every voucher's chosen solution, the best where nothing valid is selected for its pattern.

    With the solutions s, vouchers that have none come too, with null links and what the search ended with. keep: columns
    of vl that stay. what: columns from links in their place, computed once for a solution, not for every voucher.
    """
    what = what or {"links": F.col("links")}
    links = r.select("ledger_key", "rank", "last", *(x.alias(k) for k, x in what.items()), "status")
    columns = ("voucher", *keep, *what, "status")
    if selection is None:
        out = vl.select("voucher", "ledger_key", *keep).join(links.where("rank = 1"), "ledger_key").select(*columns)
    else:
        # a voucher meets the one solution it takes, not all of its ledger's
        lasts = r.groupBy("ledger_key").agg(F.max("last").alias("last"))
        wanted = vl.select("voucher", "ledger_key", "pattern", *keep).join(selection, "pattern", "left").join(lasts, "ledger_key")
        fits = F.when(F.col("choice").between(1, F.col("last")), F.col("choice")).otherwise(1)
        out = wanted.withColumn("rank", fits.cast("int")).drop("last").join(links.drop("last"), ["ledger_key", "rank"]).select(*columns)
    if s is None:
        return out
    none = s.where("n is null").select("ledger_key", *(F.lit(None).cast(links.schema[k].dataType).alias(k) for k in what), "status")
    return out.unionByName(vl.select("voucher", "ledger_key", *keep).join(none, "ledger_key").drop("ledger_key"))
