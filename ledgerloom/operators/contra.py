"""Contra accounts: which subject each line is settled against.

Vouchers are routed by rule, by sets that are aggregated once and joined back to the lines, so that a voucher may have any
number of them; all but many-to-many vouchers are rebuilt with built-in functions. Only many-to-many vouchers go through the allocation search (solver.py), once per
distinct ledger. Lines are canonical: voucher, line_no, subject, debit, credit (decimal(18,2)); the other columns that a
caller names stay on every row that a line gives, virtual rows too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.config import CLOSING_SUBJECT, FX_CONTRA, FX_EXCLUDED, FX_MONETARY, FX_OPERATING, FX_SUBJECT, INVALID, UNFINISHED, UNSOLVED
from ledgerloom.functions import scalars as S
from ledgerloom.shared import join_groups


def _sums() -> list[Column]:
    """What decides whether the lines of a voucher change sides: its absolute debits and credits."""
    return [F.sum(F.abs("debit")).alias("_d"), F.sum(F.abs("credit")).alias("_c")]


def _moves() -> tuple[Column, Column]:
    """Vouchers with debits only, whose negative ones become credits, and with credits only."""
    return (F.col("_c") < 0.001) & (F.col("_d") > 0.001), (F.col("_d") < 0.001) & (F.col("_c") > 0.001)


def _moved(lines: DataFrame) -> DataFrame:
    """lines with debit and credit after red-letter lines have changed sides, from lines with their voucher's sums."""
    of_debits, of_credits = _moves()
    to_credit, to_debit, none = of_debits & (F.col("debit") < 0), of_credits & (F.col("credit") < 0), F.lit(0).cast("decimal(18,2)")
    debit = F.when(to_credit, none).when(to_debit, -F.col("credit")).otherwise(F.col("debit"))
    credit = F.when(to_credit, -F.col("debit")).when(to_debit, none).otherwise(F.col("credit"))
    return lines.withColumns({"debit": debit.cast("decimal(18,2)"), "credit": credit.cast("decimal(18,2)")}).drop("_d", "_c")


def cleaned(lines: DataFrame) -> DataFrame:
    """Red-letter lines of one-sided vouchers change sides: negative debits become credits, negative credits debits."""
    sums = lines.groupBy("voucher").agg(F.count("*").alias("n_rows"), *_sums())
    return _moved(join_groups(lines, sums, "voucher", "line_no"))


def is_exchange_difference(subjects: Column) -> Column:
    """An exchange adjustment: financial expenses, no operating account, and three monetary accounts or more."""
    monetary = F.size(F.filter(subjects, lambda s: S.contains_any(s, FX_MONETARY) & ~S.contains_any(s, FX_EXCLUDED)))
    return F.exists(subjects, lambda s: s.contains(FX_SUBJECT)) & ~F.exists(subjects, lambda s: S.contains_any(s, FX_OPERATING)) & (monetary >= 3)


def _side(amount: str) -> Column:
    return F.collect_set(F.when(F.abs(amount) > 0.0001, F.col("subject")))


def _structure(processing: bool = False) -> Column:
    """The structure of a voucher from its arrays subjects, ds and cs."""
    return _structure_of(F.size("ds"), F.size("cs"), F.array_contains("subjects", CLOSING_SUBJECT), is_exchange_difference(F.col("subjects")), processing)


def _structure_of(d: Column, c: Column, has_closing: Column, is_exchange: Column, processing: bool = False) -> Column:
    """empty, closing, fx, 1v1, 1vN, Nv1 or MvN (everything else, one-sided vouchers too), from the number of subjects by side.

    A report asks for amounts first; processing asks for closing and exchange accounts first.
    """
    empty, closing, fx = ((d + c) == 0, "empty"), (has_closing, "closing"), (is_exchange, "fx")
    out = F
    for condition, name in (closing, fx, empty) if processing else (empty, closing, fx):
        out = out.when(condition, name)
    return out.when((d == 1) & (c == 1), "1v1").when((d == 1) & (c > 1), "1vN").when((d > 1) & (c == 1), "Nv1").otherwise("MvN")


def routes(clean: DataFrame) -> DataFrame:
    """voucher, subjects, ds and cs (subjects by side), and structure: one row per voucher of cleaned lines."""
    sets = {"subjects": F.collect_set("subject"), "ds": _side("debit"), "cs": _side("credit")}
    v = clean.groupBy("voucher").agg(*(F.array_sort(x).alias(k) for k, x in sets.items()))
    return v.withColumn("structure", _structure())


def voucher_routes(lines: DataFrame, processing: bool = False) -> DataFrame:
    """routes() from lines as they came, in one aggregation: voucher, n_rows, the sums, subjects, ds, cs, structure.

    Where negative debits become credits, they are the voucher's only credits (cents are exact), and the other way round.
    """
    of = lambda amount, positive: F.collect_set(F.when(F.col(amount) > 0 if positive else F.col(amount) < 0, F.col("subject")))
    sets = {"subjects": F.collect_set("subject"), "_dp": of("debit", True), "_dn": of("debit", False), "_cp": of("credit", True), "_cn": of("credit", False)}
    v = lines.groupBy("voucher").agg(F.count("*").alias("n_rows"), *_sums(), *(x.alias(k) for k, x in sets.items()))
    of_debits, of_credits = _moves()
    sides = {
        "ds": F.when(of_debits, F.col("_dp")).when(of_credits, F.col("_cn")).otherwise(F.array_union("_dp", "_dn")),
        "cs": F.when(of_debits, F.col("_dn")).when(of_credits, F.col("_cp")).otherwise(F.array_union("_cp", "_cn")),
        "subjects": F.col("subjects"),
    }
    v = v.withColumns({k: F.array_sort(x) for k, x in sides.items()}).drop("_dp", "_dn", "_cp", "_cn")
    return v.withColumn("structure", _structure(processing))


def routed(lines: DataFrame) -> DataFrame:
    """Cleaned lines with raw_debit and raw_credit, and with the route of their voucher, aggregated once and joined back."""
    raw = lines.withColumns({"raw_debit": F.col("debit"), "raw_credit": F.col("credit")})
    return _moved(join_groups(raw, voucher_routes(lines).drop("subjects"), "voucher", "line_no"))


def process_stats(r: DataFrame) -> DataFrame:
    simple = F.col("structure").isin("1v1", "1vN", "Nv1")
    return r.agg(F.count_if(F.col("structure") != "empty").alias("processed"), F.count_if(simple).alias("simple"), F.count_if(F.col("structure") == "MvN").alias("complex"))


def process_figures(lines: DataFrame) -> DataFrame:
    """vouchers, processed (those with amounts, closing or exchange accounts), simple_solved (closing and exchange vouchers too) and complex_groups, the number of patterns that need a search; one row."""
    r = voucher_routes(lines, processing=True)
    pattern = F.when(F.col("structure") == "MvN", F.array_join(F.array_sort(F.array_union("ds", "cs")), "、"))
    counts = r.groupBy(pattern.alias("pattern")).agg(F.count("*").alias("n"), F.count_if(F.col("structure") == "empty").alias("empty"))
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("vouchers"), F.coalesce(F.sum("empty"), F.lit(0)).alias("empty"), F.coalesce(F.sum(F.when(F.col("pattern").isNotNull(), F.col("n"))), F.lit(0)).alias("complex"), F.count("pattern").alias("complex_groups"))
    return sums.select("vouchers", (F.col("vouchers") - F.col("empty")).alias("processed"), (F.col("vouchers") - F.col("empty") - F.col("complex")).alias("simple_solved"), "complex_groups")


COLUMNS = ["voucher", "line_no", "subject", "debit", "credit", "contra", "virtual"]


def _row(subject: Column, debit: Column, credit: Column, contra: Column, virtual: bool = False) -> Column:
    number = lambda c: c.cast("double")
    return F.struct(subject.alias("subject"), number(debit).alias("debit"), number(credit).alias("credit"), contra.alias("contra"), F.lit(virtual).alias("virtual"))


def _touched(debit: str, credit: str) -> Column:
    return (F.abs(debit) > 0.001) | (F.abs(credit) > 0.001)


def parts(links: str = "links") -> Column:
    """For each account of a solution (side, sign and subject in one text) its contra accounts and their shares of its amount."""

    def side(name: str, own: str, other: str) -> Column:
        keys = F.array_distinct(F.transform(F.filter(links, lambda l: l[f"{own}_subject"].isNotNull()), lambda l: F.struct(l[f"{own}_subject"].alias("subject"), l[f"{own}_sign"].alias("sign"))))

        def of(k: Column) -> Column:
            mine = F.filter(links, lambda l: (l[f"{own}_subject"] == k["subject"]) & (l[f"{own}_sign"] == k["sign"]))
            whole = F.aggregate(mine, F.lit(0).cast("long"), lambda acc, l: acc + l["cents"])
            shares = F.transform(mine, lambda l: F.struct(l[f"{other}_subject"].alias("contra"), (l["cents"] / F.nullif(whole, F.lit(0))).alias("share")))
            return F.struct(F.concat(F.lit(name), k["sign"], k["subject"]).alias("key"), F.filter(shares, lambda x: x["share"].isNotNull()).alias("value"))

        return F.transform(keys, of)

    return F.map_from_entries(F.concat(side("D", "d", "c"), side("C", "c", "d")))


def _shared_out(side: str) -> Column:
    """A line's amount on one side, shared out in proportion over the links of its subject and sign."""
    amount, zero = F.col(side), F.lit(0.0)
    key = F.concat(F.lit("D" if side == "debit" else "C"), F.when(amount >= 0, "Pos").otherwise("Neg"), F.col("subject"))
    part = lambda x: amount.cast("double") * x["share"]
    rows = F.transform(F.try_element_at("parts", key), lambda x: _row(F.col("subject"), part(x) if side == "debit" else zero, part(x) if side == "credit" else zero, x["contra"]))
    return F.coalesce(F.when(F.abs(amount) > 0.001, rows), F.array().cast(ROWS))


ROWS = "array<struct<subject:string,debit:double,credit:double,contra:string,virtual:boolean>>"


def rebuilt(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of COLUMNS, and the columns to keep, from routed() lines; those of many-to-many vouchers need the column links or parts() of it (null: no solution).

    Vouchers without amounts, closing and exchange vouchers keep the amounts they came with. In one-to-many vouchers every
    line of the many-side stays, and for each there is a virtual line of the single side; the single side's own lines go.
    """
    subject, debit, credit, ds, cs, raw = F.col("subject"), F.col("debit"), F.col("credit"), F.col("ds"), F.col("cs"), (F.col("raw_debit"), F.col("raw_credit"))
    zero, structure, nothing = F.lit(0.0), F.col("structure"), F.array().cast(ROWS)
    d, c = F.abs("debit") > 0.001, F.abs("credit") > 0.001
    moved = _touched("raw_debit", "raw_credit")
    fx = F.when(~moved, "").when(subject.contains(FX_SUBJECT), FX_CONTRA).otherwise(FX_SUBJECT)
    rows = (
        F.when(structure == "empty", F.array(_row(subject, *raw, F.lit(INVALID))))
        .when(structure == "closing", F.array(_row(subject, *raw, F.when(moved, CLOSING_SUBJECT).otherwise(""))))
        .when(structure == "fx", F.array(_row(subject, *raw, fx)))
        # each side's subject is the other's contra; a line with both sides keeps the debit only
        .when(structure == "1v1", F.array(_row(subject, debit, F.when(d, zero).otherwise(credit.cast("double")), F.when(d, cs[0]).when(c, ds[0]).otherwise(""))))
        .when(structure == "1vN", F.when(F.abs("credit") > 0.0001, F.array(_row(subject, zero, credit, ds[0]), _row(ds[0], credit, zero, subject, True))).otherwise(nothing))
        .when(structure == "Nv1", F.when(F.abs("debit") > 0.0001, F.array(_row(subject, debit, zero, cs[0]), _row(cs[0], zero, debit, subject, True))).otherwise(nothing))
    )
    if "links" in lines.columns or "parts" in lines.columns:
        lines = lines if "parts" in lines.columns else lines.withColumn("parts", parts())
        solved = F.concat(_shared_out("debit"), _shared_out("credit"))
        # a search that ran out of its budget has not shown that there is no solution
        why = F.when(F.col("status") == "budget", UNFINISHED).otherwise(UNSOLVED) if "status" in lines.columns else F.lit(UNSOLVED)
        rows = rows.otherwise(F.when(F.col("parts").isNull(), F.array(_row(subject, debit, credit, why))).otherwise(solved))
    return lines.select("voucher", "line_no", *(F.col(f"`{k}`") for k in keep), F.explode(rows).alias("_r")).select("voucher", "line_no", "_r.*", *(F.col(f"`{k}`") for k in keep))


def of_structure(lines: DataFrame, *structures: str) -> DataFrame:
    """rebuilt() rows of vouchers of these structures, from routed() lines."""
    return rebuilt(lines.where(F.col("structure").isin(*structures)))


def settled(clean: DataFrame, r: DataFrame, structure: str) -> DataFrame:
    """Cleaned lines of one structure with the route of their voucher, by a join."""
    return clean.join(r.where(F.col("structure") == structure).select("voucher", "ds", "cs", "structure"), "voucher")


def one_to_many_rows(clean: DataFrame, r: DataFrame) -> DataFrame:
    both = settled(clean, r, "1vN").unionByName(settled(clean, r, "Nv1"))
    return rebuilt(both.withColumns({"raw_debit": F.col("debit"), "raw_credit": F.col("credit")}))


def ledgers(clean: DataFrame, r: DataFrame | None = None) -> DataFrame:
    """voucher, subject, sign (Pos, Neg), side (D, C), cents of the many-to-many vouchers: of routed() lines, or of cleaned lines and their routes."""
    df = clean.where("structure = 'MvN'") if r is None else settled(clean, r, "MvN")
    sides = F.array(F.struct(F.lit("D").alias("side"), F.col("debit").alias("amount")), F.struct(F.lit("C").alias("side"), F.col("credit").alias("amount")))
    each = df.select("voucher", "subject", F.explode(sides).alias("s")).select("voucher", "subject", "s.*").where(F.abs("amount") > 0.0001)
    sign = F.when(F.col("amount") >= 0, "Pos").otherwise("Neg")
    return each.groupBy("voucher", "subject", sign.alias("sign"), "side").agg(F.sum(F.col("amount") * 100).cast("long").alias("cents"))


def voucher_ledgers(ledger: DataFrame) -> DataFrame:
    """voucher, pattern, ledger (sorted array) and ledger_key: one row per many-to-many voucher."""
    entry = F.struct("side", "subject", "sign", "cents")
    v = ledger.groupBy("voucher").agg(F.array_sort(F.collect_list(entry)).alias("ledger"), F.array_join(F.array_sort(F.collect_set("subject")), "、").alias("pattern"))
    return v.withColumn("ledger_key", F.sha2(F.to_json("ledger"), 256))


#: What a voucher's lines need of its row in whole_vouchers().
ROUTE = ("n_rows", "_d", "_c", "ds", "cs", "structure")


#: What the lines of a voucher and subject say: debits above, below 0 and at all, then credits.
DEBIT_UP, DEBIT_DOWN, DEBIT, CREDIT_UP, CREDIT_DOWN, CREDIT = (1 << n for n in range(6))


def whole_vouchers(lines: DataFrame) -> DataFrame:
    """voucher, ROUTE, ledger, pattern and ledger_key (null but for many-to-many vouchers): voucher_routes() and voucher_ledgers() from lines as they came, summed by voucher and subject, then by voucher, without a join back to the lines.

    Of a voucher's absolute debits and credits only whether they are 0 is asked, so _d and _c are 0 or 1. The structure
    comes from counts, so that who asks for some structures does not make the arrays of all vouchers.
    """
    cents = lambda amount, keep: F.try_sum(F.when(keep, (F.col(amount) * 100).cast("long")))
    sums = {"dp": cents("debit", F.col("debit") > 0), "dn": cents("debit", F.col("debit") < 0), "cp": cents("credit", F.col("credit") > 0), "cn": cents("credit", F.col("credit") < 0)}
    flag = lambda amount, up, down, any_: F.when(F.col(amount) > 0, up | any_).when(F.col(amount) < 0, down | any_).when(F.col(amount) == 0, any_).otherwise(0)
    flags = F.bit_or(flag("debit", DEBIT_UP, DEBIT_DOWN, DEBIT) + flag("credit", CREDIT_UP, CREDIT_DOWN, CREDIT))
    each = lines.groupBy("voucher", "subject").agg(F.count("*").alias("n"), flags.alias("flags"), *(x.alias(k) for k, x in sums.items()))

    has = lambda flags, bits: flags.bitwiseAND(bits) != 0
    named, own = F.col("subject").isNotNull(), F.col("flags")
    up_or_down = {"d": DEBIT_UP | DEBIT_DOWN, "c": CREDIT_UP | CREDIT_DOWN}
    counted = {"n_dp": DEBIT_UP, "n_dn": DEBIT_DOWN, "n_d": up_or_down["d"], "n_cp": CREDIT_UP, "n_cn": CREDIT_DOWN, "n_c": up_or_down["c"]}
    of_subjects = {"closing": F.col("subject") == CLOSING_SUBJECT, "expenses": F.col("subject").contains(FX_SUBJECT)}
    v = each.groupBy("voucher").agg(
        F.sum("n").alias("n_rows"),
        F.bit_or("flags").alias("flags"),
        *(F.count_if(named & has(own, bits)).alias(name) for name, bits in counted.items()),
        *(F.coalesce(F.bool_or(x), F.lit(False)).alias(name) for name, x in of_subjects.items()),
        F.collect_list(F.struct("subject", *sums, "flags")).alias("entries"),
    )
    nonzero = lambda side, any_: F.when(has(F.col("flags"), any_), has(F.col("flags"), up_or_down[side]).cast("int")).alias(f"_{side}")
    v = v.withColumns({"_d": nonzero("d", DEBIT), "_c": nonzero("c", CREDIT)})
    of_debits, of_credits = _moves()
    n_d = F.when(of_debits, F.col("n_dp")).when(of_credits, F.col("n_cn")).otherwise(F.col("n_d"))
    n_c = F.when(of_debits, F.col("n_dn")).when(of_credits, F.col("n_cp")).otherwise(F.col("n_c"))
    there = lambda bits: lambda e: has(e["flags"], bits)

    def subjects(keep=lambda e: F.lit(True)) -> Column:
        return F.sort_array(F.transform(F.filter("entries", lambda e: e["subject"].isNotNull() & keep(e)), lambda e: e["subject"]))

    v = v.withColumn("structure", _structure_of(n_d, n_c, F.col("closing"), F.col("expenses") & is_exchange_difference(subjects())))
    sides = {
        "ds": F.when(of_debits, subjects(there(DEBIT_UP))).when(of_credits, subjects(there(CREDIT_DOWN))).otherwise(subjects(there(up_or_down["d"]))),
        "cs": F.when(of_debits, subjects(there(DEBIT_DOWN))).when(of_credits, subjects(there(CREDIT_UP))).otherwise(subjects(there(up_or_down["c"]))),
    }

    def entry(side: str, e: Column, sign: str, bits: int, cents: Column) -> Column:
        return F.when(has(e["flags"], bits), F.struct(F.lit(side).alias("side"), e["subject"].alias("subject"), F.lit(sign).alias("sign"), cents.alias("cents")))

    listed = lambda entries: F.sort_array(F.filter(F.flatten(F.transform("entries", lambda e: F.array(*entries(e)))), lambda x: x.isNotNull()))
    ledger = (
        F.when(of_debits, listed(lambda e: [entry("D", e, "Pos", DEBIT_UP, e["dp"]), entry("C", e, "Pos", DEBIT_DOWN, -e["dn"])]))
        .when(of_credits, listed(lambda e: [entry("D", e, "Pos", CREDIT_DOWN, -e["cn"]), entry("C", e, "Pos", CREDIT_UP, e["cp"])]))
        .otherwise(listed(lambda e: [entry("D", e, "Pos", DEBIT_UP, e["dp"]), entry("D", e, "Neg", DEBIT_DOWN, e["dn"]), entry("C", e, "Pos", CREDIT_UP, e["cp"]), entry("C", e, "Neg", CREDIT_DOWN, e["cn"])]))
    )
    kind = "array<struct<side:string,subject:string,sign:string,cents:bigint>>"
    v = v.withColumns(sides)
    listed_ledgers = v.select("voucher", *ROUTE, F.when(F.col("structure") == "MvN", ledger.cast(kind)).alias("ledger"))
    pattern = F.array_join(F.sort_array(F.array_distinct(F.transform("ledger", lambda e: e["subject"]))), "、")
    return listed_ledgers.select("*", pattern.alias("pattern"), F.sha2(F.to_json("ledger"), 256).alias("ledger_key"))


def line_ledgers(lines: DataFrame) -> DataFrame:
    """voucher_ledgers() from lines as they came."""
    return many_to_many(whole_vouchers(lines)).select("voucher", "ledger", "pattern", "ledger_key")


def many_to_many(vouchers: DataFrame) -> DataFrame:
    return vouchers.where("structure = 'MvN'")


def pattern_counts(vl: DataFrame) -> DataFrame:
    """pattern, its hash, how many vouchers have it, and the first of them."""
    return vl.groupBy("pattern").agg(F.count("*").alias("n"), F.min("voucher").alias("sample")).withColumn("hash", F.md5(F.col("pattern").cast("binary")))


def report(lines: DataFrame, chosen: DataFrame, keep: tuple[str, ...] = (), vouchers: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """All vouchers rebuilt, from canonical lines and chosen (voucher, links, and perhaps status): COLUMNS and the columns to keep. Solutions are joined to the routes, before these meet the lines.

    With whole_vouchers() of the lines, written, chosen has the ROUTE of its vouchers, and many-to-many vouchers that it does not have are left out.
    known: a row for every voucher with further columns, which go to its lines by the same join.
    """
    if vouchers is None:
        raw = lines.withColumns({"raw_debit": F.col("debit"), "raw_credit": F.col("credit")})
        of = voucher_routes(lines).drop("subjects").join(chosen, "voucher", "left")
        of = of if known is None else _with_known(of, known)
        return rebuilt(_moved(join_groups(raw, of, "voucher", "line_no")), keep)
    others = vouchers.where("structure <> 'MvN'").select("voucher", *ROUTE)
    routes = others.unionByName(chosen, allowMissingColumns=True)
    return of_vouchers(lines, routes if known is None else _with_known(routes, known), vouchers, keep)


def _with_known(routes: DataFrame, known: DataFrame) -> DataFrame:
    return routes.join(known.withColumnRenamed("voucher", "_known"), F.col("voucher").eqNullSafe(F.col("_known"))).drop("_known")


def of_vouchers(lines: DataFrame, routes: DataFrame, vouchers: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """rebuilt() rows of the vouchers in routes (voucher, ROUTE, and for many-to-many ones what was chosen), one join with the lines; vouchers are all, written."""
    raw = lines.withColumns({"raw_debit": F.col("debit"), "raw_credit": F.col("credit")})
    return rebuilt(_moved(join_groups(raw, routes, "voucher", "line_no", sizes=vouchers)), keep)
