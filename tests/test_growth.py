"""The steps that larger journals need: what is computed once, and that results stay those of the plainer way."""

import duckdb
from pyspark.sql import DataFrameWriter

from ledgerloom.operators import contra
from ledgerloom.plans import catalog, contra_catalog
from ledgerloom.sources import journal as J

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_journal_is_numbered_and_balanced_without_collecting_orders(spark, tmp_path):
    """Line items are never collected into arrays by order, and items of no known account go, also last ones."""
    assert "collect_list" not in _plan(catalog.lines(spark, SF))
    con = duckdb.connect()
    con.execute(f"copy (select * replace (case when l_linenumber <= 2 and l_orderkey % 2 = 0 then -3 else l_partkey end as l_partkey) from '{SF}/lineitem.parquet') to '{tmp_path}/lineitem.parquet' (format parquet)")
    con.execute(f"copy (select * from '{SF}/orders.parquet') to '{tmp_path}/orders.parquet' (format parquet)")
    for t in ("lineitem", "orders"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    due = con.execute(J.JOURNAL_CTE + " select k, line_no, subj, debit, credit from journal").fetchall()
    got = [tuple(r) for r in J.order_journal(spark, str(tmp_path)).select("k", "line_no", "subj", "debit", "credit").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, due))


def test_ledgers_come_from_sums_without_a_join(spark):
    """line_ledgers() gives what routing every line and summing it gives, red-letter lines and one-sided vouchers too."""
    rows = [
        ("a", 1, "x", 5, 0), ("a", 2, "y", -2, 0), ("a", 3, "z", 4, 0), ("a", 4, "y", -7, 0),
        ("b", 1, "x", 0, -5), ("b", 2, "y", 0, 3), ("b", 3, "z", 0, 2), ("b", 4, "x", 0, -1), ("b", 5, "w", 0, -2),
        ("c", 1, "x", 5, 0), ("c", 2, "x", -1, 0), ("c", 3, "y", 1, 1), ("c", 4, "z", 0, 4),
        ("d", 1, "本年利润", 1, 0), ("d", 2, "y", 1, 0), ("d", 3, "z", 0, 1), ("d", 4, "w", 0, 1),
        ("e", 1, "财务费用", 1, 0), ("e", 2, "应收账款", 1, 0), ("e", 3, "应付账款", 0, 1), ("e", 4, "预付账款", 0, 1),
        ("f", 1, None, 1, 0), ("f", 2, "x", 1, 0), ("f", 3, "y", 1, 0), ("f", 4, "z", 0, 1), ("f", 5, "w", 0, 2),
        ("g", 1, "x", 0, 0), ("h", 1, "x", 1, 0), ("h", 2, "y", 0, 1), ("i", 1, "x", 2, None), ("i", 2, "y", -1, None), ("i", 3, "z", -1, None), ("i", 4, "v", 1, None),
        (None, 1, "x", 1, 0), (None, 2, "y", 1, 0), (None, 3, "z", 0, 1), (None, 4, "w", 0, 1),
    ]
    lines = spark.createDataFrame(rows, "voucher string, line_no long, subject string, debit int, credit int")
    lines = lines.withColumns({c: lines[c].cast("decimal(18,2)") for c in ("debit", "credit")})
    got = contra.line_ledgers(lines)
    assert "Join" not in _plan(got)
    due = contra.voucher_ledgers(contra.ledgers(contra.routed(lines)))
    assert got.dtypes == due.dtypes
    assert sorted(map(repr, got.collect())) == sorted(map(repr, due.collect())) != []


def test_classified_vouchers_are_read_not_computed_again(spark):
    for name in ("inner_score", "materiality", "alpha", "distance_pairs", "materiality_preview", "graph_edges", "graph_nodes", "graph_summary", "contra_report_small"):
        assert "l_orderkey" not in catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_whole_vouchers_are_routes_and_ledgers(spark):
    """One aggregation gives what voucher_routes() gives, also where a voucher's sums are beyond whole numbers of cents."""
    big = 9_000_000_000_000_000
    rows = [("a", 1, "x", 5, 0), ("a", 2, "y", -2, 0), ("a", 3, "x", -1, 0), ("b", 1, "x", 0, -5), ("b", 2, "y", 0, 3), ("c", 1, None, 1, 0), ("c", 2, "x", 1, 0), ("c", 3, "y", 0, 2), ("d", 1, "本年利润", 0, 0), ("d", 2, "x", None, 1),
            ("e", 1, "财务费用", 1, 0), ("e", 2, "应收账款", 1, 0), ("e", 3, "应付账款", 0, 1), ("e", 4, "预付账款", 0, 1), ("f", 1, "x", None, None), (None, 1, "x", 1, 0), (None, 2, "y", 0, 1)]
    rows += [("z", n, "x", big, 0) for n in range(12)] + [("z", n, "y", 0, big) for n in range(12, 24)]
    lines = spark.createDataFrame(rows, "voucher string, line_no long, subject string, debit long, credit long")
    lines = lines.withColumns({c: lines[c].cast("decimal(18,2)") for c in ("debit", "credit")})
    columns = ["voucher", "n_rows", "ds", "cs", "structure"]
    got, due = (of(lines).select(columns).collect() for of in (contra.whole_vouchers, contra.voucher_routes))
    assert sorted(map(repr, got)) == sorted(map(repr, due)) != []


def test_reports_read_routes_that_were_written(spark):
    """Nothing is aggregated by voucher again where the lines meet their routes."""
    for name in ("contra_report_small", "contra_mvn_small"):
        plan = _plan(catalog.queries()[name](spark, SF))
        assert "collect_set" not in plan and "collect_list" not in plan


def test_rows_of_one_structure_read_lines_that_were_written(spark):
    for name in ("contra_closing", "contra_fx"):
        assert "l_orderkey" not in catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def _sorted_by_line(df) -> bool:
    return "l_shipdate" in df._jdf.queryExecution().executedPlan().toString()


def test_sums_by_voucher_do_not_number_the_lines(spark):
    """Ledgers and vouchers come from lines in no order, with the amounts of lines in order."""
    assert not _sorted_by_line(catalog.amounts(spark, SF)) and _sorted_by_line(catalog.lines(spark, SF))
    columns = ["voucher", "subject", "debit", "credit"]
    got, due = (sorted(map(repr, of(spark, SF).select(columns).collect())) for of in (catalog.amounts, catalog.lines))
    assert got == due != []
    assert not _sorted_by_line(catalog.business(spark, SF))


def test_structure_is_known_without_the_arrays_of_a_voucher(spark):
    """Who asks for many-to-many vouchers filters on counts, not on arrays built for every voucher."""
    lines = spark.createDataFrame([("a", "x", 1, 0), ("a", "y", 0, 1)], "voucher string, subject string, debit int, credit int")
    lines = lines.withColumns({c: lines[c].cast("decimal(18,2)") for c in ("debit", "credit")})
    plan = _plan(contra.line_ledgers(lines))
    conditions = [line for line in plan.splitlines() if "Filter" in line]
    assert all(line.count("sort_array") <= 3 for line in conditions)


def test_a_report_joins_the_lines_once(spark):
    """What a voucher says as a whole reaches its lines with their route, by one join."""
    plan = _plan(catalog.queries()["uploaded_report_small"](spark, SF))
    assert sum("_part#" in line for line in plan.splitlines() if "Join" in line) == 1


def test_groups_words_are_looked_for_once(spark):
    """Classification goes in steps; as one expression it looked for the words of a group wherever it asked for them."""
    from ledgerloom.operators import classify

    v = spark.createDataFrame([("应收账款、银行存款",)], "feature string")
    assert _plan(classify.classify(v)).count("array_intersect") <= 20


def test_ledgers_are_collected_after_one_sort(spark, monkeypatch):
    """Arrays of very many vouchers are not hashed first, which sorts them before and after merging; the session's setting comes back."""
    plans, parquet, name = [], DataFrameWriter.parquet, "spark.sql.execution.useObjectHashAggregateExec"
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path: (plans.append(self._df._jdf.queryExecution().executedPlan().toString()), parquet(self, path))[1])
    before = spark.conf.get(name)
    ledgers = contra_catalog._ledgers(spark, SF)
    assert "collect_list" in plans[-1] and "ObjectHashAggregate" not in plans[-1] and spark.conf.get(name) == before
    due = contra.line_ledgers(catalog.amounts(spark, SF))
    assert sorted(map(repr, ledgers.collect())) == sorted(map(repr, due.collect())) != []


def test_search_is_not_made_twice_and_is_dealt(spark):
    """Without equal amounts there is nothing to start from a second time; unbalanced ledgers need no search; small ledgers are dealt over all tasks of a shuffle."""
    from ledgerloom.operators import solver

    d, c = {("a", "Pos"): 5, ("b", "Pos"): 9}, {("x", "Pos"): 4, ("y", "Pos"): 10}
    assert len(solver.tracks(d, c)[1]) == 1 and len(solver.tracks(d, c | {("z", "Pos"): 9})[1]) == 2
    sides = lambda n, c: [("D", f"d{k}", "Pos", 1_000_003 * (k + 1) + k * k) for k in range(n)] + [("C", f"c{k}", "Pos", 999_983 * (k + 2) + k) for k in range(c)]
    rows = [(f"k{n}", sides(20, n)) for n in range(12, 20)]
    vl = spark.createDataFrame(rows, "ledger_key string, ledger array<struct<side:string,subject:string,sign:string,cents:long>>")
    out = solver.solutions(vl)
    assert {r.status for r in out.collect()} == {"no_solution"}
    assert len(out.inputFiles()) >= 2


def test_what_the_last_driver_can_take_is_known_without_listing():
    """_count_last() counts what listing every way of the last driver counts."""
    import random

    from ledgerloom.operators import solver

    rng = random.Random(3)
    for _ in range(300):
        sign = rng.choice([-1, 1])
        left = [((rng.choice(["银行存款", "原材料"]) + str(k), "Pos"), sign * rng.randint(2, 9)) for k in range(rng.randint(1, 5))]
        key, target = (rng.choice(["银行存款", "管理费用"]), "Pos"), sum(x for _, x in left)
        assert solver._count_last(target, left) == solver.count_covers(key, target, left, solver.Budget(0))
        ways = list(solver.covers(key, target, left, solver.Budget(0)))
        assert solver._count_last(target, left)[1] == len(ways)
    assert solver._count_last(3, [(("a", "Pos"), 5), (("b", "Pos"), -2)]) is None


def test_conservation_is_counted_by_ledger_without_rows_of_links(spark):
    """Wrong amounts, missing and foreign accounts are counted for every solution; links are not exploded, a cent is let pass."""
    from ledgerloom.operators import solver

    ledger = [("C", "x", "Pos", 9), ("C", "y", "Pos", 1000), ("D", "a", "Pos", 1009)]
    vl = spark.createDataFrame([("v1", "k", ledger), ("v2", "k", ledger)], "voucher string, ledger_key string, ledger array<struct<side:string,subject:string,sign:string,cents:long>>")
    link = lambda c, cents, d="a": (d, "Pos", c, "Pos", cents)
    right, cent = [link("x", 9), link("y", 1000)], [link("x", 10), link("y", 1000)]
    short, foreign = [link("y", 1000)], [link("x", 9), link("y", 1000), link("z", 7)]
    of = lambda *found: spark.createDataFrame([("k", n, x) for n, x in enumerate(found)], f"ledger_key string, n long, links {solver.LINKS}")
    count = lambda *found: solver.violations(vl, of(*found)).first().violations
    assert count(right, cent, right) == 0 == count()
    assert count(short) == 2 and count(short, short, right) == 4  # a, x
    assert count(foreign) == 2  # a, z
    assert "Generate" not in _plan(solver.violations(vl, of(right)))
    assert [tuple(r) for r in catalog.queries()["contra_conservation"](spark, SF).collect()] == [(0,)]


def test_a_voucher_meets_only_the_solution_it_takes(spark):
    """A choice is looked up by ledger and rank; invalid or missing ones mean the first."""
    from ledgerloom.operators import solver

    vl = spark.createDataFrame([("a", "k", "p"), ("b", "k", "q"), ("c", "k", "r"), ("d", "k", "s"), ("e", "none", "p")], "voucher string, ledger_key string, pattern string")
    links = lambda n: [("x", "Pos", "y", "Pos", 10 * n + k) for k in range(n)]
    s = spark.createDataFrame([("k", "solved", n, links(n + 1)) for n in range(3)] + [("none", "no_solution", None, [])], f"ledger_key string, status string, n long, links {solver.LINKS}")
    selection = spark.createDataFrame([("p", 3), ("q", 4), ("r", 0)], "pattern string, choice int")
    out = solver.choose(vl, solver.ranked(s), selection, s)
    assert {r.voucher: r.links and len(r.links) for r in out.collect()} == {"a": 3, "b": 1, "c": 1, "d": 1, "e": None}
    joins = [line for line in _plan(out).splitlines() if "Join" in line]
    assert any("rank" in line for line in joins) and not any("Filter" in line and "choice" in line for line in _plan(out).splitlines())


def test_plan_sheet_is_searched_to_the_end(spark, monkeypatch):
    """Where budgets are spent at once, sample vouchers of the sheet still have all their plans."""
    from ledgerloom.operators import solver

    solutions, rows = solver.solutions, lambda: sorted(map(repr, catalog.queries()["plan_sheet"](spark, SF).collect()))
    due = rows()
    monkeypatch.setattr(solver, "solutions", lambda vl, **k: solutions(vl, nodes=3, branches=1, **k))
    assert rows() == due != []


def test_sets_of_many_numbers_are_listed_with_small_tables(monkeypatch):
    """Beyond WIDE numbers, sets and counts are those of trying every set, in the order of combinations."""
    import itertools
    import random

    from ledgerloom.operators import subsets

    monkeypatch.setattr(subsets, "FEW", 1)
    monkeypatch.setattr(subsets, "WIDE", 4)
    rng = random.Random(7)
    for n in [*range(5, 12)] * 4:
        values, lo = [rng.randint(-9, 20) for _ in range(n)], rng.randint(-20, 40)
        for hi, least in ((lo, 1), (lo + 4, 0), (lo + 60, 1)):
            due = [c for size in range(least, n + 1) for c in itertools.combinations(range(n), size) if lo <= sum(values[k] for k in c) <= hi]
            assert list(subsets.summing_to(values, lo, hi, least, lambda k: None)) == due
            assert subsets.count_summing(values, [(lo, hi), (1, 0)], lambda k: None) == [len(due) + (least == 1 and lo <= 0 <= hi), 0]


def test_what_virtual_lines_say_is_hashed_not_sorted(spark):
    """First lines and summaries of vouchers come without sorting the lines, also where a voucher's text hides two dates and numbers."""
    from pyspark.sql import functions as F

    from ledgerloom.operators import report

    plan = catalog.queries()["uploaded_report_small"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" in plan and "SortAggregate" not in plan
    rows = [("a_b", "c", "t", "x", "3", "0"), ("a", "b_c", "s", "y", "0", "1"), ("a_b", "c", "s", "z", "0", "2"), ("a", "b_c", " ", "x", "0", "0"), ("a", "b_c", "t", "x", "0", "0")]
    raw = spark.createDataFrame(rows, ["日期", "凭证号", "摘要", "一级科目", "借方金额", "贷方金额"]).coalesce(1)
    lines = J.contra_lines(raw)
    chosen = lines.where("false").select("voucher", F.lit(None).cast("array<struct<d_subject:string,d_sign:string,c_subject:string,c_sign:string,cents:bigint>>").alias("links"), F.lit("solved").alias("status"))
    out = report.final_report(lines, chosen, J.smart_detect(raw.columns)).where("`借方金额` > 0").select("日期", "凭证号", "摘要", "一级科目", "借方金额", "对方科目").collect()
    assert sorted(map(tuple, out)) == [("a_b", "c", "t | s", "x", 1.0, "y"), ("a_b", "c", "t | s", "x", 2.0, "z")]
