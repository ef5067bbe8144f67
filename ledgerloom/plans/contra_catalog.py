"""Registered queries of the contra analysis, the plans, compression and the learned classifier."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.config import FX_EXCLUDED, FX_MONETARY, FX_OPERATING
from ledgerloom.functions import scalars as S
from ledgerloom.operators import compress, contra, ml, report, solver
from ledgerloom.plans.catalog import amounts, business, classified, lines, register
from ledgerloom.plans.oracle import CONTRA, GROUPED, LINES, R6
from ledgerloom.plans.search_oracle import SEARCH, WIDEST
from ledgerloom.shared import ONE_SORT, shared_folder, written
from ledgerloom.sources import xlsx


def _routes(spark, d) -> DataFrame:
    return contra.voucher_routes(amounts(spark, d))


def _routed(spark, d) -> DataFrame:
    return contra.routed(lines(spark, d))


def _of_structure(spark, d, *structures: str) -> DataFrame:
    """The rows of vouchers of these structures: lines and routes are written, and only these vouchers' routes meet the lines."""
    journal = written(lines(spark, d), "lines")
    vouchers = written(contra.whole_vouchers(journal).select("voucher", *contra.ROUTE), "vouchers", ONE_SORT)
    return contra.of_vouchers(journal, vouchers.where(F.col("structure").isin(*structures)), vouchers)


def _ledgers(spark, d) -> DataFrame:
    """The ledgers of the derived journal. Its vouchers are an order or a few, so lines are dealt by voucher once, for sums by subject and by voucher."""
    return once(amounts(spark, d).repartition("voucher"))


def once(journal: DataFrame) -> DataFrame:
    """The ledgers of many-to-many vouchers, written: searches, patterns and what is chosen read them."""
    return written(contra.line_ledgers(journal), "ledgers", ONE_SORT)


def vouchers_once(journal: DataFrame) -> DataFrame:
    """Routes and ledgers of all vouchers, written: what once() gives, and what the lines are joined with."""
    return written(contra.whole_vouchers(journal), "vouchers", ONE_SORT)


def chosen_of(vl: DataFrame, selection: DataFrame | None = None, r: DataFrame | None = None, s: DataFrame | None = None) -> DataFrame:
    """What the search chose for many-to-many rows of vouchers_once(), as accounts' shares, with their routes."""
    s = solver.solutions(vl) if s is None else s
    return solver.choose(vl, solver.ranked(s) if r is None else r, selection, s, keep=contra.ROUTE, what={"parts": contra.parts()})


@register("SELECT voucher, line_no, CAST(debit AS DOUBLE) AS debit, CAST(credit AS DOUBLE) AS credit FROM cl", CONTRA)
def clean_amounts(spark, d):
    return contra.cleaned(lines(spark, d)).select("voucher", "line_no", F.col("debit").cast("double").alias("debit"), F.col("credit").cast("double").alias("credit"))


@register("SELECT voucher, structure, array_to_string(ds, '、') AS ds, array_to_string(cs, '、') AS cs FROM route", CONTRA)
def contra_structure(spark, d):
    return _routes(spark, d).select("voucher", "structure", S.join_subjects(F.col("ds")).alias("ds"), S.join_subjects(F.col("cs")).alias("cs"))


@register("SELECT count(*) FILTER (structure <> 'empty') AS processed, count(*) FILTER (structure IN ('1v1', '1vN', 'Nv1')) AS simple, count(*) FILTER (structure = 'MvN') AS complex FROM route", CONTRA)
def contra_stats(spark, d):
    return contra.process_stats(_routes(spark, d))


# Closing and exchange vouchers are processed and simple whether they have amounts or not; complex counts patterns.
@register(
    ", kinds AS (SELECT voucher, structure, len(ds) + len(cs) = 0 AS bare, list_contains(all_subjects, '本年利润') OR (len(list_filter(all_subjects, lambda s: contains(s, '财务费用'))) > 0 "
    f"AND len(list_filter(all_subjects, lambda s: regexp_matches(s, '{'|'.join(FX_OPERATING)}'))) = 0 "
    f"AND len(list_filter(all_subjects, lambda s: regexp_matches(s, '{'|'.join(FX_MONETARY)}') AND NOT regexp_matches(s, '{'|'.join(FX_EXCLUDED)}'))) >= 3) AS special FROM route JOIN route0 USING (voucher, ds, cs)) "
    "SELECT count(*) AS vouchers, count(*) FILTER (special OR NOT bare) AS processed, count(*) FILTER (special OR (NOT bare AND structure <> 'MvN')) AS simple_solved, (SELECT count(DISTINCT pattern) FROM pat) AS complex_groups FROM kinds",
    CONTRA,
)
def contra_process_stats(spark, d):
    return contra.process_figures(lines(spark, d))


@register("SELECT voucher FROM route WHERE structure = 'fx'", CONTRA)
def fx_intercept(spark, d):
    return _routes(spark, d).where("structure = 'fx'").select("voucher")


ROW = "SELECT voucher, line_no, subject, CAST({d} AS DOUBLE) AS debit, CAST({c} AS DOUBLE) AS credit, {x} AS contra, {v} AS virtual FROM {t} JOIN route USING (voucher) WHERE structure = '{s}'"
CLOSING_SQL = ROW.format(d="debit", c="credit", x="CASE WHEN debit <> 0 OR credit <> 0 THEN '本年利润' ELSE '' END", v="false", t="lines", s="closing")
FX_SQL = ROW.format(d="debit", c="credit", x="CASE WHEN debit = 0 AND credit = 0 THEN '' WHEN contains(subject, '财务费用') THEN '汇兑损益调整对象' ELSE '财务费用' END", v="false", t="lines", s="fx")
ONE_SQL = ROW.format(d="debit", c="CASE WHEN debit <> 0 THEN 0 ELSE credit END", x="CASE WHEN debit <> 0 THEN cs[1] WHEN credit <> 0 THEN ds[1] ELSE '' END", v="false", t="cl", s="1v1")
MANY_SQL = " UNION ALL ".join(
    [
        ROW.format(d="0", c="credit", x="ds[1]", v="false", t="cl", s="1vN") + " AND credit <> 0",
        ROW.replace("subject,", "ds[1] AS subject,").format(d="credit", c="0", x="cl.subject", v="true", t="cl", s="1vN") + " AND credit <> 0",
        ROW.format(d="debit", c="0", x="cs[1]", v="false", t="cl", s="Nv1") + " AND debit <> 0",
        ROW.replace("subject,", "cs[1] AS subject,").format(d="0", c="debit", x="cl.subject", v="true", t="cl", s="Nv1") + " AND debit <> 0",
    ]
)


@register(CLOSING_SQL, CONTRA)
def contra_closing(spark, d):
    return _of_structure(spark, d, "closing")


@register(FX_SQL, CONTRA)
def contra_fx(spark, d):
    return _of_structure(spark, d, "fx")


@register(ONE_SQL, CONTRA)
def contra_1v1(spark, d):
    return _of_structure(spark, d, "1v1")


@register(MANY_SQL, CONTRA)
def contra_1vn(spark, d):
    return _of_structure(spark, d, "1vN", "Nv1")


@register("SELECT voucher, subject, sign, side, cents FROM led", CONTRA)
def contra_ledger(spark, d):
    return contra.ledgers(_routed(spark, d))


@register("SELECT pattern, count(*) AS n, min(voucher) AS sample, md5(pattern) AS hash FROM pat GROUP BY pattern", CONTRA)
def pattern_counts(spark, d):
    return contra.pattern_counts(_ledgers(spark, d))


@register("SELECT voucher, md5(array_to_string(all_subjects, '、')) AS hash FROM route0", CONTRA)
def pattern_hash(spark, d):
    return _routes(spark, d).select("voucher", S.pattern_hash(F.col("subjects")).alias("hash"))


@register()
def contra_solutions(spark, d):
    return solver.solutions(_ledgers(spark, d))


def _small(vl: DataFrame) -> DataFrame:
    """Vouchers whose ledgers have at most three accounts on either side, which SQL can list."""
    return vl.where(_few())


def _few() -> Column:
    of = lambda side: F.size(F.filter("ledger", lambda e: (e["side"] == side) & (e["cents"] != 0)))
    return (of("D") <= WIDEST) & (of("C") <= WIDEST)


def _as_text(links: str) -> Column:
    one = lambda l: F.concat(l["d_subject"], l["d_sign"], F.lit(">"), l["c_subject"], l["c_sign"], F.lit("="), l["cents"].cast("string"))
    sorted_links = F.array_sort(F.transform(links, lambda l: F.struct(l["d_subject"].alias("d_subject"), l["d_sign"].alias("d_sign"), l["c_subject"].alias("c_subject"), l["c_sign"].alias("c_sign"), l["cents"].alias("cents"))))
    return F.array_join(F.transform(sorted_links, one), ";")


@register("SELECT voucher, CASE WHEN n IS NULL THEN 'no_solution' ELSE 'solved' END AS status, n, coalesce(links, '') AS links, score, rank FROM small LEFT JOIN ordered USING (voucher)", SEARCH)
def contra_solutions_small(spark, d):
    """contra_solutions, scores and ranks of every voucher with at most three accounts a side."""
    vl = _small(_ledgers(spark, d))
    s = solver.solutions(vl)
    r = s.select("ledger_key", "status", "n", "links").join(solver.ranked(s).select("ledger_key", "n", "score", "rank"), ["ledger_key", "n"], "left")
    return vl.select("voucher", "ledger_key").join(r, "ledger_key").select("voucher", "status", "n", _as_text("links").alias("links"), "score", F.col("rank").cast("long").alias("rank"))


#: Many-to-many rows of small ledgers; chosen(voucher, rank) says which solution.
SMALL_PARTS = """, lines_of AS (SELECT cl.voucher, line_no, subject, debit, credit, o.id FROM cl JOIN chosen USING (voucher) LEFT JOIN ordered o ON o.voucher = cl.voucher AND o.rank = chosen.rank),
whole AS (SELECT id, 'd' AS side, ds AS subject, dg AS sign, sum(cents) AS cents FROM link GROUP BY ALL UNION ALL SELECT id, 'c', cs, cg, sum(cents) FROM link GROUP BY ALL)"""
SMALL_SELECT = """SELECT voucher, line_no, l.subject, CAST(debit AS DOUBLE) * (CAST(k.cents AS DOUBLE) / CAST(w.cents AS DOUBLE)) AS debit, 0.0::DOUBLE AS credit, k.cs AS contra, false AS virtual
  FROM lines_of l JOIN link k USING (voucher, id) JOIN whole w ON w.id = l.id AND w.side = 'd' AND w.subject = l.subject AND w.sign = k.dg WHERE k.ds = l.subject AND k.dg = CASE WHEN debit >= 0 THEN 'Pos' ELSE 'Neg' END AND debit <> 0 AND w.cents <> 0
UNION ALL
SELECT voucher, line_no, l.subject, 0.0::DOUBLE, CAST(credit AS DOUBLE) * (CAST(k.cents AS DOUBLE) / CAST(w.cents AS DOUBLE)), k.ds, false
  FROM lines_of l JOIN link k USING (voucher, id) JOIN whole w ON w.id = l.id AND w.side = 'c' AND w.subject = l.subject AND w.sign = k.cg WHERE k.cs = l.subject AND k.cg = CASE WHEN credit >= 0 THEN 'Pos' ELSE 'Neg' END AND credit <> 0 AND w.cents <> 0
UNION ALL
SELECT voucher, line_no, subject, CAST(debit AS DOUBLE), CAST(credit AS DOUBLE), '需人工分析(无解)', false FROM lines_of WHERE id IS NULL"""
SMALL_ROWS = f"{SMALL_PARTS}\n{SMALL_SELECT}"


@register(", chosen AS (SELECT voucher, 1 AS rank FROM small)" + SMALL_ROWS, SEARCH)
def contra_mvn_small(spark, d):
    """contra_mvn of the vouchers with at most three accounts a side."""
    journal = written(lines(spark, d), "lines")
    vouchers = vouchers_once(journal)
    return contra.of_vouchers(journal, chosen_of(_small(contra.many_to_many(vouchers))), vouchers)


@register(
    """, counted AS (SELECT pattern, count(*) AS n, min(voucher) AS voucher FROM pat GROUP BY pattern),
numbered AS (SELECT *, row_number() OVER (ORDER BY n DESC, pattern) AS p FROM counted),
plans AS (SELECT pattern, p || '-' || rank AS option, CASE WHEN rank = 1 THEN 'x' ELSE '' END AS mark, score, id FROM numbered JOIN ordered USING (voucher))
SELECT pattern, option, mark, score, 0.5::DOUBLE AS memory, round_even(score * 1.25 * 100, 0) / 100 AS total, NULL AS subject, NULL AS contra, NULL::DOUBLE AS amount FROM plans
UNION ALL SELECT pattern, option, mark, NULL, NULL, NULL, ds, cs, cents / 100.0::DOUBLE FROM plans JOIN link USING (id)""",
    SEARCH,
)
def plan_table_small(spark, d):
    """plan_table of the patterns whose sample voucher has at most three accounts a side, without the places of rows."""
    return plan_table(spark, d, small=True).drop("row")


@register(
    """, counted AS (SELECT pattern, min(voucher) AS voucher FROM pat GROUP BY pattern),
found AS (SELECT voucher, max(rank) AS last FROM ordered GROUP BY voucher),
marked AS (SELECT pattern FROM counted JOIN found USING (voucher) WHERE last >= 2),
chosen AS (SELECT small.voucher, CASE WHEN last >= 2 AND pattern IN (SELECT pattern FROM marked) THEN 2 ELSE 1 END AS rank FROM small JOIN pat USING (voucher) LEFT JOIN found USING (voucher))"""
    + SMALL_ROWS,
    SEARCH,
)
def marked_rows_small(spark, d):
    """From plans to rows by way of a workbook: the plan sheet is written, with the second plan of every pattern marked behind the first, read back, and what is marked is applied to the many-to-many lines of small ledgers."""
    journal = written(lines(spark, d), "lines")
    vouchers = vouchers_once(journal)
    every = contra.many_to_many(vouchers)
    patterns = contra.pattern_counts(every)
    vl = _small(every)
    s = solver.solutions(vl)
    r = solver.ranked(s)
    # plans are those of the patterns' sample vouchers, so only their solutions are ranked for the sheet
    samples = vl.join(patterns.select(F.col("sample").alias("voucher")), "voucher", "left_semi").select("ledger_key")
    sheet = report.plan_sheet(solver.plan_table(vl, solver.ranked(written(s.join(samples, "ledger_key", "left_semi"), "samples")), patterns))
    path = f"{shared_folder(spark)}/tables/plans-{uuid.uuid4().hex}.xlsx"
    again = F.when(F.split_part(report.PLAN_NAMES[1], F.lit("-"), F.lit(2)) == "2", " X ").otherwise(F.col(report.PLAN_NAMES[2]))
    xlsx.write(sheet.withColumn(report.PLAN_NAMES[2], again), path, report.PLAN_SHEET)
    selection = report.sheet_selection(xlsx.read_workbook(spark, path, as_text=True, all_sheets=True))
    return contra.of_vouchers(journal, chosen_of(vl, selection, r, s), vouchers)


@register("SELECT CAST(0 AS BIGINT) AS violations")
def contra_conservation(spark, d):
    """Every solution gives each account of its ledger exactly its amount; this counts those that do not."""
    vl = _ledgers(spark, d)
    return solver.violations(vl, solver.solutions(vl).where("n is not null"))


@register("SELECT voucher, n, score FROM ordered", SEARCH)
def occam_score(spark, d):
    """The scores of all solutions of the small ledgers, by voucher."""
    vl = _small(_ledgers(spark, d))
    scored = solver.occam_scores(solver.solutions(vl).where("n is not null"))
    return vl.select("voucher", "ledger_key").join(scored, "ledger_key").select("voucher", "n", "score")


@register()
def plan_table(spark, d, small: bool = False):
    """Plans need the sample voucher of each pattern only; small: of the patterns whose sample SQL can list."""
    vl = _ledgers(spark, d)
    patterns = contra.pattern_counts(vl)
    samples = vl.join(patterns.select(F.col("sample").alias("voucher")), "voucher", "left_semi")
    samples = _small(samples) if small else samples
    return solver.plan_table(vl, solver.ranked(solver.solutions(samples)), patterns)


@register(
    """, counted AS (SELECT pattern, min(voucher) AS voucher FROM pat GROUP BY pattern)
SELECT pattern, CAST(least(max(rank), 3) AS INTEGER) AS choice FROM counted JOIN ordered USING (voucher) GROUP BY pattern""",
    SEARCH,
)
def plan_selection(spark, d):
    """What people choose who mark up to the third plan of each pattern (small ledgers), where the last mark counts."""
    plan = plan_table(spark, d, small=True)
    number = F.split_part("option", F.lit("-"), F.lit(2)).cast("int")
    return solver.plan_selection(plan.withColumn("mark", F.when(number == 1, "x").when(number <= 3, " X ").otherwise("o")))


@register()
def solution_scores(spark, d):
    """occam_score over every solution of every ledger."""
    return solver.occam_scores(contra_solutions(spark, d).where("n is not null")).select("ledger_key", "n", "links", "score")


@register()
def plan_choices(spark, d):
    """plan_selection over the whole plan table."""
    return solver.plan_selection(plan_table(spark, d))


@register()
def contra_mvn(spark, d):
    journal = written(lines(spark, d), "lines")
    vouchers = vouchers_once(journal)
    return contra.of_vouchers(journal, chosen_of(contra.many_to_many(vouchers)), vouchers)


@register()
def contra_report(spark, d):
    journal = written(lines(spark, d), "lines")
    vouchers = vouchers_once(journal)
    return contra.report(journal, chosen_of(contra.many_to_many(vouchers)), vouchers=vouchers)


EMPTY_SQL = ROW.format(d="debit", c="credit", x="'无效分录'", v="false", t="lines", s="empty")


REPORT_PARTS = ", chosen AS (SELECT voucher, 1 AS rank FROM small)" + SMALL_PARTS
REPORT_SELECT = " UNION ALL ".join([SMALL_SELECT, EMPTY_SQL, CLOSING_SQL, FX_SQL, ONE_SQL, MANY_SQL])


@register(f"{REPORT_PARTS}\n{REPORT_SELECT}", SEARCH)
def contra_report_small(spark, d):
    """contra_report but for vouchers with more than three accounts a side in a search."""
    journal = written(lines(spark, d), "lines")
    vouchers, chosen = without_large(journal)
    return contra.report(journal, chosen, vouchers=vouchers)


def without_large(journal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """vouchers_once(), and what the search chose for those with a ledger that SQL can list; a report leaves out the others."""
    vouchers = vouchers_once(journal)
    return vouchers, chosen_of(_small(contra.many_to_many(vouchers)))


@register("SELECT date, number, subject, CAST(sum(debit) AS DOUBLE) AS debit, 0.0::DOUBLE AS credit FROM lines GROUP BY 1, 2, 3 HAVING sum(debit) <> 0 UNION ALL SELECT date, number, subject, 0.0::DOUBLE, CAST(sum(credit) AS DOUBLE) FROM lines GROUP BY 1, 2, 3 HAVING sum(credit) <> 0", LINES)
def compress_simple(spark, d):
    out = compress.simple(lines(spark, d), ["date", "number", "subject"])
    return out.select("date", "number", "subject", F.col("debit").cast("double").alias("debit"), F.col("credit").cast("double").alias("credit"))


@register(
    ", m AS (SELECT month(CAST(date AS DATE)) AS month, feature, subject, sum(debit) AS debit, sum(credit) AS credit FROM lines JOIN (SELECT voucher, feature FROM v) USING (voucher) GROUP BY 1, 2, 3), "
    "n AS (SELECT *, dense_rank() OVER (ORDER BY CAST(month AS VARCHAR) || '_' || feature) AS id FROM m) "
    "SELECT id AS virtual_voucher, feature, CAST(month AS INTEGER) AS month, subject, CAST(debit AS DOUBLE) AS debit, 0.0::DOUBLE AS credit FROM n WHERE debit <> 0 UNION ALL SELECT id, feature, CAST(month AS INTEGER), subject, 0.0::DOUBLE, CAST(credit AS DOUBLE) FROM n WHERE credit <> 0",
    LINES,
)
def compress_minimal(spark, d):
    out = compress.minimal(lines(spark, d))
    return out.select("virtual_voucher", "feature", "month", "subject", F.col("debit").cast("double").alias("debit"), F.col("credit").cast("double").alias("credit"))


@register("SELECT feature, array_to_string(list_transform(flatten(list_transform(subjects, lambda s: [regexp_replace(s, '[费款金产入本利]$', ''), s])), lambda s: s), ' ') AS tokens FROM (SELECT DISTINCT feature, subjects FROM b)", LINES)
def tokenize_features(spark, d):
    return business(spark, d).select("feature", F.array_join(S.tokens(F.col("subjects")), " ").alias("tokens")).distinct()


@register(
    ", sub AS (SELECT DISTINCT subject FROM lines), ch AS (SELECT subject, c, count(*) AS n FROM (SELECT subject, unnest(string_split(subject, '')) AS c FROM sub) GROUP BY ALL), nrm AS (SELECT subject, sqrt(sum(n * n)) AS norm FROM ch GROUP BY 1), "
    f"sim AS (SELECT a.subject, b.subject AS other, {R6('sum(a.n * b.n) / (any_value(x.norm) * any_value(y.norm))')} AS similarity FROM ch a JOIN ch b ON a.c = b.c AND a.subject <> b.subject JOIN nrm x ON x.subject = a.subject JOIN nrm y ON y.subject = b.subject GROUP BY 1, 2) "
    "SELECT subject, other, similarity FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY similarity DESC, other) AS r FROM sim) WHERE r <= 5",
    LINES,
)
def similar_subjects(spark, d):
    return ml.similar_subjects(lines(spark, d).select("subject").distinct(), 5)


LEARNED = (
    GROUPED
    + """,
mdoc AS (SELECT DISTINCT feature, primary_group, list_filter(flatten(list_transform(subjects, lambda s: [regexp_replace(s, '[费款金产入本利]$', ''), s])), lambda t: length(t) >= 2) AS one FROM c),
mword AS (SELECT feature, primary_group, unnest(list_concat(one, list_transform(range(1, len(one)), lambda i: one[i] || ' ' || one[i + 1]))) AS term FROM mdoc),
mtf AS (SELECT feature, primary_group, term, count(*) AS tf FROM mword GROUP BY ALL),
mvoc AS (SELECT term, count(*) AS df FROM mtf WHERE primary_group <> '其他群' GROUP BY term HAVING count(*) >= 2 ORDER BY sum(tf) DESC, term LIMIT 100),
mraw AS (SELECT feature, primary_group, term, tf * (ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1) AS x FROM mtf JOIN mvoc USING (term) CROSS JOIN (SELECT count(*) AS n FROM mdoc WHERE primary_group <> '其他群')),
mvec AS (SELECT feature, primary_group, term, x / sqrt(sum(x * x) OVER (PARTITION BY feature)) AS weight FROM mraw),
mcen AS (SELECT primary_group AS g, term, sum(weight) / any_value(n) AS weight FROM mvec JOIN (SELECT primary_group, count(*) AS n FROM mdoc GROUP BY 1) USING (primary_group) WHERE primary_group <> '其他群' GROUP BY 1, 2)"""
)


@register(f"SELECT feature, primary_group, term, {R6('weight')} AS weight FROM mvec", LEARNED)
def ml_tfidf(spark, d):
    _, v = ml.fit_features(classified(spark, d))
    return v.select("feature", "primary_group", "term", (F.rint(F.col("weight") * 1e6) / 1e6).alias("weight"))


@register(f"SELECT g, term, {R6('weight')} AS weight FROM mcen", LEARNED)
def ml_centroids(spark, d):
    return ml.centroids(*ml.fit_features(classified(spark, d))).select("g", "term", (F.rint(F.col("weight") * 1e6) / 1e6).alias("weight"))


@register(
    ", cosine AS (SELECT feature, g, round_even(sum(v.weight * m.weight / norm) * 1e9, 0) / 1e9 AS x FROM mvec v JOIN mcen m USING (term) JOIN (SELECT g, sqrt(sum(weight * weight)) AS norm FROM mcen GROUP BY g) USING (g) WHERE primary_group = '其他群' GROUP BY 1, 2), "
    "guess AS (SELECT feature, g FROM cosine QUALIFY row_number() OVER (PARTITION BY feature ORDER BY x DESC, g) = 1 AND x >= 0.3) "
    "SELECT voucher, coalesce(g, primary_group) AS primary_group, g IS NOT NULL AS ml_predicted FROM c LEFT JOIN guess USING (feature)",
    LEARNED,
)
def ml_predict(spark, d):
    return ml.predict(classified(spark, d))


@register()
def feature_clusters(spark, d):
    return ml.feature_clusters(classified(spark, d))
